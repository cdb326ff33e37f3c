"""Runs that are read again after changes, and rows of match pages."""

import datetime
import glob
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from touchline.sources import match_pages as M
from touchline.sources import runs

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "fold long, round_index long, match_id long, dt timestamp, competition string, season long, y_true int, model_name string, probability double"


def predictions(spark, rows=((1, 25, 1, 0.4), (1, 25, 2, 0.6), (2, 26, 3, 0.5)), model="m"):
    return spark.createDataFrame([(f, r, m, DAY, "A", 2024, m % 2, model, p) for f, r, m, p in rows], SCHEMA)


def folds(spark):
    return spark.createDataFrame([(1, 25), (2, 26)], "fold long, round_index long")


def test_runs_are_checked(spark, tmp_path):
    path = str(tmp_path / "a")
    one = runs.save_run(path, "benchmark", predictions(spark), folds(spark), {"window": 25}, "SNAP", 7)
    got = runs.load_run(spark, path, ("canary", "benchmark"))
    assert got["run_id"] == one and one.startswith("benchmark-") and got["model_name"] == "m" and got["predictions"].count() == 3 and got["configuration"] == {"window": 25}
    assert runs.save_run(str(tmp_path / "b"), "benchmark", predictions(spark), folds(spark), {"window": 25}, "SNAP", 8) != one
    with pytest.raises(ValueError, match="kind"):
        runs.load_run(spark, path, ("canary",))
    with pytest.raises(ValueError, match="models"):
        runs.load_run(spark, path, ("benchmark",), "other")
    predictions(spark).coalesce(1).write.mode("append").parquet(f"{path}/predictions")
    with pytest.raises(ValueError, match="manifest"):
        runs.load_run(spark, path, ("benchmark",))
    changed = glob.glob(f"{tmp_path}/b/folds/*.parquet")[0]
    data = bytearray(Path(changed).read_bytes())
    data[10] ^= 1
    Path(changed).write_bytes(data)
    next(Path(changed).parent.glob(f".{Path(changed).name}.crc")).unlink()  # else the local file system itself refuses it
    with pytest.raises(ValueError, match="manifest"):
        runs.load_run(spark, str(tmp_path / "b"), ("benchmark",))


def test_faults_and_relations(spark, tmp_path):
    rows = predictions(spark, ((1, 25, 1, 0.4), (1, 26, 2, 1.4), (1, 25, 1, float("nan"))))
    assert {(r.code, r.entity_id) for r in runs.run_faults(rows.withColumn("y_true", F.lit(3)), folds(spark)).collect()} == {
        ("prediction_target", "1"), ("prediction_target", "2"), ("prediction_of_another_fold", "2"), ("prediction_probability", "2"), ("prediction_probability", "1"), ("prediction_repeated", "1"), ("fold_without_predictions", "2")
    }
    assert runs.run_faults(predictions(spark).limit(0), folds(spark).limit(0)).count() == 0
    runs.save_run(str(tmp_path / "x"), "benchmark", rows, folds(spark), {}, "S")
    with pytest.raises(ValueError, match="faulty"):
        runs.load_run(spark, str(tmp_path / "x"), ("benchmark",))
    run = {"snapshot": "S", "run_id": "r", "model_name": "m"}
    runs.related(run, {"snapshot": "S", "reference": {"run_id": "r", "model_name": "m"}})
    for other in ({"snapshot": "T", "reference": None}, {"snapshot": "S", "reference": None}, {"snapshot": "S", "reference": {"run_id": "r", "model_name": "n"}}):
        with pytest.raises(ValueError):
            runs.related(run, other)
    assert {(r.match_id, r.n_a, r.n_b) for r in runs.unlike_rows(predictions(spark), predictions(spark, ((1, 25, 1, 0.1), (1, 25, 2, 0.2), (2, 25, 3, 0.3), (1, 25, 2, 0.2)))).collect()} == {(2, 1, 2), (3, 1, 0), (3, 0, 1)}


HTML = """<html><body><table class="odds"><tr class="head"><th>Bookmaker</th></tr>
<tr class="row odds-1x2"><td><a href="#">Alpha &amp; Co</a></td><td title="1.80 &raquo; 1.95">1.95</td><td>3,40</td><td title="4.00 » -">-</td></tr>
<TR class="odds-1x2"><TD>Beta</TD><TD>2.1</TD><TD>3.3</TD><TD>3.5</TD></TR>
<tr class="odds-1x2"><td>Beta</td><td>9</td><td>9</td><td>9</td></tr><tr class="odds-1x2"><td>Gamma</td><td>1</td><td>1</td><td>1</td></tr></table>
<table><tr class="odds-total"><td>Beta</td><td>2.5</td><td title="1.70 » 1.75">x</td><td>2.05</td></tr><tr class="odds-total"><td>Beta</td><td>4.5</td><td>5</td><td>1.1</td></tr></table>
<table><tr class="stat even"><td>45%</td><td>Ball
possession</td><td>55%</td></tr><tr class="stat"><td>1.20</td><td>Expected goals (xG)</td><td>-</td></tr><tr class="stat"><td>3</td><td>Throw-ins</td><td>4</td></tr><tr class="statistics"><td>7</td><td>Fouls</td><td>7</td></tr>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, HTML, "x"), (2, None, "x"), (3, "", "x"), (4, "<tr class='no'>", "x")], "page_id long, html string, n string")
    rows = M.page_rows(pages.drop("n")).cache()
    assert rows.where("page_id = 1").count() == 11 and [r.n for r in rows.where("page_id = 1").orderBy("n").collect()] == list(range(11))
    odds = {r.bookmaker: tuple(tuple(x) for x in (r.home, r.draw, r.away)) for r in M.result_odds(rows, ("Alpha & Co", "Beta")).collect()}
    assert odds == {"Alpha & Co": ((1.8, 1.95), (3.4, 3.4), (4.0, None)), "Beta": ((2.1, 2.1), (3.3, 3.3), (3.5, 3.5))}
    assert [(r.bookmaker, r.total, tuple(r.over), tuple(r.under)) for r in M.total_odds(rows).collect()] == [("Beta", 2.5, (1.7, 1.75), (2.05, 2.05))]
    stats = M.stat_rows(rows)
    assert {(r.stat, r.home, r.away) for r in stats.collect()} == {("possession", 0.45, 0.55), ("xg", 1.2, None)}
    wide = M.wide_stats(stats).collect()
    assert len(wide) == 1 and (wide[0].home_xg, wide[0].away_xg, wide[0].home_fouls) == (1.2, -1.0, -1.0)
    urls = spark.createDataFrame([("https://a.b/x/y/z?q=1",), ("https://a.b",), ("https://a.b/only/",)], "u string").select(M.url_parts(F.col("u")).alias("p")).collect()
    assert [tuple(r.p) for r in urls] == [("https://a.b", "x/y", "z"), ("https://a.b", "", ""), ("https://a.b", "", "only")]
