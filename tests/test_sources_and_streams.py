"""Sources, sinks and streams, and the driver contract."""

import json
import time
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from touchline import config as C
from touchline.operators import sequential
from touchline.plans.fixtures import tables
from touchline.sources import csv_archive, manifest, paged_json, snapshots
from touchline.streaming import live


def test_snapshot_round_trip_and_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    snapshots.save_snapshot({"a": spark.range(3), "b": spark.range(2)}, path)
    got = snapshots.load_snapshot(spark, path)
    assert {k: v.count() for k, v in got.items()} == {"a": 3, "b": 2}
    assert {r.name: r.rows for r in snapshots.summary_counts(got).collect()} == {"a": 3, "b": 2}
    monkeypatch.setattr(snapshots, "VERSION", 2)
    with pytest.raises(ValueError, match="version"):
        snapshots.load_snapshot(spark, path)
    assert snapshots.try_load_snapshot(spark, str(tmp_path / "none")) is None and snapshots.try_load_snapshot(spark, path) is None
    filled = snapshots.with_defaults(spark.range(1), "id long, name string, n int", {"n": -1}).first()
    assert (filled.id, filled.name, filled.n) == (0, None, -1)
    monkeypatch.delenv(snapshots.ENV, raising=False)
    with pytest.raises(ValueError, match="path"):
        snapshots.snapshot_path()


def test_skill_csv_repair(spark, tmp_path):
    names = ["player_id", "name", "dob", "club", "height", *["crossing"], *[f"s{i}" for i in range(1, 34)]]
    skills = [str(i) for i in range(34)]
    good = ["1", '"Ann, A"', "1990-01-02", "Club", "Tall", *skills]
    shifted = ["2", "Bo", "1/2/1991", "7", "8", *[str(i) for i in range(2, 34)], "", ""]
    bad = ["x", "No id", "1990-01-01", "c", "h", *skills]
    again = ["1", "Ann B", "1990-01-02", "Club", "Tall", "oops", *skills[1:]]
    (tmp_path / "2024-01-05.csv").write_text("﻿" + ",".join(names) + "\n" + "\n".join(",".join(r) for r in (good, shifted, bad, again)) + "\n")
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2024-01-06.csv").write_text("other,header\n1,2\n")
    got = {r.player_id: r for r in csv_archive.skill_snapshots(csv_archive.csv_cells(spark, str(tmp_path))).collect()}
    assert set(got) == {1, 2} and got[1].snap_date == date(2024, 1, 5)
    assert got[1].name == "Ann B" and got[1].skills[0] == C.MISSING and got[1].skills[1] == 1
    assert got[2].shifted and got[2].skills[:3] == [7.0, 8.0, 2.0] and got[2].dob == date(1991, 1, 2)


def test_record_files(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "match_id long, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "match_id long, v string")
    assert csv_archive.merged([a, b]).count() == 3
    with pytest.raises(ValueError, match="headers"):
        csv_archive.merged([a, b.withColumnRenamed("v", "w")])
    left, right = csv_archive.only_in(a, b, "match_id")
    assert {r.match_id for r in left.collect()} == {1} and {r.match_id for r in right.collect()} == {3}
    assert csv_archive.new_records(a, b).count() == 4
    full = spark.createDataFrame([(1, -1, None), (1, 5, -1), (1, 5, 6)], "k long, a long, b long")
    assert tuple(csv_archive.fullest(full, ["k"]).first()) == (1, 5, 6)
    assert csv_archive.write_records(a.limit(0), str(tmp_path / "e")) is False and csv_archive.write_records(a, str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "f"), header=True).columns == ["match_id", "v"]


def test_paged_json_source(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"data": [{"id": i * 10 + k} for k in range(2)], "pager": {"max_page": 2}}))
    spark.dataSource.register(paged_json.PagedJson)
    got = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{page}}.json").load()
    rows = got.select(F.from_json("record", "id long").alias("r")).select("r.id")
    assert sorted(r.id for r in rows.collect()) == [10, 11, 20, 21] and got.rdd.getNumPartitions() == 2
    assert paged_json.page_count("{}") == 1 and paged_json.page_url("http://h/{page}?a=1", 3, {"key": "k"}) == "http://h/3?a=1&key=k"


def test_manifest(tmp_path):
    assert manifest.canonical_json({"b": {2, 1}, "a": datetime(2024, 1, 1, tzinfo=UTC)}) == manifest.canonical_json({"a": datetime(2024, 1, 1, tzinfo=UTC), "b": {1, 2}})
    with pytest.raises(ValueError, match="finite"):
        manifest.canonical_json(float("nan"))
    assert manifest.run_id("k", seed=1) == manifest.run_id("k", seed=1) != manifest.run_id("k", seed=2)
    manifest.write_atomically(tmp_path / "x.json", b"{}")
    assert [x["path"] for x in manifest.inventory([tmp_path / "x.json"], tmp_path)] == ["x.json"]
    with pytest.raises(ValueError):
        manifest.inventory([tmp_path / "x.json"], tmp_path / "other")


def test_streamed_ratings_equal_the_batch(spark, tmp_path):
    rows = tables(spark, "/root/testdata/sf0.001", "fx_matches").where("match_id < 600")
    ordered = rows.orderBy("dt", "hour_utc", "match_id").collect()
    schema = rows.schema
    source = tmp_path / "in"
    for i in range(3):
        part = ordered[i * len(ordered) // 3 : (i + 1) * len(ordered) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(1.1)  # the file source takes older files first
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = live.rated(stream).writeStream.format("memory").queryName("streamed_ratings").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.match_id: r.home_elo for r in spark.table("streamed_ratings").collect()}
    want = {r.match_id: r.home_elo for r in sequential.elo_ratings(rows).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def test_live_board(spark, tmp_path):
    now = datetime(2024, 1, 1, 12)
    table = spark.createDataFrame([(1, "NS", datetime(2024, 1, 1, 12, 20), []), (2, "FT", now, []), (3, "NS", datetime(2024, 1, 9), []), (4, "NS", datetime(2024, 1, 1, 15), [1])], "match_id long, status string, kickoff timestamp, lineup array<long>")
    got = {r.match_id: r.use_previous_lineup for r in live.upcoming(table, F.lit(now)).collect()}
    assert got == {1: True, 4: False}
    sizes = [r.n for r in spark.createDataFrame([(list(range(22)),), ([],)], "l array<long>").select(F.size(live.repaired_lineup(F.col("l"))).alias("n")).collect()]
    assert sizes == [11, 0]
    write = live.board_writer(str(tmp_path / "board"))
    write(spark.range(5), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "board")).count() == 2


def test_driver_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_match_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from touchline.plans import registry
    from touchline.plans.fixtures import BASE

    base = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in BASE:
        db.sql(f"create view {t} as select * from '{base}/{t}.parquet'")
    known, sql = registry.queries(), registry.oracle_sql()
    for name in ("last5_goals", "match_load", "table_position", "scope_metrics", "threshold_grid", "temporal_threshold", "impute_apply", "finding_rollup", "folds"):
        ours = known[name](spark, base).toPandas()
        theirs = db.sql(sql[name]).df()[list(ours.columns)]
        assert sorted(map(str, ours.itertuples(index=False))) == sorted(map(str, theirs.itertuples(index=False))), name


def test_paged_reader_tries_again(monkeypatch):
    import io
    import urllib.error

    from touchline.sources import paged_json

    answers = [TimeoutError(), urllib.error.HTTPError("u", 503, "busy", None, None), io.BytesIO(b"[]"), urllib.error.HTTPError("u", 404, "gone", None, None)]

    def answer(url, timeout):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    monkeypatch.setattr(paged_json, "urlopen", answer)
    monkeypatch.setattr(paged_json.time, "sleep", lambda s: None)
    reader = paged_json.PagedJsonReader({"url": "http://x/{page}"})
    assert reader.get(1) == "[]"
    with pytest.raises(urllib.error.HTTPError):
        reader.get(1)
