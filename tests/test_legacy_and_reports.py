"""Variants of the older feed and the rarer reports."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from touchline.operators import datasets, legacy, quality
from touchline.operators.form import in_order
from touchline.plans.fixtures import tables


def test_previous_result_elo_against_a_plain_loop(spark):
    rows = tables(spark, "/root/testdata/sf0.001", "fx_matches")
    state, want = {}, {}
    for r in rows.orderBy(*in_order()).collect():
        (h, sh), (a, sa) = state.get(r.home_id, (1500.0, 0.5)), state.get(r.away_id, (1500.0, 0.5))
        e = 1 / (1 + 10 ** ((a - h) / 400))
        got = 1.0 if r.home_goals > r.away_goals else 0.0 if r.home_goals < r.away_goals else 0.5
        want[r.match_id] = h + 32 * (sh - e), a + 32 * (sa - 1 + e)
        state[r.home_id], state[r.away_id] = (want[r.match_id][0], got), (want[r.match_id][1], 1 - got)
    made = {r.match_id: (r.home_elo, r.away_elo) for r in legacy.previous_result_elo(rows).collect()}
    assert made.keys() == want.keys() and all(made[i] == pytest.approx(want[i]) for i in want)


def test_stat_values_and_lineups(spark):
    schema = "s array<struct<statistics:array<struct<type:string,value:string>>>>, l string"
    stats = [([("Shots", "5"), ("Possession", "45%")],), ([("Shots", None)],)]
    table = spark.createDataFrame([(stats, '[{"id": 1, "pos": "G"}, {"id": "x"}]'), ([], '[{"id": 12, "pos": "D"}]')], schema)
    got = table.select(
        legacy.stat_value(F.col("s"), "Shots", 0).alias("a"), legacy.stat_value(F.col("s"), "Shots", 1).alias("b"), legacy.stat_value(F.col("s"), "Possession", 0, True).alias("p"), legacy.parsed_lineup(F.col("l")).alias("l")
    ).collect()
    assert [(r.a, r.b, r.p) for r in got] == [(5.0, -1.0, 0.45), (-1.0, -1.0, -1.0)] and [len(r.l) for r in got] == [0, 1]
    assert legacy.json_columns(table.select("s"), ["s"]).dtypes == [("s", "string")]


def test_balanced_matrix(spark):
    field, keeper = [50.0] * 29 + [10.0] * 5, [10.0] * 29 + [50.0] * 5
    table = spark.createDataFrame([([field, keeper, field], [[1.0] * 34, [2.0] * 34, [3.0] * 34])], "m array<array<double>>, s array<array<double>>")
    got = table.select(legacy.balanced(F.col("m"), F.col("s")).alias("x")).first().x
    assert [r[0] for r in got] == [1.0, 2.0, 50.0]


def test_pairs_are_alike_and_unlike(spark):
    rows = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("label"))
    label = {r.k: r.label for r in rows.collect()}
    pairs = legacy.sample_pairs(rows, "label", "k", 4).collect()
    assert all((label[r.k] == label[r.other]) == r.same and r.k != r.other for r in pairs)
    assert sum(r.same for r in pairs) == 4 * 300


@pytest.mark.parametrize(("labels", "k"), [(2, 10), (10, 10), (40, 3)])
def test_every_row_gets_all_its_pairs(spark, labels, k):
    """The last label has three rows, so that one of its pools and, with two labels, the others' are smaller than k."""
    rows = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") < 3, labels - 1).otherwise(F.col("id") % (labels - 1)).alias("label"))
    label = {r.k: r.label for r in rows.collect()}
    got = {}
    for r in legacy.sample_pairs(rows, "label", "k", k).collect():
        assert (label[r.k] == label[r.other]) == r.same and r.k != r.other
        got.setdefault((r.k, r.same), []).append(r.other)
    for x, own in label.items():
        size = sum(y == own for y in label.values())
        for same, pool in ((True, size - 1), (False, len(label) - size)):
            drawn = got.get((x, same), [])
            assert len(drawn) == len(set(drawn)) == min(k, pool)


def test_nearest_snapshot_against_brute_force(spark):
    days = [(i, date(2024, 1 + i % 12, 1 + i % 28)) for i in range(60)]
    snaps = [date(2024, m, 10) for m in range(2, 12, 3)]
    got = {r.k: r.snap_date for r in quality.nearest_snapshot(spark.createDataFrame(days, "k long, day date"), spark.createDataFrame([(s,) for s in snaps], "snap_date date"), ["k"]).collect()}
    assert got == {k: min(snaps, key=lambda s: (abs((s - d).days), s)) for k, d in days}


def test_cells_readiness_and_importance(spark):
    old = spark.createDataFrame([(1, [[1.0, -1.0], [2.0, -1.0]])], "id long, matrix array<array<double>>")
    new = spark.createDataFrame([(1, [[1.0, 5.0], [3.0, -1.0]])], "id long, matrix array<array<double>>")
    assert tuple(quality.cell_comparison(old, new, ["id"], ["id"]).first()) == (1, 2, 0, 1, 1, 1)
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0], 5), (3, [1.0, float("nan")], 1)], "k long, a array<double>, i int")
    assert {r.code for r in quality.report(quality.readiness(rows, {"a": 2}, {"i": 2}, "k")).collect()} == {"a_size", "a_finite", "i_range"}
    table = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") % 2 * 1.0).alias("x"), F.rand(3).alias("z"))
    got = {r.column: r.loss_of_accuracy for r in datasets.permutation_importance(lambda d: d.withColumn("probability", F.col("x")), table, ["x", "z"], "id").collect()}
    assert got["x"] > 0.3 and got["z"] == 0
