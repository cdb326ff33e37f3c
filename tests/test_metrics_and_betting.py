"""Metrics, calibration, betting, quality reports, arrays."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions import scalars as S
from touchline.functions.ordered import with_rank, with_running_profit
from touchline.operators import betting, datasets, metrics, quality


def rows(spark, ys, ps):
    return spark.createDataFrame([("m", y, p) for y, p in zip(ys, ps, strict=True)], "model_name string, y_true int, probability double")


def test_binary_metrics(spark):
    got = metrics.binary_metrics(rows(spark, [0, 0, 1, 1], [0.1, 0.8, 0.7, 0.9]), ["model_name"]).first()
    assert (got.accuracy, got.auc) == (0.75, 0.75) and got.brier == pytest.approx(0.1875)
    assert metrics.binary_metrics(rows(spark, [1, 1], [0.1, 0.8]), ["model_name"]).first().auc is None
    assert metrics.binary_metrics(rows(spark, [0, 1], [0.5, 0.5]), ["model_name"]).first().auc == 0.5


def test_thresholded_auc_is_near_the_exact_one(spark):
    table = spark.range(2000).select(F.lit("m").alias("model_name"), (F.rand(1) < 0.4).cast("int").alias("y_true"), F.rand(2).alias("r")).withColumn("probability", (F.col("y_true") * 0.3 + F.col("r")) / 1.3)
    exact, near = metrics.binary_metrics(table, ["model_name"]).first().auc, metrics.thresholded_auc(table, ["model_name"]).first().auc
    assert near == pytest.approx(exact, abs=0.01)


def test_regression_and_multiclass(spark):
    got = metrics.regression_metrics(spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 1.0)], "k int, y_true double, prediction double"), ["k"]).first()
    assert (got.mae, got.rmse) == (1.5, pytest.approx(math.sqrt(2.5)))
    got = metrics.multiclass_metrics(spark.createDataFrame([(1, 0, [0.8, 0.1, 0.1]), (1, 2, [0.1, 0.2, 0.7])], "k int, y_true int, probabilities array<double>"), ["k"]).first()
    assert got.accuracy == 1 and got.expected_mae == pytest.approx(0.35) and got.log_loss == pytest.approx(-(math.log(0.8) + math.log(0.7)) / 2)


def test_calibration_bins_at_the_edges(spark):
    got = metrics.calibration_bins(rows(spark, [0, 1], [0.05, 1.0]), ["model_name"]).orderBy("bin").collect()
    assert len(got) == 10 and [r["count"] for r in got] == [1, *[0] * 8, 1] and got[4].gap is None


def test_alignment_and_faults(spark):
    table = rows(spark, [0, 1, 2], [0.5, 1.5, 0.5]).withColumn("match_id", F.monotonically_increasing_id())
    assert metrics.prediction_faults(table).count() == 2
    assert metrics.misaligned(table, 1, ["match_id"]).count() == 0


def predictions(spark, cases):
    """cases: (id, season, y, p_under, under odds, over odds)"""
    return spark.createDataFrame([(i, s, "L", datetime(s, 1, 1 + i % 28), y, p, u, o) for i, s, y, p, u, o in cases], "match_id long, season long, competition string, dt timestamp, y_true int, p_under double, under_odds double, over_odds double")


def test_edge_arithmetic_and_best_side(spark):
    made = betting.opportunities(betting.implied(predictions(spark, [(1, 2024, 1, 0.6, 1.8, 2.0), (2, 2024, 0, 0.5, 2.0, 2.0), (3, 2024, 0, 0.5, 1.0, 2.0)])))
    under = made.where("match_id = 1 and side = 'under'").first()
    assert under.edge == pytest.approx(0.6 - 1 / 1.8) and under.ev == pytest.approx(0.08) and under.profit == pytest.approx(0.8)
    assert {r.match_id: r.side for r in betting.best_sides(made).collect()} == {1: "under", 2: "under"}


def test_threshold_simulation(spark):
    best = betting.best_sides(betting.opportunities(betting.implied(predictions(spark, [(1, 2024, 1, 0.7, 1.8, 2.0), (2, 2024, 0, 0.7, 1.8, 2.0)]))))
    got = {(r.threshold, r.side): r for r in betting.threshold_grid(best).collect()}
    assert len(got) == 18 and got[0.1, "all"].num_bets == 2 and got[0.1, "all"].total_profit == pytest.approx(-0.2) and got[0.1, "all"].roi == pytest.approx(-0.1)
    assert got[0.1, "all"].max_drawdown == pytest.approx(1.0)
    empty = got[0.0, "over"]
    assert (empty.num_bets, empty.roi, empty.total_profit, empty.coverage) == (0, None, 0.0, 0.0)


def test_temporal_selection_needs_enough_bets(spark):
    cases = [(s * 1000 + i, s, int(i % 2), 0.7, 1.8, 2.0) for s in (2021, 2022, 2023) for i in range(120)]
    got = betting.temporal_thresholds(betting.best_sides(betting.opportunities(betting.implied(predictions(spark, cases))))).orderBy("test_season").collect()
    assert [r.test_season for r in got] == [2022, 2023] and [r.development_seasons for r in got] == ["2021", "2021,2022"]
    assert [r.selected_threshold for r in got] == [0.0, 0.0] and got[0].test_bets == 120
    few = betting.temporal_thresholds(betting.best_sides(betting.opportunities(betting.implied(predictions(spark, cases[:110] + cases[120:230])))), minimum=115).first()
    assert few.selection_status == "insufficient-development-bets" and few.test_bets == 0


def test_quantile_bins_follow_even_splits(spark):
    best = betting.best_sides(betting.opportunities(betting.implied(predictions(spark, [(i, 2024, 1, 0.62 + i / 1000, 1.8, 2.0) for i in range(23)]))))
    got = betting.quantile_bins(best).orderBy("quantile").collect()
    assert [r.num_bets for r in got] == [3, 3, 3] + [2] * 7
    few = betting.quantile_bins(best.where("match_id < 4")).orderBy("quantile").collect()
    assert [r.num_bets for r in few] == [1] * 4 + [0] * 6
    curve = betting.coverage_curve(best).collect()
    assert sorted(r.k for r in curve) == sorted({max(1, math.ceil(23 * x)) for x in C.COVERAGE_LEVELS})


def test_ranks_and_running_profit_without_a_global_window(spark):
    table = spark.range(500).select("id", (F.col("id") * 7919 % 101).alias("v"), F.lit(1).alias("g"), (F.col("id") % 13).alias("day"), ((F.col("id") * 31 % 7) - 3.0).alias("profit"))
    got = sorted((r.rn, r.v, r.id, r.n) for r in with_rank(table, F.floor(F.col("v") / 10), [F.asc("v"), F.asc("id")]).collect())
    assert [(v, i) for _, v, i, _ in got] == sorted((v, i) for _, v, i, _ in got) and [r[0] for r in got] == list(range(1, 501)) and got[0][3] == 500
    run = sorted((r.day, r.id, r.profit, r.cumulative, r.drawdown) for r in with_running_profit(table, ["g"], "day", ["id"], "profit").collect())
    total = peak = 0.0
    for _, _, p, c, d in run:
        total += p
        peak = max(peak, total)
        assert c == pytest.approx(total) and d == pytest.approx(peak - total)


def test_targets_and_scalars(spark):
    table = spark.createDataFrame([(1, 1), (2, 1), (None, 2), (4, 3)], "h int, a int")
    got = table.select(S.target(F.col("h"), F.col("a")).alias("u"), S.target(F.col("h"), F.col("a"), "goals_dist", 5).alias("c"), S.target(F.col("h"), F.col("a"), "goals_reg").alias("g")).collect()
    assert [r.u for r in got] == [1, 0, 1, 0] and [r.c for r in got] == [2, 3, 2, 5] and [r.g for r in got] == [2, 3, 2, 7]
    row = spark.range(1).select(
        S.season01(F.lit(None).cast("int")).alias("s"), S.clip01(F.lit(2.0)).alias("c"), S.odds_or_null(F.lit("abc")).alias("o"), S.odds_or_null(F.lit("1.5")).alias("p"), S.number_in(F.lit("45 %")).alias("n"),
        S.flexible_date(F.lit("1/31/2024")).cast("string").alias("d"), S.clean_cell(F.lit("﻿ a b ")).alias("k"), S.goalkeeper_score(F.array(*[F.lit(10.0)] * 29, *[F.lit(20.0)] * 5)).alias("q"),
    ).first()
    assert (row.s, row.c, row.o, row.p, row.n, row.d, row.k, row.q) == (0.0, C.ALMOST_ONE, None, 1.5, 0.45, "2024-01-31", "a b", 10.0)


def test_report_counts_and_examples(spark):
    table = spark.createDataFrame([(i, i % 3) for i in range(20)], "id long, k long")
    found = [quality.finding(table.where("k = 0"), "zero", "warning", "row", F.col("id"), "k is 0"), quality.finding(table.where("k = 9"), "nine", "critical", "row", F.col("id"), "k is 9")]
    got = quality.report(found, 2).collect()
    assert [(r.code, r.severity, r["count"], len(r.examples)) for r in got] == [("zero", "warning", 7, 2)]
    clash = [*found, quality.finding(table.where("k = 1"), "zero", "critical", "row", F.col("id"), "other")]
    with pytest.raises(Exception, match="two severities"):
        quality.report(clash).collect()
    laws = quality.conservation(spark.sql("select 3 as a, 1 as b, 2 as c, null as d"), {"sum": "a = b + c", "known": "d > 0"})
    assert [r.code for r in laws.collect()] == ["known"]


def test_pivots_of_one_shape(spark):
    a = spark.createDataFrame([("x", 1.0)], "row string, p double")
    b = spark.createDataFrame([("y", 2.0)], "row string, q double")
    left, right = quality.same_shape(a, b)
    assert left.columns == right.columns == ["row", "p", "q"] and left.count() == right.count() == 2


def test_arrays_and_role_means(spark):
    made = spark.createDataFrame([([[50.0, -1.0], [150.0, 20.0], [-1.0, -1.0]], [0, 1, 1], None, 2.5)], "m array<array<double>>, roles array<int>, a double, b double")
    row = made.select(datasets.numeric_array(["a", "b"]).alias("n"), S.strength_values(F.col("m")).alias("v"), S.strength_mask(F.col("m")).alias("k"), datasets.role_means(F.col("m"), F.col("roles"), 1, 2).alias("r"), datasets.flat_array(F.array(F.lit(1.0)), F.col("m"), F.col("m")).alias("f")).first()
    assert row.n == [0.0, 2.5] and row.v[0] == [0.5, 0.0] and row.v[1] == [1.0, 0.2] and row.k[0] == [1.0, 0.0] and row.r == [150.0, 20.0] and len(row.f) == 13


def test_logistic_baseline_separates_and_falls_back(spark):
    table = spark.range(400).select((F.col("id") % 2).cast("int").alias("y_true"), F.array((F.col("id") % 2) + F.rand(1), F.rand(2)).alias("features"))
    scored = datasets.fit_logistic(table, table).withColumn("model_name", F.lit("m"))
    assert metrics.binary_metrics(scored, ["model_name"]).first().auc > 0.95
    assert {r.probability for r in datasets.fit_logistic(table.where("y_true = 1"), table).collect()} == {1.0}
    assert datasets.learning_rate("cosine", 1.0, 9, 10) == pytest.approx(0) and datasets.learning_rate("exponential", 1.0, 2, 10, 0.5) == 0.25


def test_walk_forward_calibration_covers_every_season_but_the_first(spark):
    from touchline.plans import model_queries
    from touchline.plans.fixtures import tables

    base = "/root/testdata/sf0.001"
    season = {r.match_id: r.season for r in betting.implied(tables(spark, base, "fx_predictions")).collect()}
    later = [m for m, s in season.items() if s > min(season.values())]
    got = [(r.match_id, r.method) for r in model_queries.platt_calibration(spark, base).collect()]
    assert len({season[m] for m in later}) > 2 and sorted(got) == sorted((m, x) for m in later for x in ("platt", "isotonic", "hybrid"))
