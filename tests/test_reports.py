"""Report and eligibility operators on nulls, ties and empty tables."""

import datetime

from pyspark.sql import functions as F

from touchline.operators import betting, reports


def test_eligibility_and_names(spark):
    day = datetime.datetime(2022, 1, 1)
    rows = [(1, day, "A", 2022, "A-1", 5), (2, None, "A", 2022, "A-1", 5), (3, day, "A", 2022, "B-1", 5), (4, day, "A", 2022, "A-1", None), (5, day, None, 2022, "A-1", 5), (6, day, "A", 2030, "A-1", 5), (1, day, "A", 2022, "A-1", 5)]
    matches = spark.createDataFrame(rows, "match_id long, dt timestamp, competition string, season long, comp_season_id string, round_id long")
    seasons = spark.createDataFrame([("A", 2022, "A-1"), ("A", 2022, "A-1"), ("A", 2030, "A-1")], "competition string, season long, comp_season_id string")
    rounds = spark.createDataFrame([("A", 2022, 5), ("A", 2022, 5), ("A", 2030, 5)], "competition string, season long, round_id long")
    assert [r.match_id for r in reports.table_matches(matches, seasons, rounds).collect()] == [1, 1]
    assert reports.table_matches(matches.limit(0), seasons, rounds).count() == 0
    assert {(r.competition, r.season, r.matches) for r in reports.seasons_without_rounds(matches, rounds).collect()} == {(None, 2022, 1)}
    names = spark.createDataFrame([("Regular Season - 3", " ", None), ("PLAY-OFFS", "Bo", "Bob"), (None, None, "C")], "a string, b string, c string")
    got = names.select(reports.round_group(F.col("a"), ("regular", "play")).alias("g"), reports.is_regular(F.col("a"), ("Regular",)).alias("r"), reports.display_name(F.col("b"), F.col("c")).alias("d"), reports.backfilled(F.col("b"), F.col("c")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("regular", True, None, None), ("play", False, "Bo", "Bo"), (None, False, "C", "C")]


def test_repairs_and_means(spark):
    rows = spark.createDataFrame([(1, -1.0), (1, 2.0), (2, -1.0), (2, None)], "b long, x double")
    assert sorted((r.b, r.x is None, r.x or 0) for r in reports.zero_filled(rows, ["b"], ["x"]).collect()) == [(1, False, 0), (1, False, 2.0), (2, False, -1.0), (2, True, 0)]
    series = spark.createDataFrame([("a", i, float(i * i)) for i in range(5)] + [("b", 0, 7.0)], "k string, i long, v double")
    got = {(r.k, r.i): r.m for r in series.select("k", "i", reports.shortened_mean(F.col("v"), F.col("i"), 3, "k").alias("m")).collect()}
    assert got["b", 0] == 7.0 and got["a", 0] == 0.5 and got["a", 2] == (1 + 4 + 9) / 3


def test_first_simulation_without_bets(spark):
    best = spark.createDataFrame([(1, 0.01, 1, 0.5)], "match_id long, edge double, won int, profit double")
    got = {r.threshold: r for r in betting.first_simulation(best, (0.0, 0.5), "match_id").collect()}
    assert (got[0.0].num_bets, got[0.0].hit_rate, got[0.0].coverage) == (1, 1.0, 1.0) and (got[0.5].num_bets, got[0.5].roi, got[0.5].max_drawdown) == (0, 0.0, 0.0)
    assert [r.drawdown for r in betting.ledger(best, 0.0, "match_id").collect()] == [0.0]
