"""Steps that must not grow with rows made of a match or asked of a player: what they leave out, and the shuffles of their plans."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline import config as C
from touchline.operators import datasets, features, form, imputation, ratings, reports, validation
from touchline.operators.sequential import EloTable
from touchline.plans import fixtures, ingest_queries, legacy_queries, model_queries, training_queries
from touchline.streaming import live

D = "/root/testdata/sf0.001"


def shuffles(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x or "REPARTITION" in x]


def test_cells_are_made_for_rounds_of_the_folds_alone(spark):
    folds = spark.createDataFrame([(26,)], "fold long")
    got = training_queries.cells(spark, D, folds)
    assert {r[0] for r in got.select("round_index").distinct().collect()} == {r.round_index for r in imputation.fold_rounds(folds, training_queries.WINDOW).collect()} == set(range(1, 27))


@pytest.fixture
def asked(spark):
    day = datetime.date(2022, 1, 1)
    snaps = [(p, day - datetime.timedelta(days=k), s, float(p + k + s) if (p + k + s) % 3 else -1.0) for p in range(4) for k in range(0, 9, 2) for s in range(2)]
    snaps = spark.createDataFrame(snaps, "player_id long, snap_date date, skill_no long, skill double")
    looks = spark.createDataFrame([(m, m % 5, day - datetime.timedelta(days=m % 3)) for m in range(60)], "match_id long, player_id long, day date")
    return looks, snaps


def test_skills_are_filled_once_for_a_day_of_a_player(asked):
    looks, snaps = asked
    key = ["match_id", "skill_no"]
    want = ratings.filled_skills(ratings.past_snapshots(looks, snaps, key), key)
    got = ratings.filled_lookups(looks, snaps)
    columns = [*key, "value", "snap_date", "age", "provenance"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect()) and got.count() > 60
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString() and not shuffles(got)


def test_lookups_with_snapshots_are_not_shuffled(asked):
    looks, snaps = asked
    for made in (ratings.past_snapshots, ratings.past_then_future_snapshots):
        assert not shuffles(made(looks, snaps, ["match_id"]))


def test_counts_of_cells_are_those_of_matrices(spark):
    nan, inf = float("nan"), float("inf")
    sides = {(1, 0): [[1.0, 2.0], [-1.0, None]], (1, 1): [[1.0, 2.0]], (2, 0): [[-1.0, nan], [inf, -1.0]], (2, 1): [[-1.0, -2.0], [3.0, 4.0]], (3, 0): [[1.0, 2.0], [1.0]]}
    matrices = spark.createDataFrame([(*k, m) for k, m in sides.items()], "match_id long, side int, matrix array<array<double>>")
    cells = spark.createDataFrame([(*k, i, j, x) for k, m in sides.items() for i, r in enumerate(m) for j, x in enumerate(r)], "match_id long, side int, slot int, skill_no int, value double")
    want, got = validation.matrix_counts(matrices, (2, 2)), validation.cell_counts(cells, (2, 2))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.where("ok").count() == 3
    rates = [sorted(reports.missing_skill_rates(x.withColumn("competition", F.lit("A")), (2, 2)).collect(), key=str) for x in (matrices, got)]
    assert rates[0] == rates[1]


def test_lineup_rules_in_one_pass(spark):
    lineups = spark.createDataFrame([(1, 0, 6), (1, 0, 6), (1, None, 6), (2, 0, 5), (2, 1, 5)], "match_id long, side long, player_id long")
    found = validation.lineup_rules(lineups, spark.createDataFrame([(5,)], "player_id long"))
    assert {(r.code, r.entity_id, r.n) for r in found.collect()} == {
        ("duplicate_home_lineup_player", "1", 1), ("unknown_home_lineup_player", "1", 3), ("unknown_away_lineup_player", "1", 1), ("player_in_both_lineups", "2", 1)
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # line-ups and players are read once


def test_queries_shuffle_matches_instead_of_what_is_made_of_them(spark):
    counts = validation.cell_counts(fixtures.tables(spark, D, "fx_cells", fx_matches=fixtures.by_match(spark, D)), (11, 4))
    assert len(shuffles(counts)) == 1 and "Cartesian" not in counts._jdf.queryExecution().executedPlan().toString()
    filled = model_queries.skill_fill(spark, D)
    assert len(shuffles(filled)) == 1
    lineups = ingest_queries.raw(spark, D)["lineups"]
    assert len(shuffles(lineups)) == 1
    made = legacy_queries.older_matrices(spark, D)
    assert len([x for x in shuffles(made) if "match_id" in x]) == 2  # matches for line-ups, and again for teams


def test_equal_rows_are_fitted_once(spark):
    rows = [(1000 * s + i, 2000 + s, i * 7 % 3 > 0, (i % 10 + 1) / 12, (i % 7 + 1) / 9) for s in range(3) for i in range(600)]
    df = spark.createDataFrame(rows, "match_id long, season long, y boolean, probability double, fair_under double").withColumn("y_true", F.col("y").cast("int"))
    assert datasets.grouped(df, ["season", "probability", "y_true"]).count() == 60
    pair = [x.withColumn("features", F.array("probability", "fair_under")) for x in (df.where("season < 2002"), df.where("season = 2002"))]
    kept = [x.withColumnRenamed("probability", "_raw") for x in (datasets.grouped(pair[0], ["features", "probability", "fair_under", "y_true"]), pair[1], pair[0])]
    for c in (1.0, 1e9):
        got, want = ({r.match_id: r.probability for r in fit.collect()} for fit in (datasets.fit_weighted(kept[0], kept[1], c=c), datasets.fit_logistic(kept[2], kept[1], c=c)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_competition_is_packed_and_rated_in_batches(spark, tmp_path):
    frames = [pd.DataFrame({"a": [1, 300], "b": [1.5, None], "dt": pd.to_datetime(["2022-01-02", "2022-01-01"]), "s": ["x", "y"]}), pd.DataFrame({"a": [7], "b": [2.0], "dt": pd.to_datetime(["2022-01-03"]), "s": ["z"]})]
    held = live.packed(iter(frames), ["a", "b", "dt"])
    assert {k: v.dtype.str for k, v in held.items()} == {"a": "<i2", "b": "<f8", "dt": "<M8[us]"} and held["a"].tolist() == [1, 300, 7]
    rows = [("A", m, 2020 + m // 20, datetime.datetime(2022, 1, 1) + datetime.timedelta(days=(m * 7) % 40), None if m % 5 == 0 else m % 3, m % 4, (m + 1) % 4, m % 3, m % 2) for m in range(40)]
    df = spark.createDataFrame(rows, "competition string, match_id long, season long, dt timestamp, hour_utc long, home_id long, away_id long, home_goals long, away_goals long")
    df.write.parquet(str(tmp_path / "in"))
    query = live.rated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), batch=7).writeStream.format("memory").queryName("rated_in_batches").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    table, want = EloTable(), {}
    for _, m, season, dt, hour, *x in sorted(rows, key=lambda r: (r[3], -1 if r[4] is None else r[4], r[1])):
        want[m] = table.play(season, *x)[:2]
    assert {r.match_id: (r.home_elo, r.away_elo) for r in spark.table("rated_in_batches").collect()} == want


def test_a_trial_run_writes_the_rounds_of_its_folds(spark):
    data = training_queries.trial_rows(spark, D)
    assert data.agg(F.max("round_index")).first()[0] == training_queries.WINDOW + training_queries.TRIAL - 1 and len(data.inputFiles()) > 0


def odd_matches(spark):
    """Matches of few teams, with repeated rows, unknown days, hours and statistics, many on one day, and teams that change sides."""
    day = datetime.datetime(2022, 1, 1)
    rows = [(m, None if m % 23 == 0 else day + datetime.timedelta(days=m * m % 29), None if m % 6 == 0 else m % 5, 2021 + m % 2, "AB"[m % 2], m % 4, (m + 1 + m % 3) % 4, m % 4, m * 7 % 3) for m in range(150)]
    rows += [r for r in rows if r[0] % 10 == 3]
    df = spark.createDataFrame(rows, "match_id long, dt timestamp, hour_utc long, season long, competition string, home_id long, away_id long, home_goals long, away_goals long")
    for i, x in enumerate(features.SIDE_STATS):
        for j, side in enumerate(("home", "away")):
            value = F.when(F.col("match_id") % 7 == i % 7, None).when(F.col("match_id") % 11 == j, -1.0).when((F.col("match_id") == 60) & (F.col("match_id") % 3 == i % 3), float("nan"))
            df = df.withColumn(f"{side}_{x}", value.otherwise((F.col("match_id") * (i + 3) % 17) / 3.0))
    return df


def test_form_in_batches_is_that_of_windows(spark):
    names = {x: (f"home_{x}", f"away_{x}") for x in features.SIDE_STATS}
    sides = form.team_matches(odd_matches(spark).where("match_id % 10 <> 3"), {k: v[0] for k, v in names.items()}, {k: v[1] for k, v in names.items()})
    want = {}
    stats = [form.stat_mean(f"own_{x}", n, C.SCALES[s]) for x, s in features.SIDE_STATS.items() for n in features.LAST]
    stats += [form.total_mean(f"own_{x}", f"opp_{x}", n, C.SCALES[s]) for x, s in features.TOTAL_STATS.items() for n in features.LAST]
    stats += [make(n) for make in (form.points_mean, form.goals_mean) for n in features.LAST] + [form.role_goals(n)[i] for i in (0, 1) for n in features.LAST]
    stats += [form.match_load(n, C.SCALES["load"]) for n in features.LOAD_DAYS]
    for r in sides.select("match_id", "role", F.array(*stats).alias("x")).collect():
        want[r.match_id, features.FORM + (r.role == "away")] = r.x
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r.match_id, r.part): r["values"] for r in features.history(sides, features.FORM, True, features.LOAD_DAYS).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_load_runs_on_over_a_day_of_many_matches(spark):
    day = datetime.datetime(2022, 1, 1)
    rows = [(m, None if m < 3 else day + datetime.timedelta(days=m // 20 * 3), None if m % 6 == 0 else m % 5, m % 2) for m in range(200)]
    df = spark.createDataFrame(rows, "match_id long, dt timestamp, hour_utc long, team_id long")
    made = df.select("match_id", (form.match_load(7) * 7).alias("x"))
    assert "unboundedfollowing" not in made._jdf.queryExecution().analyzed().toString().lower()  # Spark reads such a frame anew for each row
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or day, -1 if r[2] is None else r[2], r[0]))
    want = {}
    for i, (m, d, _, team) in enumerate(ordered):
        earlier = [r[1] for r in ordered[:i] if r[3] == team]
        want[m] = sum((x is None) if d is None else (x is not None and (d - x).days <= 7) for x in earlier)
    assert {r.match_id: round(r.x) for r in made.collect()} == want


def test_features_deal_out_each_side_once_by_team_and_once_by_match(spark):
    table = fixtures.tables(spark, D, "fx_full_stats")
    plan = features.match_features(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "avg(" not in plan and "max(CASE" not in plan
    wide = [x for x in shuffles(features.match_features(table)) if "REPARTITION" in x]
    assert len(wide) == 3  # sides by team, competitions for ratings, parts by match


def test_features_of_repeated_rows_and_of_load_from_other_matches(spark):
    df = odd_matches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.match_id: r for r in features.match_features(df, digits=6).collect()}
        busy = df.unionByName(df.withColumn("match_id", F.col("match_id") + 1000))
        apart = {r.match_id: r for r in features.match_features(df, busy.where("match_id <> 5")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == apart.keys() == set(range(150))
    assert all(r[x] is not None for r in got.values() for x in features.feature_names())
    rows = form.team_matches(busy.where("match_id <> 5"))
    load = {}
    for r in rows.select("match_id", "role", form.match_load(10, C.SCALES["load"]).alias("x")).collect():
        load[r.match_id, r.role] = max(r.x, load.get((r.match_id, r.role), 0))
    once = [m for m in range(150) if m % 10 != 3]
    assert apart[5].home_load_10 == apart[5].away_load_25 == C.ALMOST_ZERO
    assert all(apart[m].home_load_10 == load[m, "home"] and apart[m].away_load_10 == load[m, "away"] for m in once if m != 5)
    assert all(abs(got[m][x] - apart[m][x]) <= 5.1e-7 for m in once for x in features.feature_names() if "load" not in x)
