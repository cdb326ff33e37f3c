"""Form windows, tables, seasons, selection, Elo and rounds on hand-made matches."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from touchline import config as C
from touchline.operators import form, league, sequential
from touchline.plans.fixtures import tables

MATCHES = "match_id long, dt timestamp, hour_utc long, season long, competition string, round_id long, home_id long, away_id long, home_goals long, away_goals long"


def matches(spark, rows):
    """rows: (id, day, hour, home, away, home goals, away goals)"""
    return spark.createDataFrame([(i, datetime(2024, 1, d), h, 2024, "L", 1, a, b, x, y) for i, d, h, a, b, x, y in rows], MATCHES)


def test_table_places_take_one_slot_as_a_batch(spark):
    rows = form.team_matches(matches(spark, [(101, 1, 12, 1, 4, 2, 0), (102, 1, 12, 2, 3, 0, 1), (103, 2, 12, 1, 3, 0, 0)]))
    got = {(r.match_id, r.team_id): r.place01 for r in league.pre_match_places(rows).collect()}
    assert got[101, 1] == 1 and got[101, 4] == 0
    assert got[102, 2] == pytest.approx(2 / 3) and got[102, 3] == pytest.approx(1 / 3)
    assert got[103, 1] == 1 and got[103, 3] == pytest.approx(2 / 3)


def test_one_team_has_the_first_place(spark):
    rows = form.team_matches(matches(spark, [(1, 1, 12, 7, 7, 0, 0)])).where("role = 'home'")
    assert league.pre_match_places(rows).first().place01 == 1.0


def test_greedy_rounds(spark):
    rows = matches(spark, [(1, 1, 1, 1, 2, 0, 0), (2, 1, 2, 3, 4, 0, 0), (3, 1, 3, 1, 5, 0, 0), (4, 1, 4, 6, 7, 0, 0)])
    made = sequential.greedy_rounds(rows)
    assert [r.round_index for r in made.orderBy("match_id").collect()] == [0, 0, 1, 1]
    assert sequential.round_sizes(made).first().median == 2
    assert sequential.repeated_teams(made, form.team_matches(rows)).count() == 0


def test_uniform_rounds_lose_the_match_at_a_full_round(spark):
    ranked = spark.range(1, 131).select(F.col("id").alias("match_id"), F.col("id").alias("rn"), F.lit(130).alias("n"))
    got = [r.round_index for r in sequential.uniform_rounds(ranked).orderBy("match_id").collect()]
    assert len(got) == 128 and got[:50] == [0] * 50 and got[50:100] == [1] * 50 and set(got[100:]) == {2}
    short = ranked.where("rn <= 110").withColumn("n", F.lit(110))
    assert {r.round_index for r in sequential.uniform_rounds(short).collect()} == {0, 1}


def test_last_n_counts_rows_and_skips_missing(spark):
    rows = matches(spark, [(i, i, 12, 1, 2, 1, 0) for i in range(1, 5)]).withColumn("hs", F.when(F.col("match_id") == 2, -1.0).otherwise(F.col("match_id") * 1.0)).withColumn("as", F.lit(2.0))
    team = form.team_matches(rows, {"shots": "hs"}, {"shots": "as"}).where("team_id = 1")
    got = [r.x for r in team.select("match_id", form.stat_mean("own_shots", 2, 10.0).alias("x")).orderBy("match_id").collect()]
    assert got == pytest.approx([C.ALMOST_ZERO, 0.1, 0.1, 0.3])
    total = [r.x for r in team.select("match_id", form.total_mean("own_shots", "opp_shots", 2, 10.0).alias("x")).orderBy("match_id").collect()]
    assert total == pytest.approx([C.ALMOST_ZERO, 0.3, 0.3, 0.5])


def test_match_load_against_brute_force(spark):
    days = [(1, 1, 10), (2, 1, 15), (3, 8, 9), (4, 15, 9), (5, 15, 20), (6, 16, 1)]
    rows = form.team_matches(matches(spark, [(i, d, h, 1, 2, 0, 0) for i, d, h in days])).where("team_id = 1")
    got = {r.match_id: r.x for r in rows.select("match_id", (form.match_load(7) * 7).alias("x")).collect()}
    want = {i: sum((d2, h2, j) < (d, h, i) and d - d2 <= 7 for j, d2, h2 in days) for i, d, h in days}
    assert got == pytest.approx(want)


def test_previous_and_sequences(spark):
    team = form.team_matches(matches(spark, [(1, 1, 1, 1, 2, 3, 0), (2, 2, 1, 1, 2, 1, 1), (3, 3, 1, 2, 1, 0, 2)])).where("team_id = 1")
    rows = team.select("match_id", form.previous_match("gf").alias("p"), form.previous_where(F.col("gf") > F.col("ga"), "match_id").alias("won"), form.padded_sequence(F.array(F.col("gf") * 1.0), 2, 1).alias("s")).orderBy("match_id").collect()
    assert [r.p and r.p.gf for r in rows] == [None, 3, 1] and [r.won and r.won.match_id for r in rows] == [None, 1, 1]
    assert [r.s for r in rows] == [[[0.0], [0.0]], [[0.0], [3.0]], [[3.0], [1.0]]]


def plain_elo(rows):
    last, out = {}, {}
    for i, season, home, away, hg, ag in rows:
        r = []
        for t in (home, away):
            value, s = last.get(t, (C.INIT_ELO, season))
            r.append(value if s == season else C.INIT_ELO + C.ELO_SEASON_REGRESSION * (value - C.INIT_ELO))
        e = 1 / (1 + 10 ** ((r[1] - r[0]) / 400))
        got = 1 if hg > ag else 0 if hg < ag else 0.5
        last[home], last[away] = (r[0] + C.ELO_K * (got - e), season), (r[1] + C.ELO_K * ((1 - got) - (1 - e)), season)
        out[i] = tuple(r)
    return out


def test_elo_against_a_plain_loop(spark):
    rows = tables(spark, "/root/testdata/sf0.001", "fx_matches")
    got = {r.match_id: (r.home_elo, r.away_elo) for r in sequential.elo_ratings(rows).collect()}
    plain = plain_elo([(r.match_id, r.season, r.home_id, r.away_id, r.home_goals, r.away_goals) for r in rows.orderBy(*form.in_order()).collect()])
    assert got.keys() == plain.keys() and all(got[i] == pytest.approx(plain[i]) for i in got)


@pytest.mark.parametrize(("block", "n"), [(1, 60), (7, 400), (100, 1500), (1 << 20, 1500)])
def test_greedy_rounds_against_a_plain_loop(spark, block, n):
    rows = tables(spark, "/root/testdata/sf0.001", "fx_matches").orderBy("match_id").limit(n)
    got = {r.match_id: r.round_index for r in sequential.greedy_rounds(rows, block).collect()}
    assert len(got) == rows.count()
    index, playing = 0, set()
    for r in rows.orderBy(*form.in_order()).collect():
        if {r.home_id, r.away_id} & playing:
            index, playing = index + 1, set()
        playing |= {r.home_id, r.away_id}
        assert got[r.match_id] == index


def test_greedy_rounds_keep_a_block_whole_where_a_join_is_replanned(spark):
    rows = tables(spark, "/root/testdata/sf0.001", "fx_matches")
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}  # as large tables have it
    before = {k: spark.conf.get(k, None) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        parted = {r.match_id: r.round_index for r in sequential.greedy_rounds(rows, 400).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert parted == {r.match_id: r.round_index for r in sequential.greedy_rounds(rows).collect()}


def test_rounds_and_ratings_of_odd_tables(spark):
    assert sequential.greedy_rounds(matches(spark, [])).count() == 0 and sequential.elo_ratings(matches(spark, [])).count() == 0
    far = matches(spark, [(i, 1 + i, 1, 2 * i, 2 * i + 1, 0, 0) for i in range(12)])  # no team plays twice: one round over all blocks
    assert {r.round_index for r in sequential.greedy_rounds(far, 4).collect()} == {0}
    undated = matches(spark, [(1, 1, 1, 1, 2, 0, 0), (2, 2, 1, 1, 2, 0, 0)]).withColumn("dt", F.when(F.col("match_id") == 1, F.col("dt")))
    assert {r.match_id: r.round_index for r in sequential.greedy_rounds(undated).collect()} == {2: 0, 1: 1}


def test_dense_ids_in_order(spark):
    names = spark.createDataFrame([(x,) for x in ["b", "abd", "abc", "", "a", "Z", None, "abc", "é"]], "v string")
    assert [r.value for r in league.dense_ids(names, "v").orderBy("dense_id").collect()] == ["", "Z", "a", "abc", "abd", "b", "é"]
    numbers = spark.createDataFrame([(x,) for x in [9, -5, 10**12, 4096, 4095, 9, None]], "v long")
    assert [(r.value, r.dense_id) for r in league.dense_ids(numbers, "v").orderBy("dense_id").collect()] == [(-5, 0), (9, 1), (4095, 2), (4096, 3), (10**12, 4)]


def test_folds_and_their_chronology(spark):
    rounds = spark.createDataFrame([(i, i // 2) for i in range(12)], "match_id long, round_index long")
    made = sequential.rolling_folds(rounds, 3)
    assert {(r.fold, r.part): r["count"] for r in made.groupBy("fold", "part").count().collect()} == {(f, p): n for f in (3, 4, 5) for p, n in (("training", 6), ("validation", 2))}
    dated = rounds.select("match_id", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(if(match_id = 0, 99, match_id) as int))").alias("dt"))
    assert [r.fold for r in sequential.chronology_faults(made, dated).collect()] == [3]
    assert sequential.spaced_folds(30, 25, 3) == [25, 27, 29] and sequential.spaced_folds(30, 25, 99) == [25, 26, 27, 28, 29]


def test_selection_and_inferred_rounds(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), 1, 2024, "A", 5, 1, 2, 0, 0), (2, datetime(2024, 1, 2), 1, 2024, "A", 6, 1, 2, 0, 0), (3, datetime(2024, 1, 2), 1, 2024, "B", 7, 1, 2, 0, 0), (4, datetime(2026, 1, 2), 1, 2026, "A", 5, 1, 2, 0, 0)], MATCHES)
    config = C.Selection(("A", "B"), 2023, 2025, (("B", 2024),), {("A", 2024): (5,)})
    assert [r.match_id for r in league.select_matches(rows, config).collect()] == [1]
    assert sorted(r.match_id for r in league.select_matches(rows, config, with_rounds=False).collect()) == [1, 2]
    first = {(r.competition, r.season): r.round_id for r in league.first_rounds(rows, league.round_table(spark, config)).collect()}
    assert first == {("B", 2024): 7, ("A", 2026): 5}
    with pytest.raises(ValueError):
        C.Selection((), 2024, 2024)


def test_projected_end_of_a_leap_day(spark):
    row = spark.range(1).select(league.projected_end(F.lit(date(2024, 2, 29)), F.lit(2024), 7).alias("x"), league.projected_end(F.lit(date(2024, 10, 3)), F.lit(2024), 7).alias("y")).first()
    assert row.x == date(2025, 2, 28) and row.y == date(2024, 10, 3)
