"""As-of lookups, line-ups, imputation and entity resolution."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions import scalars as S
from touchline.functions.similarity import all_ratios, indel_ratio, two_best
from touchline.operators import ratings, resolve

D = date
SNAPS = [(1, D(2024, 1, 11), [99.0] * 4), (1, D(2024, 1, 9), [10.0, -1.0, None, 40.0]), (1, D(2024, 1, 8), [11.0, 20.0, 30.0, 41.0]), (1, D(2023, 10, 1), [1.0] * 4)]


def snapshots(spark):
    rows = spark.createDataFrame([(p, d, s, 1) for p, d, s in SNAPS], "player_id long, snap_date date, skills array<double>, line long")
    return ratings.skill_rows(rows)


def lookups(spark):
    return spark.createDataFrame([(7, 1, D(2024, 1, 10))], "match_id long, player_id long, day date")


def test_past_candidates_and_filled_skills(spark):
    got = ratings.past_snapshots(lookups(spark), snapshots(spark), ["match_id"], 30, 3)
    assert sorted({(r.snap_date, r.age, r.nth) for r in got.collect()}) == [(D(2024, 1, 8), 2, 2), (D(2024, 1, 9), 1, 1)]
    filled = ratings.filled_skills(got, ["match_id", "skill_no"]).orderBy("skill_no").collect()
    assert [r.value for r in filled] == [10, 20, 30, 40] and [r.provenance for r in filled] == [1, 2, 2, 1]
    assert [r.snap_date.day for r in filled] == [9, 8, 8, 9]


def test_past_then_future_order(spark):
    got = ratings.past_then_future_snapshots(lookups(spark), snapshots(spark).where("skill_no = 0"), ["match_id"], 30, 3)
    assert [r.snap_date.day for r in got.orderBy("nth").collect()] == [9, 8, 11]


def test_as_of_buckets_against_brute_force(spark):
    asked = spark.range(300).select(F.col("id").alias("match_id"), (F.col("id") % 3).alias("player_id"), F.date_add(F.lit(D(2024, 1, 1)), (F.col("id") * 7 % 400).cast("int")).alias("day"))
    dated = spark.range(200).select((F.col("id") % 3).alias("player_id"), F.date_add(F.lit(D(2023, 12, 1)), (F.col("id") * 11 % 420).cast("int")).alias("snap_date"), F.col("id").cast("double").alias("skill"))
    got = {(r.match_id, r.snap_date) for r in ratings.past_snapshots(asked, dated, ["match_id"], 50, 10**6).collect()}
    left, right = asked.collect(), dated.collect()
    assert got == {(a.match_id, b.snap_date) for a in left for b in right if a.player_id == b.player_id and 0 <= (a.day - b.snap_date).days <= 50}


def test_as_of_queries_look_up_every_lineup_row(spark):
    """All line-up rows against brute force in Python."""
    from touchline.plans import model_queries
    from touchline.plans.fixtures import tables

    base = "/root/testdata/sf0.001"
    last = {}
    for r in tables(spark, base, "fx_snapshots").collect():
        last[r.player_id, r.snap_date] = max((r.event_id, r.skill), last.get((r.player_id, r.snap_date), (-1, 0.0)))
    first, own = min(d for _, d in last), {}
    for (p, d), (_, skill) in last.items():
        own.setdefault(p, []).append((d, skill))
    past, both, filled = set(), set(), {}
    for r in tables(spark, base, "fx_lineups").collect():
        day = first + timedelta(days=r.match_id % 40)
        ages = sorted(((day - d).days, d, skill) for d, skill in own.get(r.player_id, ()))
        key = (r.match_id, r.side, r.slot)
        near = [x for x in ages if 0 <= x[0] <= 120][:6]
        past |= {(*key, r.player_id, d, age, n) for n, (age, d, _) in enumerate(near, 1)}
        sides = sorted((x for x in ages if abs(x[0]) <= 20), key=lambda x: (x[0] < 0, abs(x[0])))[:6]
        both |= {(*key, r.player_id, d, age, n) for n, (age, d, _) in enumerate(sides, 1)}
        seen = [(round(skill, 6), d, age) for age, d, skill in near if skill >= 0]
        if seen:
            filled[key] = seen[0]
    assert past and both and filled
    for name, want in (("asof_past", past), ("asof_past_future", both), ("skill_fill", {(*k, *v) for k, v in filled.items()})):
        got = [tuple(r) for r in model_queries.QUERIES[name](spark, base).collect()]
        assert len(got) == len(want) and set(got) == want, name


def lineup(spark, positions):
    return spark.createDataFrame([([(i, p) for i, p in enumerate(positions)],)], "l array<struct<player_id:bigint,position:string>>")


def test_lineup_without_a_goalkeeper(spark):
    row = lineup(spark, ["Forward", "Defender", "Midfielder"]).select(ratings.ordered_lineup(F.col("l")).alias("x")).first().x
    assert [r.position for r in row] == ["Goalkeeper", "Defender", "Midfielder", "Forward"] + ["Unknown"] * 7
    assert [r["index"] for r in row] == [0, 1, 2, 3, *[4] * 7] and row[0].player_id is None and row[1].player_id == 1


def test_full_lineup_without_a_goalkeeper_drops_its_last(spark):
    row = lineup(spark, ["Forward"] * 2 + ["Defender"] * 9).select(ratings.ordered_lineup(F.col("l")).alias("x")).first().x
    assert len(row) == 11 and [r.player_id for r in row] == [None, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0]


def test_goalkeeper_row_rules(spark):
    def rows(*scores, label=None):
        made = [("Goalkeeper" if i == label else "Defender", [10.0] * 29 + [10.0 + s] * 5) for i, s in enumerate(scores)]
        return spark.createDataFrame([(made,)], "r array<struct<position:string,skills:array<double>>>").select(ratings.goalkeeper_first(F.col("r")).alias("x")).first().x

    assert rows(5, 9, label=0)[0].skills[33] == 15 and rows(1, 9, 3)[0].skills[33] == 19
    assert len(rows(0, 0.4)) == 3 and rows(0, 0.4)[0].skills == [-1.0] * 34


def test_imputation_chain(spark):
    train = [("A", "M", 10.0)] * 2 + [("B", "M", 40.0), ("B", "M", 60.0)] + [("A", "D", 99.0)]
    cells = spark.createDataFrame([(0, c, p, 0, v, 1) for c, p, v in train], "fold long, competition string, position string, skill_no int, value double, provenance int")
    config = C.Imputation(2, 4, 1)
    asked = spark.createDataFrame([(0, "A", "M", 0, -1.0, 0), (0, "C", "M", 0, -1.0, 0), (0, "C", "D", 0, -1.0, 0), (0, "C", "D", 1, -1.0, 0), (0, "A", "M", 0, 33.0, 1)], cells.schema)
    got = sorted((r.provenance, r.value, r.observed) for r in ratings.imputed(asked, ratings.skill_medians(cells, config)).collect())
    assert got == [(1, 33.0, 1), (3, 10.0, 0), (4, 25.0, 0), (5, 40.0, 0), (6, 50.0, 0)]


def test_team_strength_pads(spark):
    lineups = spark.createDataFrame([(1, 0, 0, 50, D(2024, 1, 10)), (1, 0, 1, 51, D(2024, 1, 10))], "match_id long, side int, slot long, player_id long, day date")
    mapped = spark.createDataFrame([(50, 1), (51, -1)], "listed_id long, player_id long")
    matrix = ratings.team_strength(lineups, mapped, snapshots(spark)).first().matrix
    assert len(matrix) == 11 and all(len(r) == 34 for r in matrix)
    assert matrix[0][:5] == [10.0, 20.0, 30.0, 40.0, -1.0] and set(matrix[1]) == {-1.0}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("", ""), ("a", ""), ("manchester utd", "manchester united"), ("abcabc", "acbbca"), ("x" * 80, "xy" * 50)])
def test_indel_ratio(a, b):
    want = 100.0 if not a and not b else 200 * plain_lcs(a, b) / (len(a) + len(b))
    assert indel_ratio(a, b) == pytest.approx(want)


def test_names_in_blocks_are_scored_as_pairs_are():
    names = ["", "a", "ab", "aab", "ab c", "b a", "élan", "a\0", "x" * 64, "x" * 70, "y" * 300]
    got = all_ratios(names, names)
    assert all(got[i, j] == indel_ratio(b, a) for i, a in enumerate(names) for j, b in enumerate(names))
    best, least, second = two_best([["ab", "zz"], ["b a"]], [["ab"], ["ab", "b"], ["q"]], np.array([7, 5, 1]), np.array([1, 1, 2]))
    assert list(best) == [100.0, indel_ratio("b", "b a")] and list(least) == [5, 5] and list(second) == [100.0, indel_ratio("ab", "b a")]
    assert two_best([["ab"]], [["q"]], np.array([3]), np.array([1]))[2][0] == -1


def test_players_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PLAYER_BLOCK", 3)
    monkeypatch.setattr(resolve, "RATED_BLOCK", 4)
    name = lambda x: f"n{x * 37 % 101} {x % 7}"
    players = spark.createDataFrame([(i, i % 2, [name(i)]) for i in range(40)], "player_id long, block_key long, names array<string>")
    rated = spark.createDataFrame([(i, i % 2, [name(3 * i)]) for i in range(50)] + [(90, 1, [name(3)])], "rated_id long, block_key long, names array<string>")
    got = {r.player_id: (r.best, r.rated_id, r.second) for r in resolve.best_names(players, rated).collect()}
    for i in range(40):
        scores = sorted((-indel_ratio(name(i), name(3 * j)), j) for j in range(50) if j % 2 == i % 2)
        if i % 2:
            scores = sorted([*scores, (-indel_ratio(name(i), name(3)), 90)])
        assert got[i] == (-scores[0][0], scores[0][1], -scores[1][0])


def test_team_matching_with_override(spark):
    teams = spark.createDataFrame([(1, "Anything", 9), (2, "Manchester Utd", 9), (3, "Lost", 8)], "team_id long, name string, league_id long")
    clubs = spark.createDataFrame([(200, "Manchester United", 9), (201, "Liverpool", 9)], "club_id long, name string, league_id long")
    assert {r.team_id: r.club_id for r in resolve.match_teams(teams, clubs, {1: -1}).collect()} == {1: -1, 2: 200, 3: -1}


def test_player_cascade_does_not_fall_through(spark):
    day = D(1990, 1, 1)
    players = spark.createDataFrame([(1, "J Smith", "John Smith", day, 5), (2, "Zed", "Zed Quux", day, 6), (3, "Al Jones", "Alan Jones", None, None), (4, "No One", "No Onne", None, None)], "player_id long, name string, full_name string, dob date, club_id long")
    rated = spark.createDataFrame([(10, "John Smith", "John Smith", day, 5), (11, "Bo", "Bo Li", day, 6), (12, "Zed Quux", "Zed Quux", D(1991, 1, 1), 6), (13, "Alan Jones", "Alan Jones", D(1980, 1, 1), 1)], "rated_id long, r_name string, r_full_name string, r_dob date, r_club_id long")
    got = {r.player_id: r for r in resolve.match_players(players, rated).collect()}
    assert (got[1].rated_id, got[1].reason, got[1].second, got[1].used_dob) == (10, "team_and_dob_pass", -1.0, True)
    assert (got[2].rated_id, got[2].reason) == (None, "team_and_dob_fail")
    assert (got[3].rated_id, got[3].reason) == (13, "name_bucket_pass") and got[4].reason == "no_candidates"


def test_all_of_a_name_bucket_are_candidates(spark):
    first = lambda i: "a" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    players = spark.createDataFrame([(1, f"{first(449)} smith", f"{first(449)} smith", None, None)], "player_id long, name string, full_name string, dob date, club_id long")
    rated = spark.createDataFrame([(i, f"{first(i)} smith", f"{first(i)} smith", D(1980, 1, 1), 1) for i in range(450)], "rated_id long, r_name string, r_full_name string, r_dob date, r_club_id long")
    found = resolve.match_players(players, rated).first()
    scores = sorted(indel_ratio(f"{first(449)} smith", f"{first(i)} smith") for i in range(450))
    assert (found.rated_id, found.best, found.second, found.reason) == (449, 100.0, scores[-2], "name_bucket_pass")
    assert resolve.candidates(players, rated).count() == 450


def test_name_keys(spark):
    row = spark.createDataFrame([("O'Neil-Smith, J.", "X")], "a string, b string").select(S.plain_name(F.col("a")).alias("p"), S.name_key(S.plain_name(F.col("a"))).alias("k"), S.name_key(S.plain_name(F.col("b"))).alias("n")).first()
    assert (row.p, row.k, row.n) == ("o neil smith j", None, None)
