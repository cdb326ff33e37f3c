"""The older feed's strength against plain Python over lists."""

import datetime
import difflib
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.operators import older_strength as O
from touchline.plans import legacy_queries

WIDTH = 34
NAMES = ["Élan Özil", "Müller-Lüdenscheidt", "St. Étienne FC", "", None, "Ørsted", "AC  Milan", "ac milan", "İstanbul", "Ｆｕｌｌ"]


def plain_name(x):
    x = unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub(r"[^a-z0-9\s]", "", x).split())


def test_names_and_feed_teams(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i long, n string")
    assert {r.i: r.x for r in rows.select("i", O.ascii_name(F.col("n")).alias("x")).collect()} == {i: plain_name(n) for i, n in enumerate(NAMES)}
    teams = [(i, n, "A" if i % 2 else "B", 2021) for i, n in enumerate(NAMES)]
    known = [(50 + i, n, c, 2021) for i, n in enumerate(["Elan Ozil", "Saint Etienne", "Milan AC", "Milan AC", "zzz"]) for c in "AB"]
    got = {r.team_id: (r.known_id, r.score) for r in O.match_feed_teams(spark.createDataFrame(teams, "team_id long, name string, competition string, season long"), spark.createDataFrame(known, "known_id long, known_name string, competition string, season long")).collect()}
    for i, n, _, _ in teams:
        scores = {k: difflib.SequenceMatcher(None, plain_name(n), plain_name(m)).ratio() for k, m, c, _ in known if c == "A"}
        best = min(scores, key=lambda k: (-scores[k], k))
        assert got[i] == ((best, scores[best]) if scores[best] > 0 else (None, None))


def test_match_by_birthday(spark):
    day = datetime.date(1990, 1, 1)
    players = spark.createDataFrame([(1, "Élan", "Élan Ozil", day), (2, "Xyz", None, day), (3, "Bo", "Bo", datetime.date(1991, 1, 1)), (4, "Bo", "Bo", None)], "player_id long, name string, full_name string, dob date")
    rated = spark.createDataFrame([(10, "E. Ozil", "Elan Ozil", day), (9, "Elan Ozil", "x", day), (11, "Bo", "Bo", None)], "rated_id long, r_name string, r_full_name string, dob date")
    assert {r.player_id: (r.rated_id, r.reason) for r in O.match_by_birthday(players, rated).collect()} == {1: (9, "matched"), 2: (None, "rejected"), 3: (None, "no_birthday"), 4: (None, "no_birthday")}


def averages_of(spark, width=WIDTH):
    rows = [(s, t, r, [0.0 if (r == "goalkeeper" and t == 2) else float(100 * t + 10 * k + (i % 3)) for i in range(width)]) for s, t in ((2021, 1), (2021, 2), (2024, 948)) for k, r in enumerate(O.ROLES.values())]
    rows.append((-1, -1, "goalkeeper", [7.0] * width))
    return rows, spark.createDataFrame(rows, "season long, team_id long, role string, skills array<double>")


def plain_average(rows, season, team, role):
    found = {(s, t, r): x for s, t, r, x in rows}
    got = found.get((season, team, role), found[2024, 948, role])
    return found[-1, -1, "goalkeeper"] if role == "goalkeeper" and not any(got) else got


def test_nearest_skills(spark):
    rng = random.Random(3)
    plain, averages = averages_of(spark, 4)
    start = datetime.date(2021, 1, 1)
    snaps = [(p, start + datetime.timedelta(days=rng.randint(0, 700)), [rng.choice([-1.0, -1.0, 5.0, 60.0]) for _ in range(4)], rng.choice([["CDM"], ["GK"], ["ST", "CAM"], ["CB", "CM"]])) for p in range(6) for _ in range(rng.randint(1, 6))]
    snaps = list({(p, d): (p, d, s, q) for p, d, s, q in snaps}.values())
    asked = [(i, rng.randint(0, 7), start + datetime.timedelta(days=rng.randint(0, 900)), 2021, rng.choice([1, 2, 3]), rng.choice(list(O.ROLES))) for i in range(60)]
    lookups = spark.createDataFrame(asked, "look long, player_id long, day date, season long, team_id long, position string")
    snapshots = spark.createDataFrame(snaps, "player_id long, snap_date date, skills array<double>, positions array<string>")
    got = {r.look: (r.skills, r.source) for r in O.nearest_skills(lookups, snapshots, averages, ["look"], 4).collect()}
    for look, p, day, season, team, position in asked:
        near = sorted((abs((d - day).days), d, s, q) for x, d, s, q in snaps if x == p and abs((d - day).days) < 270)
        if not near:
            assert got[look] == (plain_average(plain, season, team, O.ROLES[position]), "imitated")
            continue
        values = [next((s[i] for _, _, s, _ in near if s[i] != -1), None) for i in range(4)]
        roles = [r for _, _, _, q in near for r in O.ROLES.values() if any(r in O.POSITION_ROLES[x] for x in q)]
        top = Counter(roles).most_common(1)[0][0]
        full = [plain_average(plain, season, team, top)[i] if v is None else v for i, v in enumerate(values)]
        assert got[look] == (full, "filled" if None in values else "observed")


def plain_matrix(plain, season, team, players):
    average = lambda p: plain_average(plain, season, team, O.ROLES[p])
    four = [average(p) for p, n in (("Goalkeeper", 1), ("Defender", 4), ("Midfielder", 4), ("Forward", 2)) for _ in range(n)]
    if not players:
        return four
    some = [x for x in sorted(players, key=lambda p: {"Goalkeeper": 0, "Defender": 1, "Midfielder": 2, "Forward": 3}.get(p[0], 4)) if x[1] is not None]
    rows, have = [list(s) for _, s in some], Counter(p for p, _ in some)
    order = sorted(O.PLACES, key=lambda p: O.EXPECTED.get(p, 0) - have[p], reverse=True)
    order = [p for p in order if p != "Goalkeeper" or not have["Goalkeeper"]]
    step = 0
    while len(rows) < 11:
        name = order[step % len(order)]
        rows.insert(O.PLACES[name], average(name))
        step += 1
    out = []
    for i, r in enumerate(rows):
        keeper = sum(r[29:33]) / 4 - sum(r[:29]) / 29
        out.append(four[i] if (i == 0 and keeper < 0) or (i > 0 and keeper > 0) else r)
    return out


def test_lineup_matrix(spark):
    rng = random.Random(9)
    plain, averages = averages_of(spark)
    sides = []
    for i in range(40):
        players = [(rng.choice([*O.PLACES, "Other"]) if k else "Goalkeeper" if i % 3 else "Defender", None if rng.random() < 0.2 else [float(rng.randint(1, 99)) for _ in range(WIDTH)]) for k in range(rng.choice([0, 3, 7, 10, 11]))]
        sides.append((i, i % 2, 2021, rng.choice([1, 2, 77]), players))
    table = spark.createDataFrame(sides, "match_id long, side long, season long, team_id long, players array<struct<position: string, skills: array<double>>>")
    got = {r.match_id: r for r in O.lineup_matrix(table, averages).collect()}
    for i, _, season, team, players in sides:
        want = plain_matrix(plain, season, team, players)
        assert [pytest.approx(r) for r in want] == got[i].matrix and got[i].imitated == 11 - sum(s is not None for _, s in players)
    assert O.lineup_matrix(table.limit(0), averages).count() == 0
    with pytest.raises(Exception, match="too many"):
        O.lineup_matrix(spark.createDataFrame([(1, 0, 2021, 1, [("Forward", [1.0] * WIDTH)] * 12)], table.schema), averages).collect()


def test_lineup_matrix_by_player(spark, monkeypatch):
    rng = random.Random(5)
    plain, averages = averages_of(spark)
    skills = {p: [float(rng.randint(1, 99)) for _ in range(WIDTH)] for p in range(60)}
    sides = [(i, i % 2, rng.choice([2021, None]), rng.choice([1, 2, 77, None]), [(rng.choice([*O.PLACES, "Other", None]), rng.choice([*range(70), None])) for _ in range(rng.choice([0, 1, 4, 9, 11]))]) for i in range(80)]
    sides += [(90, 0, 2021, 1, [("Goalkeeper", 99), ("Forward", 98)]), (91, 1, 2021, 1, None)]
    table = spark.createDataFrame(sides, "match_id long, side long, season long, team_id long, players array<struct<position: string, player_id: long>>")
    own = spark.createDataFrame([*skills.items(), (69, None)], "player_id long, skills array<double>")
    for most in (O.SHIPPED, 0):
        monkeypatch.setattr(O, "SHIPPED", most)
        got = {r.match_id: r for r in O.lineup_matrix_by_player(table, own, averages).collect()}
        sums = {r.match_id: r for r in O.lineup_matrix_by_player(table, own, averages, made=O.TOTALS).collect()}
        assert got.keys() == sums.keys() == {s[0] for s in sides} and got[91].matrix is got[91].imitated is sums[91].total is None
        for i, _, season, team, players in sides[:-1]:
            want = plain_matrix(plain, season, team, [(p, skills.get(x)) for p, x in players])
            assert got[i].matrix == want and got[i].imitated == 11 - sum(x in skills for _, x in players)
            assert (sums[i].n_rows, sums[i].first_row, sums[i].total, sums[i].imitated) == (11, sum(want[0]), sum(map(sum, want)), got[i].imitated)
    none = spark.createDataFrame([], own.schema)
    assert O.lineup_matrix_by_player(table.where("match_id = 90"), none, averages).first().imitated == 11
    assert O.lineup_matrix_by_player(table.where("match_id = 3"), own, averages.where("season < 0")).count() == 1
    with pytest.raises(Exception, match="too many"):
        O.lineup_matrix_by_player(spark.createDataFrame([(1, 0, 2021, 1, [("Forward", 1)] * 12)], table.schema), own, averages).collect()


def test_a_matrix_keeps_nulls_and_short_rows(spark):
    averages = averages_of(spark)[1]
    odd = [5.0] * 20 + [None] * 9 + [9.0] * 5
    short = [1.0, 2.0]
    table = spark.createDataFrame([(1, 0, 2021, 1, [("Goalkeeper", [1.0] * 29 + [9.0] * 5), ("Defender", odd), ("Forward", short), None])], "match_id long, side long, season long, team_id long, players array<struct<position: string, skills: array<double>>>")
    got = O.lineup_matrix(table, averages).first()
    assert got.imitated == 8 and odd in got.matrix and short in got.matrix and len(got.matrix) == 11
    assert O.lineup_matrix(table, averages, made=O.TOTALS).first().total is None


def test_line_ups_do_not_carry_skills(spark):
    plan = legacy_queries.older_matrices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "transform(" not in plan


def test_lookups(spark):
    rounds = spark.createDataFrame([("A", 2021, "1st Round", 5), ("A", 2021, "Final", 6), ("A", 2021, "2nd Round - 1", 7), ("A", 2021, "2nd Round", 8)], "competition string, season long, round_name string, round_id long")
    asked = spark.createDataFrame([(1, "A", 2021, "1st Round - 12"), (2, "A", 2021, "Final"), (3, "A", 2021, "2nd Round - 1"), (4, "A", 2021, "2nd Round – 3"), (5, "A", 2021, "Group - 1"), (6, "A", 2022, "Final"), (7, "A", 2021, None)], "i long, competition string, season long, name string")
    assert {r.i: r.round_id for r in O.round_of(asked, rounds).collect()} == {1: 5, 2: 6, 3: 7, 4: 8, 5: None, 6: None, 7: None}
    leagues = spark.createDataFrame([("X", "A", [(1, 20212022), (2, 2022), (3, 20222023), (4, 20242026), (5, 2023)])], "country string, league string, years array<struct<id: long, year: long>>")
    want = lambda *seasons: O.season_ids(spark.createDataFrame([("X", "A", s) for s in seasons], "country string, league string, season long"), leagues, 2025)
    assert {r.season: r.season_id for r in want(2021, 2023, 2025).collect()} == {2021: 1, 2023: 5, 2025: None}
    for season in (2022, 2024):
        with pytest.raises(Exception, match="exactly one"):
            want(season).collect()


def test_regular_teams(spark):
    matches = spark.createDataFrame([("A", 2021, 1, 2, True), ("A", 2021, 3, 1, False), ("B", 2021, 3, None, True)], "competition string, season long, home_id long, away_id long, regular boolean")
    regular = O.regular_teams(matches)
    assert {tuple(r) for r in regular.collect()} == {("A", 2021, 1), ("A", 2021, 2), ("B", 2021, 3)}
    table = spark.createDataFrame([("A", 2021, t, float(t), 5, 1, 9) for t in (1, 2, 3)], "competition string, season long, team_id long, mean_points double, gf long, ga long, place long")
    assert {(r.team_id, r.place) for r in O.regular_only(table, regular).collect()} == {(2, 1), (1, 2)}
