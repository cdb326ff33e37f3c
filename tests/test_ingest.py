"""Ingest of JSON records that break each rule, against what the rules say record by record."""

import datetime
import json

import pytest

from touchline.sources import ingest


def records(spark, rows, keys):
    return spark.createDataFrame([(*k, i, r if isinstance(r, str) else json.dumps(r), "x") for i, (*k, r) in enumerate(rows)], f"{', '.join(f'{k} long' for k in keys)}, ord long, record string, extra string")


def player(i, club, second=-1, birthday=10**8, comp=1, **more):
    return {"id": i, "full_name": f"P{i}", "birthday": birthday, "club_team_id": club, "club_team_2_id": second, "competition_id": comp, "position": "Forward"} | more


def match(i, home=10, away=11, season="2021/2022", comp=1, status="complete", goals=(2, 1), **more):
    return {"id": i, "homeID": home, "awayID": away, "season": season, "competition_id": comp, "status": status, "homeGoalCount": goals[0], "awayGoalCount": goals[1], "date_unix": 1633046340, "roundID": 7, "team_a_shots": 4, "odds_ft_over25": 1.9} | more


@pytest.fixture(scope="module")
def tables(spark):
    leagues = [
        {"name": "A", "country": "X", "season": [{"id": 1, "year": 20212022}, {"id": 2, "year": 2022}, {"id": 3, "year": 20202021}, {"id": None, "year": 2022}]}, {"name": "A", "country": "Y", "season": [{"id": 4, "year": 2022}]},
        {"name": "B", "country": "X", "season": [{"id": 5, "year": 2022}]}, {"name": "A", "country": "X", "season": [{"id": 1, "year": 20212022}]},
    ]
    teams = [(1, {"id": 10, "name": "Ten", "cleanName": "ten", "competition_id": 1}), (1, {"id": 11, "name": "Eleven", "competition_id": 1}), (2, {"id": 10, "name": "Ten again", "competition_id": 2}), (5, {"id": 99, "competition_id": 5}), (1, {"name": "no id"})]
    players = [
        (1, player(1, 10)), (1, player(2, 10, 11)), (1, player(3, 10, birthday=0)), (1, player(3, 11)), (1, player(4, 77)), (1, player(5, 10, 77)), (2, player(5, 10, comp=2)), (1, player(6, 10, birthday="1990")),
        (2, player(1, 10, comp=2)), (1, player(None, 10)), (1, "no json"), (1, player(7, 11, second=None)),
    ]
    matches = [
        (1, match(1)), (1, match(2, status="incomplete")), (1, match(3, home=99)), (1, match(4, away=98)), (1, match(5, season="2022/2023")), (1, match(6, goals=(-1, 0))), (1, match(7, comp=2)), (2, match(8, season="2022", comp=2, goals=(0, 0))),
        (1, match(9)), (1, match(10, goals=(0, 3))), (1, match(1)), (1, match(11)), (1, match(12)), (1, match(50)), (1, "[]"), (1, match(13)),
    ]
    ids = lambda *x: [{"player_id": i} for i in x]
    lineups = [
        (1, {"lineups": {"team_a": ids(1, 999, 2), "team_b": ids(3)}}), (8, [{"x": 1}, {"lineups": {"team_a": ids(5)}}, {"lineups": {"team_a": ids(1)}}]), (9, {"lineups": {"team_a": ids(1, "2"), "team_b": []}}), (10, {"lineups": {}}), (11, []), (12, {"other": 1}),
    ]
    raw = {
        "leagues": spark.createDataFrame([(json.dumps(x),) for x in leagues], "record string"), "teams": records(spark, teams, ["season_id"]), "players": records(spark, players, ["season_id"]),
        "matches": records(spark, matches, ["season_id"]), "lineups": records(spark, lineups, ["match_id"]),
    }
    stored = spark.createDataFrame([(50,), (51,)], "match_id long")
    return {k: v.cache() for k, v in ingest.ingest(raw, ("X",), ("A",), 2021, stored).items()}, raw


def test_comp_seasons_and_teams(tables):
    out, _ = tables
    assert {tuple(r) for r in out["comp_seasons"].collect()} == {(1, 2021, "X", "A"), (2, 2022, "X", "A")}
    assert {(r.team_id, r.name, r.clean_name) for r in out["teams"].collect()} == {(10, "Ten", "ten"), (11, "Eleven", None)}
    assert {tuple(r) for r in out["team_seasons"].collect()} == {(10, 1), (11, 1), (10, 2)}


def test_players_and_rosters(tables):
    out, _ = tables
    assert {r.player_id for r in out["players"].collect()} == {1, 2, 3, 5} and {r.birthday for r in out["players"].collect()} == {datetime.date(1973, 3, 3)}
    assert {tuple(r) for r in out["rosters"].collect()} == {(10, 1, 1), (10, 1, 2), (11, 1, 2), (11, 1, 3), (10, 1, 5), (10, 2, 5), (11, 1, 7)}


def test_matches_and_lineups(tables):
    out, _ = tables
    got = {r.match_id: r for r in out["matches"].collect()}
    assert set(got) == {1, 8, 10, 12}
    one = got[1]
    assert (one.comp_season_id, one.competition, one.season, one.round_id, one.hour_utc, one.hour_local, one.month, one.home_points, one.away_points, one.home_shots, one.odds_over25) == (1, "A", 2021, 7, 23, 1, 9, 3, 0, 4.0, 1.9)
    assert one.dt == datetime.datetime(2021, 9, 30) and one.away_shots is None and (got[8].home_points, got[10].away_points) == (1, 3)
    assert {tuple(r) for r in out["membership"].select("comp_season_id", "match_id").collect()} == {(1, 1), (2, 8), (1, 10), (1, 12), (1, 50)}
    assert {tuple(r) for r in out["lineups"].collect()} == {(1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 0, 3), (8, 0, 0, 5)}


def test_refused(tables):
    out, _ = tables
    assert {(r.code, r.id) for r in out["refused"].collect()} == {
        ("player_without_birthday", "3"), ("player_of_unknown_team", "4"), ("player_of_unknown_second_team", "5"), ("player_without_birthday", "6"), ("player_without_id", None), ("player_of_unknown_second_team", "7"),
        ("match_not_complete", "2"), ("match_of_unknown_home_team", "3"), ("match_of_unknown_away_team", "4"), ("match_of_another_season", "5"), ("match_without_goals", "6"), ("match_of_another_comp_season", "7"), ("match_without_id", None),
        ("lineup_with_odd_ids", "9"), ("match_without_lineups", "11"), ("match_without_lineups", "13"),
    }


def test_empty_records(tables):
    _, raw = tables
    assert all(df.count() == 0 for df in ingest.ingest({k: v.limit(0) for k, v in raw.items()}, ("X",), ("A",)).values())


def test_days_beyond_the_year_9999(spark):
    from pyspark.sql import functions as F

    from touchline.functions.scalars import iso_day

    days = spark.range(3).select(F.element_at(F.array(F.date_from_unix_date(F.lit(0)), F.date_from_unix_date(F.lit(8999990)), F.lit(None).cast("date")), F.col("id").cast("int") + 1).alias("d"))
    assert [r.d for r in days.select(iso_day(F.col("d")).alias("d")).collect()] == ["1970-01-01", "26611-02-20", None]
