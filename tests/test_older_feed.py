"""The older feed's records, files and logs."""

import datetime
import json

import pytest

from touchline.sources import csv_archive
from touchline.sources import older_feed as O


def fixture(i, status="FT", league=(1, "A", 2021), teams=(10, 11), winner=(True, False), goals=(2, 1), name="Regular Season - 3", date="2021-08-13T19:30:00+02:00"):
    return {
        "fixture": {"id": i, "date": date, "status": {"short": status}}, "league": {"id": league[0], "name": league[1], "country": "X", "season": league[2], "round": name},
        "teams": {"home": {"id": teams[0], "winner": winner[0]}, "away": {"id": teams[1], "winner": winner[1]}}, "score": {"fulltime": {"home": goals[0], "away": goals[1]}},
    }


def test_fixtures(spark):
    rows = [
        fixture(1), fixture(2, "PST"), fixture(3, "AET", winner=(None, None), goals=(1, 1), name="Regular Round - 2"), fixture(4, league=(2, "A", 2021)), fixture(5, league=(1, "A", 2022)), fixture(6, name="Nowhere"), fixture(7, teams=(99, 11)),
        fixture(8, teams=(10, 98)), fixture(9, "???"), fixture(10, goals=(None, 1)), fixture(1), fixture(11, "LIVE"), fixture(50), fixture(12, "PEN", winner=(False, True), goals=(0, 0)), "nothing", fixture(None),
    ]
    records = spark.createDataFrame([(1, 2021, r if isinstance(r, str) else json.dumps(r), 1) for r in rows], "comp_id long, season long, record string, id int")
    comps = spark.createDataFrame([(1, "A")], "comp_id long, name string")
    rounds = spark.createDataFrame([("A", 2021, "Regular Season - 3", 3), ("A", 2021, "Regular Round", 2)], "competition string, season long, round_name string, round_id long")
    teams = spark.createDataFrame([(10,), (11,), (11,)], "team_id long")
    made, refused = O.fixtures(records, comps, rounds, teams, spark.createDataFrame([(50,)], "match_id long"))
    got = {r.match_id: r for r in made.collect()}
    assert set(got) == {1, 3, 12}
    assert (got[1].winner_id, got[1].home_points, got[1].round_id, got[1].hour, got[1].month, got[1].competition) == (10, 3, 3, 19, 8, "A") and got[1].ts == datetime.datetime(2021, 8, 13, 17, 30)
    assert (got[3].winner_id, got[3].round_id, got[3].away_points) == (-1, 2, 1) and got[12].winner_id == 11
    assert {(r.code, r.id) for r in refused.collect()} == {
        ("fixture_postponed", "2"), ("fixture_of_another_competition", "4"), ("fixture_of_another_season", "5"), ("fixture_of_unknown_round", "6"), ("fixture_of_unknown_home_team", "7"), ("fixture_of_unknown_away_team", "8"),
        ("fixture_of_unknown_status", "9"), ("fixture_without_goals", "10"), ("fixture_in_play", "11"), ("fixture_without_id", None),
    }
    days = {(r.comp_id, r.season): r.day for r in O.fetch_from(comps, [2021, 2022], made, "2019-01-01").collect()}
    assert days == {(1, 2021): "2021-08-13", (1, 2022): "2019-01-01"}


def test_statistics_and_lineups(spark):
    stats = [{"statistics": [{"type": "Total Shots", "value": 7}, {"type": "Ball Possession", "value": "45%"}]}, {"statistics": [{"type": "Total Shots", "value": None}]}]
    records = spark.createDataFrame([(1, json.dumps({"response": stats})), (2, json.dumps({"response": []})), (3, None)], "match_id long, record string")
    got = {r.match_id: r for r in O.statistics(records).collect()}
    assert (got[1].home_shots, got[1].home_possession, got[1].away_shots, got[1].away_possession) == (7, 0.45, -1, -1) and got[2].home_shots == got[3].away_corners == -1
    side = lambda ids: {"startXI": [{"player": {"id": i, "name": f"P{i}", "pos": "F"}} for i in ids]}
    lists = spark.createDataFrame([(1, json.dumps({"response": [side([*range(11), *range(11)]), side(range(20, 31))]})), (2, json.dumps({"response": [{}, side([])]})), (3, json.dumps({"response": []}))], "match_id long, record string")
    rows = O.feed_lineups(lists).collect()
    assert {(r.match_id, r.side) for r in rows} == {(1, 0), (1, 1)} and sorted(r.player_id for r in rows if r.side == 0) == list(range(11)) and all(r.slot == r.player_id - 20 * r.side for r in rows)
    with pytest.raises(Exception, match="neither"):
        O.feed_lineups(spark.createDataFrame([(1, json.dumps({"response": [side([1, 2])]}))], "match_id long, record string")).collect()


def test_wide_skill_rows(spark, tmp_path):
    skills = tuple(f"s{i}" for i in range(8))
    names = ["player_id", "name", "full_name", "dob", "positions", *[f"c{i}" for i in range(5, 30)], *skills]
    full = lambda i, values, name="N - FIFA 21": [str(i), name, f"Full {i}", "1990-01-02", "ST, CAM", *["x"] * 25, *values]
    short = full(3, ["9"] * 8)
    short = short[:24] + short[27:]
    rows = [names, full(1, ["1", "", "x", "4", "5", "6", "7", "8"]), full(2, [""] * 8), short, full(1, ["2"] * 8, "Later - x"), full(4, ["", "", "", "", "", "", "7", "8"], "Plain")]
    (tmp_path / "2021-03-04.csv").write_text("\n".join(",".join(f'"{c}"' for c in r) for r in rows))
    got = {r.player_id: r for r in O.wide_skill_rows(csv_archive.csv_cells(spark, str(tmp_path)), skills).collect()}
    assert set(got) == {1, 3, 4} and (got[1].skills, got[1].name, got[1].positions) == ([2.0] * 8, "Later", ["ST", "CAM"])
    assert got[3].skills == [9.0] * 8 and got[3].name == "N" and got[4].skills == [-1.0] * 6 + [7.0, 8.0]
    (tmp_path / "2021-03-05.csv").write_text("\n".join(",".join(r) for r in [names[:5], ["5", "", "F", "1990-01-02", "ST"]]))
    with pytest.raises(Exception, match="birthday"):
        O.wide_skill_rows(csv_archive.csv_cells(spark, str(tmp_path)), skills).collect()


def test_records_and_logs(spark, tmp_path):
    stored = spark.createDataFrame([("1", "2024-01-02 10:00 UTC", "5"), ("2", "2024-01-02 10:00 UTC", " -1 "), ("3", "never", "5"), ("6", None, "1")], "match_id string, match_start_datetime_utc string, won string")
    fetched = spark.createDataFrame([("1", "2024-01-02 10:00 UTC", "1", "0"), ("2", "2024-01-01 09:00 UTC", "0", "2.345"), ("4", "2024-01-03 09:00 UTC", "1.239", "9")], "match_id string, match_start_datetime_utc string, recommended_bet_yes string, recommended_bet_no string")
    got = {r.match_id: (r.won, r.bet_placed) for r in O.stored_records(stored, fetched).collect()}
    assert got == {"1": ("5", None), "2": (None, "2.35"), "4": (None, "1.24")}
    with pytest.raises(Exception, match="no bet"):
        O.stored_records(stored, fetched.selectExpr("'9' as match_id", "match_start_datetime_utc", "'0' as recommended_bet_yes", "'0' as recommended_bet_no")).collect()
    (tmp_path / "log.txt").write_text("lost 1 / 2021: 5\nmp1_a:\n  39 / 2021: 8360\n  39 / 2021: 9\n junk\nmp2:  \n  1 / 2022: 4\n")
    assert {tuple(r)[1:] for r in O.log_entries(spark, str(tmp_path)).collect()} == {("mp1_a", 39, 2021, 9), ("mp2", 1, 2022, 4)}
    row = spark.createDataFrame([("", "b", None)], "auc string, val_auc string, x string")
    assert O.first_known(row, {"score": ("auc", "val_auc"), "loss": ("l",)}).first().asDict() == {"auc": "", "val_auc": "b", "x": None, "score": "b", "loss": None}
