"""Validation rules on rows that break each of them, nulls, repeats and empty tables."""

import datetime

import pytest

from touchline import config as C
from touchline.operators import league, sequential, validation

DAY = datetime.datetime(2022, 1, 1)
MATCH = "match_id long, home_id long, away_id long, home_goals long, away_goals long, dt timestamp, hour_utc long, season long, competition string, country string, comp_season_id long, round_id long, code string"


def matches(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], MATCH)


def found(df):
    return {(r.code, r.entity_id, r.n) for r in df.collect()}


def test_domain_rules(spark):
    rows = [
        (1, 1, 2, 1, 0, DAY, 12, 2022, "A", "X", 10, 1), (2, 1, 1, 0, 0, DAY, 12, 2022, "A", "X", 10, 1), (3, None, 9, None, -1, None, 12, 1800, "B", None, 10, 1),
        (4, 2, 1, 0, 0, DAY, 12, 2022, "A", "X", None, 1), (5, 2, 1, 0, 0, DAY, 12, 2022, "A", "X", 77, 1), (1, 1, 2, 1, 0, DAY, 12, None, "A", "X", 10, 1),
    ]
    teams = spark.createDataFrame([(1,), (2,), (2,)], "team_id long")
    seasons = spark.createDataFrame([(10, 2022, "A", "X")], "comp_season_id long, season long, name string, country string")
    assert found(validation.match_rules(matches(spark, rows), teams, seasons)) == {
        ("same_home_and_away_team", "2", 1), ("missing_home_team", "3", 1), ("unknown_away_team", "3", 1), ("invalid_home_goals", "3", 1), ("invalid_away_goals", "3", 1), ("invalid_match_datetime", "3", 1),
        ("invalid_match_season", "3", 1), ("match_comp_season_year_mismatch", "3", 1), ("match_comp_name_mismatch", "3", 1), ("match_country_mismatch", "3", 1), ("missing_comp_season_id", "4", 1),
        ("unknown_comp_season_id", "5", 1), ("invalid_match_season", "1", 1), ("match_comp_season_year_mismatch", "1", 1),
    }
    members = spark.createDataFrame([(10, 1), (10, 1), (10, 1), (11, 2), (10, 2), (10, 99)], "comp_season_id long, match_id long")
    assert found(validation.membership_rules(matches(spark, rows[:4]), members)) == {
        ("duplicate_comp_season_match_reference", "10", 2), ("detached_comp_season_match_reference", "10", 1), ("comp_season_match_link_mismatch", "11", 1),
        ("match_in_multiple_comp_seasons", "2", 1), ("match_missing_from_comp_season", "3", 1), ("match_missing_from_comp_season", "4", 1),
    }
    lineups = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 0, 5), (1, 1, 5), (1, 1, 6), (2, 1, None)], "match_id long, side long, player_id long")
    players = spark.createDataFrame([(5,)], "player_id long")
    assert found(validation.lineup_rules(lineups, players)) == {
        ("duplicate_home_lineup_player", "1", 2), ("player_in_both_lineups", "1", 1), ("unknown_away_lineup_player", "1", 1), ("unknown_away_lineup_player", "2", 1)
    }
    every = validation.domain_findings(matches(spark, rows), teams, seasons, members, lineups, players)
    rolled = {r.code: (r.severity, r.n, r.examples) for r in validation.rollup(every, 1).collect()}
    assert rolled["invalid_match_season"] == ("critical", 2, "1") and rolled["missing_home_team"][0] == "warning"
    empty = [x.limit(0) for x in (matches(spark, []), teams, seasons, members, lineups, players)]
    assert validation.rollup(validation.domain_findings(*empty)).count() == 0


def test_selection_rules(spark):
    config = C.Selection(("A", "B", "C"), 2021, 2024, (), {("A", 2022): (1,)})
    rows = [(1, 1, 2, 1, 0, DAY, 12, 2022, "A", "X", 10, 1), (2, 3, 3, 1, 0, DAY, 12, 2022, "A", "X", 10, 1), (3, 4, None, 1, None, None, 12, 2022, "A", "X", 10, 1), (4, 1, 2, 1, 0, DAY, 12, 2023, "B", "X", 10, 1)]
    all_ = matches(spark, rows)
    picked = league.select_matches(all_, config)
    rounds = sequential.greedy_rounds(picked.where("away_id is not null"))
    got = found(validation.selection_findings(all_, config, league.select_matches(all_, config, with_rounds=False), picked, rounds))
    assert got == {
        ("configured_competition_missing", "C", 1), ("missing_round_whitelist", "B 2023", 1), ("selected_match_same_home_and_away_team", "2", 1), ("selected_match_missing_away_team", "3", 1),
        ("selected_match_invalid_datetime", "3", 1), ("selected_match_invalid_away_goals", "3", 1), ("round_match_count_mismatch", "all", 1), ("team_repeated_within_round", "0", 1),
    }
    none = matches(spark, [])
    got = found(validation.selection_findings(none, config, none, none, rounds.limit(0)))
    assert got == {("configured_competition_missing", c, 1) for c in "ABC"} | {("no_selected_matches", "all", 1)}


def test_rounds_of_matches_of_a_team_with_itself_and_of_unknown_teams(spark):
    rows = [(i, h, a, 0, 0, DAY, i, 2022, "A", "X", 1, 1) for i, (h, a) in enumerate([(1, 1), (2, 3), (None, None), (None, 4), (5, 1), (5, 6)])]
    assert {r.match_id: r.round_index for r in sequential.greedy_rounds(matches(spark, rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2}


@pytest.fixture(scope="module")
def inventory(spark):
    all_ = matches(spark, [(1, 1, 2, 0, 0, DAY, 1, 2022, "A", "X", 1, 1), (2, 2, 3, 0, 0, DAY, 1, 2023, "A", "X", 1, 1)])
    lineups = spark.createDataFrame([(1, 0, 5, "Goalkeeper"), (1, 0, 6, "x"), (1, 1, 7, None), (1, 1, None, "x"), (2, 0, 5, "x"), (2, 0, 8, "x"), (2, 0, 8, "x"), (9, 0, 5, "x")], "match_id long, side int, player_id long, position string")
    rated = spark.createDataFrame([(5, 50), (6, -1), (7, None)], "player_id long, rated_id long")
    clubs = spark.createDataFrame([(1, 10), (2, -1)], "team_id long, club_id long")
    nan = float("nan")
    strength = [(1, 0, [[1.0, 2.0], [-1.0, None]]), (1, 1, [[1.0]]), (2, 0, [[-1.0, nan], [float("inf"), -1.0]])]
    return validation.coverage_inventory(all_, lineups, rated, clubs, spark.createDataFrame(strength, "match_id long, side int, matrix array<array<double>>"), (2, 2))


def test_coverage(spark, inventory):
    rows = {r.season: r.asDict() for r in inventory.collect()}
    want = dict(
        matches=2, sides=4, lineups_empty=1, lineups_partial=0, lineups_complete=2, lineups_oversized=1, lineups_without_goalkeeper=3, references=7, references_matched=2, references_failed=2, references_missing=2,
        references_invalid=1, matrices=4, matrices_valid=2, matrices_missing=1, matrices_invalid=1, cells=8, cells_observed=2, cells_missing=6, rows_missing=3, rows_partial=0, rows_observed=1, matrices_unobserved=1,
        matrices_observed=0, players=4, players_matched=1, players_failed=2, players_missing=1, teams=3, teams_mapped=1, teams_missing=1, teams_unmapped=1, team_rate=1 / 3, player_rate=0.25, reference_rate=2 / 7, cell_rate=0.25,
    )
    assert {k: rows[None][k] for k in want} == want
    assert rows[2022]["references"] == 4 and rows[2022]["players"] is None and rows[2023]["reference_rate"] == 1 / 3
    got = {(r.code, r.severity, r.n) for r in validation.coverage_findings(inventory).collect()}
    assert got == {
        ("invalid_selected_lineup_player_references", "critical", 1), ("invalid_strength_matrices", "critical", 1), ("incomplete_selected_team_mapping", "critical", 2), ("noncomplete_lineups", "warning", 2),
        ("lineups_without_explicit_goalkeeper", "warning", 3), ("unmatched_lineup_player_references", "warning", 4), ("unmatched_unique_lineup_players", "warning", 3), ("missing_strength_matrices", "warning", 1),
        ("fully_missing_strength_matrices", "warning", 1), ("missing_strength_cells", "warning", 6), ("fully_missing_strength_rows", "warning", 3),
        ("competition_season_player_match_gap", "warning", 1), ("competition_season_strength_gap", "warning", 1),
    }
    broken = inventory.selectExpr("* except (sides, cell_rate)", "sides + 1 as sides", "2.0D as cell_rate").where("total or season = 2022")
    codes = {r.code for r in validation.coverage_findings(broken).where("severity = 'critical'").collect()}
    assert {"lineup_side_count_mismatch", "strength_side_count_mismatch", "invalid_coverage_rate", "competition_season_match_total_mismatch"} <= codes


def test_combined(spark, inventory):
    findings = validation.coverage_findings(inventory)
    got = {r.component: (r.critical, r.warnings, r.ok) for r in validation.combined({"coverage": findings, "domain": findings.limit(0)}).collect()}
    assert got == {"coverage": (4, 27, False), "domain": (0, 0, True), "overall": (4, 27, False)}
