"""Queries on domain rules, selections, coverage and the combined report, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.lineage import cut, written
from touchline.operators import league, sequential, validation
from touchline.plans.fixtures import by_match, tables
from touchline.plans.model_queries import rounded

#: A selection with a competition that has no matches, seasons without listed rounds and an excluded season.
CHECKED = C.Selection(("L0", "L2", "L9"), 1995, 1999, (("L0", 1996),), {("L0", 1995): (1, 2), ("L0", 1997): (1, 2, 3), ("L2", 1996): (2, 3), ("L2", 1998): (1,)})
SHAPE = (11, 4)


def domain(spark: SparkSession, d: str) -> DataFrame:
    teams = written(tables(spark, d, "fx_matches").select(F.col("home_id").alias("team_id")).distinct().where("team_id % 17 <> 6"))
    linked, membership, comp_seasons = (written(tables(spark, d, name)) for name in ("fx_linked", "fx_membership", "fx_comp_seasons"))  # views that several rules read
    players = written(tables(spark, d, "fx_lineups").select("player_id").distinct().where("player_id % 37 <> 5"))
    return validation.domain_findings(linked, teams, comp_seasons, membership, tables(spark, d, "fx_lineups", fx_matches=by_match(spark, d)), players)


def domain_findings(spark: SparkSession, d: str) -> DataFrame:
    return validation.rollup(domain(spark, d))


def selection(spark: SparkSession, d: str) -> DataFrame:
    matches = tables(spark, d, "fx_linked")
    selected = cut(league.select_matches(matches, CHECKED))
    rounds = cut(sequential.greedy_rounds(selected.where("home_id is not null and away_id is not null")))
    return validation.selection_findings(matches, CHECKED, league.select_matches(matches, CHECKED, with_rounds=False), selected, rounds)


def selection_findings(spark: SparkSession, d: str) -> DataFrame:
    return validation.rollup(selection(spark, d))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    matches = by_match(spark, d)
    listed, cells = (tables(spark, d, name, fx_matches=matches) for name in ("fx_listed", "fx_cells"))
    rated, clubs = (written(tables(spark, d, name)) for name in ("fx_rated", "fx_clubs"))
    return validation.coverage_inventory(matches, listed, rated, clubs, validation.cell_counts(cells, SHAPE), SHAPE)


def coverage_inventory(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inventory(spark, d).drop("total"), 9)


def coverage_findings(spark: SparkSession, d: str) -> DataFrame:
    return validation.rollup(validation.coverage_findings(inventory(spark, d)))


def combined_findings(spark: SparkSession, d: str) -> DataFrame:
    return validation.combined({"domain": domain(spark, d), "selection": selection(spark, d), "coverage": validation.coverage_findings(inventory(spark, d))})


QUERIES = {f.__name__: f for f in (domain_findings, selection_findings, coverage_inventory, coverage_findings, combined_findings)}


def _ruled(source: str, entity: str, entity_id: str, rules: list[tuple[str, str, str]]) -> str:
    """Findings of rules (code, severity, condition) on a source, one SELECT for each."""
    return " UNION ALL ".join(f"SELECT '{code}' AS code, '{severity}' AS severity, '{entity}' AS entity, CAST({entity_id} AS VARCHAR) AS entity_id, 1 AS n FROM {source} WHERE {bad}" for code, severity, bad in rules)


_GOALS = [(f"{{}}invalid_{s}_goals", "critical", f"{s}_goals IS NULL OR {s}_goals < 0") for s in ("home", "away")]
_DOMAIN = f"""teams AS (SELECT DISTINCT home_id AS team_id FROM {{fx_matches}} WHERE home_id % 17 <> 6),
players AS (SELECT DISTINCT player_id FROM {{fx_lineups}} WHERE player_id % 37 <> 5),
linked AS (SELECT m.*, c.season AS cs_season, c.name AS cs_name, c.country AS cs_country FROM {{fx_linked}} m LEFT JOIN {{fx_comp_seasons}} c USING (comp_season_id)),
refs AS (SELECT x.comp_season_id, x.match_id, m.match_id AS there, m.comp_season_id AS own FROM {{fx_membership}} x LEFT JOIN {{fx_linked}} m ON m.match_id = x.match_id),
pairs AS (SELECT comp_season_id, match_id, count(*) AS times FROM {{fx_membership}} GROUP BY ALL),
linkage AS (SELECT m.match_id, count(p.match_id) AS seasons FROM {{fx_linked}} m LEFT JOIN pairs p ON p.match_id = m.match_id GROUP BY m.match_id),
names AS (SELECT match_id, player_id, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS a FROM {{fx_lineups}} GROUP BY ALL),
strangers AS (SELECT * FROM {{fx_lineups}} WHERE player_id NOT IN (SELECT player_id FROM players)),
domain_rows AS ({_ruled("linked", "match", "match_id", [
    ("same_home_and_away_team", "critical", "home_id = away_id"), ("missing_home_team", "warning", "home_id IS NULL"), ("missing_away_team", "warning", "away_id IS NULL"),
    ("unknown_home_team", "critical", "home_id NOT IN (SELECT team_id FROM teams)"), ("unknown_away_team", "critical", "away_id NOT IN (SELECT team_id FROM teams)"),
    *[(c.format(""), s, b) for c, s, b in _GOALS], ("invalid_match_datetime", "critical", "dt IS NULL"), ("invalid_match_season", "critical", "season IS NULL OR season NOT BETWEEN 1900 AND 2100"),
    ("missing_comp_season_id", "critical", "comp_season_id IS NULL"), ("unknown_comp_season_id", "critical", "comp_season_id IS NOT NULL AND cs_name IS NULL"),
    ("match_comp_season_year_mismatch", "critical", "season <> cs_season"), ("match_comp_name_mismatch", "critical", "competition <> cs_name"), ("match_country_mismatch", "critical", "country <> cs_country")])}
  UNION ALL SELECT 'duplicate_comp_season_match_reference', 'critical', 'competition-season', CAST(comp_season_id AS VARCHAR), times - 1 FROM pairs WHERE times > 1
  UNION ALL {_ruled("refs", "competition-season", "comp_season_id", [("detached_comp_season_match_reference", "warning", "there IS NULL"), ("comp_season_match_link_mismatch", "critical", "there IS NOT NULL AND own IS DISTINCT FROM comp_season_id")])}
  UNION ALL {_ruled("linkage", "match", "match_id", [("match_missing_from_comp_season", "critical", "seasons = 0"), ("match_in_multiple_comp_seasons", "critical", "seasons > 1")])}
  UNION ALL SELECT 'duplicate_home_lineup_player', 'warning', 'match', CAST(match_id AS VARCHAR), h - 1 FROM names WHERE h > 1
  UNION ALL SELECT 'duplicate_away_lineup_player', 'warning', 'match', CAST(match_id AS VARCHAR), a - 1 FROM names WHERE a > 1
  UNION ALL {_ruled("strangers", "match", "match_id", [("unknown_home_lineup_player", "critical", "side = 0"), ("unknown_away_lineup_player", "critical", "side = 1")])}
  UNION ALL {_ruled("names", "match", "match_id", [("player_in_both_lineups", "warning", "h > 0 AND a > 0")])})"""

_LISTED = ", ".join(f"('{c}', {s}, {r})" for (c, s), rs in CHECKED.rounds.items() for r in rs)
_TEAM_RULES = [(f"selected_match_missing_{s}_team", "critical", f"{s}_id IS NULL") for s in ("home", "away")]
_SELECTION = f"""listed(competition, season, round_id) AS (VALUES {_LISTED}), wanted(competition) AS (VALUES {', '.join(f"('{c}')" for c in CHECKED.competitions)}),
scoped AS (
  SELECT * FROM {{fx_linked}} WHERE competition IN (SELECT competition FROM wanted) AND season >= {CHECKED.first_season} AND season < {CHECKED.last_season}
    AND NOT ({" OR ".join(f"(competition = '{c}' AND season = {s})" for c, s in CHECKED.excluded)})),
picked AS (SELECT * FROM scoped SEMI JOIN listed USING (competition, season, round_id)),
absent AS (SELECT * FROM wanted ANTI JOIN scoped USING (competition)),
unlisted AS (SELECT DISTINCT competition, season FROM scoped ANTI JOIN listed USING (competition, season)),
sums AS (SELECT count(*) AS s, count(*) FILTER (home_id IS NOT NULL AND away_id IS NOT NULL) AS r FROM picked),
selection_rows AS ({_ruled("absent", "competition", "competition", [("configured_competition_missing", "critical", "true")])}
  UNION ALL {_ruled("unlisted", "competition-season", "concat(competition, ' ', season)", [("missing_round_whitelist", "critical", "true")])}
  UNION ALL {_ruled("picked", "match", "match_id", [*_TEAM_RULES, ("selected_match_same_home_and_away_team", "critical", "home_id = away_id"), ("selected_match_invalid_datetime", "critical", "dt IS NULL"), *[(c.format("selected_match_"), s, b) for c, s, b in _GOALS]])}
  UNION ALL {_ruled("sums", "selection", "'all'", [("no_selected_matches", "critical", "s = 0")])}
  UNION ALL {_ruled("sums", "rounds", "'all'", [("round_match_count_mismatch", "critical", "s <> r")])}
  UNION ALL SELECT 'team_repeated_within_round', 'critical', 'round', round_index, 1 FROM repeats)"""

#: Rounds of the selected matches (links to the next match that ends a round, followed), and teams that play twice in one.
_ROUNDS = """m AS MATERIALIZED (SELECT match_id, home_id, away_id, row_number() OVER (ORDER BY dt, coalesce(hour_utc, -1), match_id) AS rn FROM picked WHERE home_id IS NOT NULL AND away_id IS NOT NULL),
again AS (SELECT rn, min(nx) AS nx FROM (SELECT rn, lead(rn) OVER (PARTITION BY team ORDER BY rn) AS nx FROM (SELECT DISTINCT rn, unnest([home_id, away_id]) AS team FROM m)) GROUP BY rn),
links AS MATERIALIZED (SELECT rn, min(nx) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING) AS nb FROM again),
chain AS (SELECT CAST(1 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS k UNION ALL SELECT nb, k + 1 FROM chain JOIN links USING (rn) WHERE nb IS NOT NULL),
placed_rounds AS (SELECT m.*, max(k) OVER (ORDER BY m.rn) AS round_index FROM m LEFT JOIN chain USING (rn)),
repeats AS (SELECT CAST(round_index AS VARCHAR) AS round_index, team FROM (SELECT round_index, unnest([home_id, away_id]) AS team FROM placed_rounds) GROUP BY ALL HAVING count(*) > 1)"""

_COLUMNS = "matches, sides, lineups_empty, lineups_partial, lineups_complete, lineups_oversized, lineups_without_goalkeeper, refs, references_matched, references_failed, references_missing, references_invalid, matrices, matrices_valid, matrices_missing, matrices_invalid, cells, cells_observed, rows_missing, rows_partial, rows_observed, matrices_unobserved, matrices_observed"
_INVENTORY = f"""sided AS (SELECT match_id, competition, season, 0 AS side, home_id AS team_id FROM {{fx_matches}} UNION ALL SELECT match_id, competition, season, 1, away_id FROM {{fx_matches}}),
stated AS (
  SELECT l.*, CASE WHEN l.player_id IS NULL OR l.player_id <= 0 THEN 'invalid' WHEN r.player_id IS NULL THEN 'missing' WHEN r.rated_id > 0 THEN 'matched' ELSE 'failed' END AS state
  FROM {{fx_listed}} l LEFT JOIN {{fx_rated}} r USING (player_id)),
lined AS (SELECT match_id, side, count(*) AS refs, {", ".join(f"count(*) FILTER (state = '{s}') AS references_{s}" for s in validation.REFERENCES)}, count(*) FILTER (position = 'Goalkeeper') AS keepers FROM stated GROUP BY match_id, side),
by_row AS (SELECT match_id, side, slot, count(*) AS width, count(*) FILTER (value >= 0) AS seen FROM {{fx_cells}} GROUP BY ALL),
by_matrix AS (
  SELECT match_id, side, count(*) = {SHAPE[0]} AND bool_and(width = {SHAPE[1]}) AS ok, sum(seen) AS observed, count(*) FILTER (seen = 0) AS rm, count(*) FILTER (seen > 0 AND seen < {SHAPE[1]}) AS rp, count(*) FILTER (seen = {SHAPE[1]}) AS ro
  FROM by_row GROUP BY ALL),
wide AS (
  SELECT s.*, coalesce(refs, 0) AS refs, {", ".join(f"coalesce(references_{s}, 0) AS references_{s}" for s in validation.REFERENCES)}, coalesce(keepers, 0) AS keepers, m.match_id IS NOT NULL AS there, coalesce(ok, false) AS ok, observed, rm, rp, ro
  FROM sided s LEFT JOIN lined l ON l.match_id = s.match_id AND l.side = s.side LEFT JOIN by_matrix m ON m.match_id = s.match_id AND m.side = s.side),
scoped_counts AS (
  SELECT competition, season, grouping(competition) = 1 AS total, count(*) FILTER (side = 0) AS matches, count(*) AS sides, count(*) FILTER (refs = 0) AS lineups_empty, count(*) FILTER (refs > 0 AND refs < {SHAPE[0]}) AS lineups_partial,
    count(*) FILTER (refs = {SHAPE[0]}) AS lineups_complete, count(*) FILTER (refs > {SHAPE[0]}) AS lineups_oversized, count(*) FILTER (keepers = 0) AS lineups_without_goalkeeper, CAST(sum(refs) AS BIGINT) AS refs,
    {", ".join(f"CAST(sum(references_{s}) AS BIGINT) AS references_{s}" for s in validation.REFERENCES)}, count(*) AS matrices, count(*) FILTER (ok) AS matrices_valid, count(*) FILTER (NOT there) AS matrices_missing,
    count(*) FILTER (there AND NOT ok) AS matrices_invalid, count(*) FILTER (ok) * {SHAPE[0] * SHAPE[1]} AS cells, {", ".join(f"CAST(coalesce(sum({c}) FILTER (ok), 0) AS BIGINT) AS {n}" for c, n in (("observed", "cells_observed"), ("rm", "rows_missing"), ("rp", "rows_partial"), ("ro", "rows_observed")))},
    count(*) FILTER (ok AND observed = 0) AS matrices_unobserved, count(*) FILTER (ok AND observed = {SHAPE[0] * SHAPE[1]}) AS matrices_observed
  FROM wide GROUP BY GROUPING SETS ((competition, season), ())),
people AS (SELECT count(*) AS players, {", ".join(f"count(*) FILTER (state = '{s}') AS players_{s}" for s in validation.REFERENCES[:3])} FROM (SELECT DISTINCT player_id, state FROM stated WHERE state <> 'invalid')),
sorted_teams AS (
  SELECT count(*) AS teams, count(*) FILTER (club_id > 0) AS teams_mapped, count(*) FILTER (c.team_id IS NULL) AS teams_missing, count(*) FILTER (c.team_id IS NOT NULL AND NOT club_id > 0) AS teams_unmapped
  FROM (SELECT DISTINCT team_id FROM sided) s LEFT JOIN {{fx_clubs}} c USING (team_id)),
inventory AS (
  SELECT competition, season, total, {_COLUMNS.replace(" refs,", " refs AS \"references\",")}, players, players_matched, players_failed, players_missing, teams, teams_mapped, teams_missing, teams_unmapped, cells - cells_observed AS cells_missing,
    CASE WHEN teams = 0 THEN 0 ELSE teams_mapped / teams END AS team_rate, CASE WHEN players = 0 THEN 0 ELSE players_matched / players END AS player_rate,
    CASE WHEN refs = 0 THEN 0 ELSE references_matched / refs END AS reference_rate, CASE WHEN cells = 0 THEN 0 ELSE cells_observed / cells END AS cell_rate
  FROM scoped_counts s LEFT JOIN people ON total LEFT JOIN sorted_teams ON total)"""
_COVERAGE = f"""all_row AS (SELECT * FROM inventory WHERE total), scope_rows AS (SELECT * FROM inventory WHERE NOT total),
coverage_rows AS ({_ruled("all_row", "coverage", "'selected-scope'", [(c, "critical", f"NOT ({law})".replace("references ", '"references" ')) for c, law in validation.LAWS.items()])}
  UNION ALL {" UNION ALL ".join(f"SELECT '{c}', '{s}', 'coverage', 'selected-scope', {n} FROM all_row WHERE {n} > 0" for c, (s, n) in validation.COUNTS.items())}
  UNION ALL {" UNION ALL ".join(_ruled("all_row", "metric", f"'{r}'", [("invalid_coverage_rate", "critical", f"{r} NOT BETWEEN 0 AND 1")]) for r in validation.RATES)}
  UNION ALL {_ruled("scope_rows", "competition-season", "concat(competition, ' ', season)", [("competition_season_player_match_gap", "warning", "reference_rate < 1"), ("competition_season_strength_gap", "warning", "cell_rate < 1")])}
  UNION ALL SELECT 'competition_season_match_total_mismatch', 'critical', 'coverage', 'competition-seasons', 1 FROM all_row WHERE matches <> (SELECT sum(matches) FROM scope_rows))"""


def _rollup(rows: str) -> str:
    return f"""counts AS (SELECT code, severity, entity, CAST(sum(n) AS BIGINT) AS n FROM {rows} GROUP BY ALL),
firsts AS (SELECT code, string_agg(entity_id, ', ' ORDER BY entity_id) AS examples FROM (SELECT code, entity_id, row_number() OVER (PARTITION BY code ORDER BY entity_id) AS nth FROM (SELECT DISTINCT code, entity_id FROM {rows})) WHERE nth <= 5 GROUP BY code)
SELECT code, severity, entity, n, examples FROM counts JOIN firsts USING (code)"""


SQL = {
    "domain_findings": f"WITH {_DOMAIN}, {_rollup('domain_rows')}",
    "selection_findings": f"WITH RECURSIVE {_SELECTION.partition('sums AS')[0]}{_ROUNDS}, sums AS{_SELECTION.partition('sums AS')[2]}, {_rollup('selection_rows')}",
    "coverage_inventory": f"WITH {_INVENTORY} SELECT * EXCLUDE (total) REPLACE (round(team_rate, 9) AS team_rate, round(player_rate, 9) AS player_rate, round(reference_rate, 9) AS reference_rate, round(cell_rate, 9) AS cell_rate) FROM inventory",
    "coverage_findings": f"WITH {_INVENTORY}, {_COVERAGE}, {_rollup('coverage_rows')}",
    "combined_findings": f"""WITH RECURSIVE {_DOMAIN}, {_SELECTION.partition('sums AS')[0]}{_ROUNDS}, sums AS{_SELECTION.partition('sums AS')[2]}, {_INVENTORY}, {_COVERAGE},
parts AS (SELECT 'domain' AS component, severity, n FROM domain_rows UNION ALL SELECT 'selection', severity, n FROM selection_rows UNION ALL SELECT 'coverage', severity, n FROM coverage_rows
  UNION ALL SELECT unnest(['domain', 'selection', 'coverage']), 'none', 0)
SELECT coalesce(component, 'overall') AS component, CAST(coalesce(sum(n) FILTER (severity = 'critical'), 0) AS BIGINT) AS critical, CAST(coalesce(sum(n) FILTER (severity = 'warning'), 0) AS BIGINT) AS warnings,
  coalesce(sum(n) FILTER (severity = 'critical'), 0) = 0 AS ok FROM parts GROUP BY ROLLUP (component)""",
}
