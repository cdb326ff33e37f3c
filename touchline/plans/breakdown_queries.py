"""Queries on places by match, seasons and round types, missing skills, odds as a benchmark and data set variants, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import betting, league, metrics, older_strength, reports
from touchline.operators.validation import cell_counts
from touchline.plans.fixtures import by_match, tables
from touchline.plans.form_queries import LISTED, PLACES
from touchline.plans.model_queries import ODDS, metric_sql, rounded
from touchline.plans.report_queries import listed_rounds
from touchline.plans.validation_queries import SHAPE

METRICS = ("n", "prevalence", "accuracy", "brier", "log_loss", "auc")


def places_by_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(league.pre_match_places(tables(spark, d, "fx_team_matches"), by_match=True), 9)


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return league.regular_season(tables(spark, d, "fx_matches").withColumn("round_id", F.expr("if(match_id % 91 < 80, 1, round_id)")))


def season_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.season_shares(flagged(spark, d), listed_rounds(spark)), 9)


def round_types(spark: SparkSession, d: str) -> DataFrame:
    return reports.round_types(flagged(spark, d), listed_rounds(spark), only_affected=True)


def regular_tables(spark: SparkSession, d: str) -> DataFrame:
    """Season tables of teams that played at home or away in a round 1."""
    matches = tables(spark, d, "fx_matches").withColumn("regular", (F.col("round_id") == 1) & (F.col("home_id") % 3 == 0) & (F.col("away_id") % 2 == 0))
    table = older_strength.regular_only(league.season_table(tables(spark, d, "fx_team_matches")), older_strength.regular_teams(matches))
    return table.select("competition", "season", "team_id", "points", "place")


def missing_skill_rates(spark: SparkSession, d: str) -> DataFrame:
    matches = by_match(spark, d)
    rows = cell_counts(tables(spark, d, "fx_cells", fx_matches=matches), SHAPE).join(matches.select("match_id", "competition"), "match_id")
    return rounded(reports.missing_skill_rates(rows, SHAPE), 9)


def benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    """The model's, the fair and the raw probability of under of each match with two prices."""
    priced = betting.implied(tables(spark, d, "fx_predictions"))
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("probability")) for m, c in (("model", "p_under"), ("fair", "fair_under"), ("raw", "raw_under"))])
    return priced.select("match_id", "season", "competition", "y_true", F.explode(methods).alias("m")).select("match_id", "season", "competition", "y_true", "m.*")


def odds_benchmark(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.scoped(benchmark_rows(spark, d), {"pooled": [], "season": ["season"]})
    return rounded(metrics.binary_metrics(rows, ["method", "scope", "scope_key"]))


def variant_gains(spark: SparkSession, d: str) -> DataFrame:
    """The AUC of the data set without odd rounds against that of the whole one, by competition."""
    rows = tables(spark, d, "fx_predictions").withColumnRenamed("p_under", "probability")
    marks = F.explode(F.expr("if(match_id % 3 = 0, array('all'), array('all', 'clean'))"))
    found = metrics.binary_metrics(rows.withColumn("variant", marks), ["variant", "competition"])
    return rounded(reports.variant_gains(found, "all", ["competition"], ["auc", "n"]))


QUERIES = {f.__name__: f for f in (places_by_match, season_shares, round_types, regular_tables, missing_skill_rates, odds_benchmark, variant_gains)}

_FLAGGED = f"""WITH listed AS ({LISTED}), m0 AS (SELECT * REPLACE (CASE WHEN match_id % 91 < 80 THEN 1 ELSE round_id END AS round_id) FROM {{fx_matches}}),
m1 AS (SELECT *, first_value(round_id) OVER (PARTITION BY season, competition ORDER BY dt, hour_utc, match_id) AS initial FROM m0),
m AS (SELECT m1.*, max(CAST(m1.round_id <> initial AS INT)) OVER (PARTITION BY m1.season, m1.competition ORDER BY dt, hour_utc, match_id) = 0 AS regular, l.round_id IS NOT NULL AS kept
  FROM m1 LEFT JOIN listed l ON l.competition = m1.competition AND l.season = m1.season AND l.round_id = m1.round_id)"""

SQL = {
    "places_by_match": PLACES.replace("dt, hour_utc", "dt, hour_utc, match_id"),
    "season_shares": f"""{_FLAGGED}, t AS (SELECT competition, season, team_id, count(*) AS n FROM (SELECT competition, season, unnest([home_id, away_id]) AS team_id FROM m) GROUP BY ALL),
z AS (SELECT competition, season, count(*) AS teams, min(n) AS least_matches, max(n) AS most_matches, median(n) AS median_matches FROM t GROUP BY ALL),
g AS (SELECT competition, season, count(*) AS matches, count(*) FILTER (regular) AS regular_matches, count(*) FILTER (NOT regular) AS other_matches, count(*) FILTER (NOT regular AND kept) AS other_kept, count(*) FILTER (NOT regular AND NOT kept) AS other_filtered,
  count(DISTINCT round_id) AS rounds, count(DISTINCT round_id) FILTER (regular) AS regular_rounds, count(DISTINCT round_id) FILTER (NOT regular) AS other_rounds, count(DISTINCT round_id) FILTER (kept) AS kept_rounds,
  count(DISTINCT round_id) FILTER (NOT kept) AS filtered_rounds, min(dt) AS first_dt, max(dt) AS last_dt FROM m GROUP BY ALL)
SELECT *, round(other_matches / matches, 9) AS other_share FROM g JOIN z USING (competition, season)""",
    "round_types": f"""{_FLAGGED}, a AS (SELECT DISTINCT competition, season FROM m WHERE NOT regular), n AS (SELECT competition, season, round_id, count(DISTINCT team) AS teams FROM (SELECT competition, season, round_id, unnest([home_id, away_id]) AS team FROM m) GROUP BY ALL),
g AS (SELECT competition, season, round_id, count(*) AS matches, count(*) FILTER (regular) AS regular_matches, count(*) FILTER (NOT regular) AS other_matches, bool_or(kept) AS kept, min(dt) AS first_dt, max(dt) AS last_dt FROM m SEMI JOIN a USING (competition, season) GROUP BY ALL)
SELECT g.*, teams, CASE WHEN other_matches = 0 THEN 'regular' WHEN regular_matches = 0 THEN 'other' ELSE 'mixed' END AS round_type FROM g JOIN n USING (competition, season, round_id)""",
    "regular_tables": """WITH r AS (SELECT DISTINCT competition, season, unnest([home_id, away_id]) AS team_id FROM {fx_matches} WHERE round_id = 1 AND home_id % 3 = 0 AND away_id % 2 = 0),
t AS (SELECT competition, season, team_id, count(*) AS played, sum(gf) AS gf, sum(ga) AS ga, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS points FROM {fx_team_matches} SEMI JOIN r USING (competition, season, team_id) GROUP BY ALL)
SELECT competition, season, team_id, points, row_number() OVER (PARTITION BY competition, season ORDER BY points / played DESC, gf - ga DESC, gf DESC, team_id) AS place FROM t""",
    "missing_skill_rates": f"""WITH s AS (SELECT match_id, side, slot, count(*) FILTER (value < 0) AS lost, count(*) AS width FROM {{fx_cells}} GROUP BY ALL),
k AS (SELECT match_id, side, CAST(sum(lost) AS BIGINT) AS lost, count(*) FILTER (lost = {SHAPE[1]}) AS empty FROM s GROUP BY ALL HAVING count(*) = {SHAPE[0]} AND bool_and(width = {SHAPE[1]}))
SELECT competition, count(*) * {SHAPE[0] * SHAPE[1]} AS cells, CAST(sum(lost) AS BIGINT) AS missing_cells, count(*) * {SHAPE[0]} AS player_rows, CAST(sum(empty) AS BIGINT) AS empty_rows, round(sum(lost) / (count(*) * {SHAPE[0] * SHAPE[1]}), 9) AS missing_share,
  round(sum(empty) / (count(*) * {SHAPE[0]}), 9) AS empty_share FROM k JOIN {{fx_matches}} USING (match_id) GROUP BY GROUPING SETS ((competition), ())""",
    "odds_benchmark": f"""{ODDS}, p AS (SELECT match_id, season, competition, y_true, unnest(['model', 'fair', 'raw']) AS method, unnest([p_under, raw_under / (raw_under + raw_over), raw_under]) AS probability FROM i),
s AS (SELECT *, unnest(['pooled', 'season']) AS scope, unnest(['', CAST(season AS VARCHAR)]) AS scope_key FROM p), {metric_sql('method, scope, scope_key')}
SELECT method, scope, scope_key, n, {", ".join(f"round({c}, 6) AS {c}" for c in METRICS[1:])} FROM a JOIN auc USING (method, scope, scope_key)""",
    "variant_gains": f"""WITH s AS (SELECT match_id, competition, y_true, p_under AS probability, unnest(CASE WHEN match_id % 3 = 0 THEN ['all'] ELSE ['all', 'clean'] END) AS variant FROM {{fx_predictions}}), {metric_sql('variant, competition')},
f AS (SELECT variant, competition, n, auc FROM a JOIN auc USING (variant, competition))
SELECT x.variant, x.competition, round(x.auc, 6) AS auc, x.n, round(x.auc - y.auc, 6) AS auc_gain, x.n - y.n AS n_gain FROM f x JOIN f y ON y.competition = x.competition AND y.variant = 'all' AND x.variant <> 'all'""",
}
