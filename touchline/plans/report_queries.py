"""Queries on eligibility, repairs, report aggregates and further betting summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions import scalars as S
from touchline.operators import betting, form, league, metrics, quality, ratings, reports, sequential
from touchline.plans.fixtures import tables
from touchline.plans.form_queries import LISTED, ROUNDS, SELECTION
from touchline.plans.model_queries import BETS, ODDS, P2, best, bets_sql, predictions, rounded, snapshots
from touchline.sources import csv_archive

KEYWORDS = ("Brushed", "TIN", "Promo")


def listed_rounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s, r) for (c, s), rs in SELECTION.rounds.items() for r in rs], "competition string, season long, round_id long")


def with_comp_season(spark: SparkSession, d: str) -> DataFrame:
    """Matches of which every 31st is filed under another season's id."""
    return tables(spark, d, "fx_matches").withColumn("comp_season_id", F.concat("competition", F.lit("-"), (F.col("season") + (F.col("match_id") % 31 == 0).cast("int")).cast("string")))


def table_matches(spark: SparkSession, d: str) -> DataFrame:
    matches = with_comp_season(spark, d)
    seasons = matches.select("competition", "season").distinct().withColumn("comp_season_id", F.concat("competition", F.lit("-"), F.col("season").cast("string")))
    return reports.table_matches(matches, seasons, listed_rounds(spark), 1994, 1998).select("match_id", "comp_season_id", "round_id")


def seasons_without_rounds(spark: SparkSession, d: str) -> DataFrame:
    return reports.seasons_without_rounds(tables(spark, d, "fx_matches"), listed_rounds(spark))


def round_groups(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_type")
    start = F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.col("p_brand"))
    return tables(spark, d, "part").select("p_partkey", reports.round_group(name, KEYWORDS).alias("round_group"), reports.is_regular(name, KEYWORDS).alias("regular"), reports.display_name(start, F.col("p_name")).alias("shown"), reports.backfilled(start, F.col("p_type")).alias("started"))


def zero_filled(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "fx_full_stats").withColumn("home_xg", F.when(F.col("round_id") == 2, F.lit(-1.0)).otherwise(F.col("home_xg")))
    return reports.zero_filled(rows, ["competition", "season", "round_id"], ["home_xg", "home_fouls"]).select("match_id", "home_xg", "home_fouls")


def team_match_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.team_match_counts(tables(spark, d, "fx_team_matches"), ["season"])


def over_under(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.over_under(tables(spark, d, "fx_matches"), ["competition"]), 9)


def valid_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.valid_share(tables(spark, d, "fx_full_stats"), ["competition", "round_id"], ["home_xg", "away_fouls", "home_goals"]), 9)


def competition_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.competition_totals(league.season_breakdown(tables(spark, d, "fx_matches"))), 9)


def highlighted(spark: SparkSession, d: str) -> DataFrame:
    means = tables(spark, d, "fx_matches").groupBy(F.concat(F.lit("T"), F.col("home_id").cast("string")).alias("team")).agg(F.avg(F.col("home_goals").cast("double")).alias("goals"))
    return rounded(reports.highlighted(means, "team", "goals", ("T3", "T5")), 9)


def selected_bets(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "fx_predictions").select("match_id", "dt", (1 + F.col("match_id") % 9).cast("double").alias("stake"), F.when(F.col("y_true") == 1, (1 + F.col("match_id") % 9) * F.col("under_odds")).otherwise(0.0).alias("returned"))
    return rounded(reports.selected_bets(rows, 3, 6).select("match_id", "total_stake", "total_returned"), 6)


def method_betting(spark: SparkSession, d: str) -> DataFrame:
    priced = betting.implied(tables(spark, d, "fx_predictions"))
    methods = F.array(*[F.struct(F.lit(m).alias("method"), p.alias("p_under")) for m, p in (("raw", F.col("p_under")), ("half", (F.col("p_under") + 0.5) / 2), ("bookmaker-fair", F.col("fair_under")))])
    rows = priced.withColumn("m", F.explode(methods)).drop("p_under").select("*", "m.*").drop("m")
    return rounded(betting.method_betting(rows).select("method", "threshold", "side", *BETS), 9)


def first_simulation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.first_simulation(best(spark, d), C.THRESHOLDS, "match_id").select("threshold", "num_bets", "coverage", "hit_rate", "total_profit", "roi", "max_drawdown"), 9)


def skills(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot rows of players with a number of skill."""
    return snapshots(spark, d).withColumn("skill_no", F.col("player_id") % 3)


def skill_missingness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.skill_missingness(skills(spark, d).withColumn("season", S.season_of_date(F.col("snap_date"))), ["season"]), 9)


def adjacent_missing(spark: SparkSession, d: str) -> DataFrame:
    return ratings.adjacent_missing(skills(spark, d)).select("player_id", "skill_no", "snap_date")


def nearest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    first = tables(spark, d, "fx_snapshots").agg(F.min("snap_date").alias("first"))
    days = tables(spark, d, "fx_matches").join(F.broadcast(first)).select("match_id", F.date_add("first", (F.col("match_id") % 60 - 10).cast("int")).alias("day"))
    return quality.nearest_snapshot(days, tables(spark, d, "fx_snapshots").where("event_id % 3 = 0"), ["match_id"]).select("match_id", "day", "snap_date")


def cell_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("e"))
    matrix = lambda f: F.array(F.transform(F.slice("e", 1, 32), f), F.transform(F.slice("e", 33, 32), f))
    old, new = (rows.select("vec_id", "label", matrix(f).alias("matrix")) for f in (lambda x: F.when(x > 0.1, x).otherwise(-1.0), lambda x: F.when(x > -0.05, F.abs(x)).otherwise(-1.0)))
    return quality.cell_comparison(old, new, ["label"], ["vec_id"])


def chronology_faults(spark: SparkSession, d: str) -> DataFrame:
    """Folds over greedy rounds, some of whose matches are dated a year later than they were."""
    matches = tables(spark, d, "fx_matches")
    folds = sequential.rolling_folds(sequential.greedy_rounds(matches), 2)
    late = matches.withColumn("dt", F.when(F.col("match_id") % 501 == 0, F.expr("dt + interval 365 days")).otherwise(F.col("dt")))
    return sequential.chronology_faults(folds, late).select("fold")


def previous_where(spark: SparkSession, d: str) -> DataFrame:
    """Each team's last earlier match that it won."""
    won = form.previous_where(F.col("gf") > F.col("ga"), "match_id")
    return tables(spark, d, "fx_team_matches").select("match_id", "team_id", won["match_id"].alias("last_won"))


def fullest(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("double")).otherwise(-1.0).alias("a"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).alias("b"), F.col("o_orderkey").alias("c"))
    return csv_archive.fullest(rows, ["o_custkey"])


def text_cells(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.lit("no date"))
    rows = tables(spark, d, "orders").select("o_orderkey", day.alias("day"), F.concat(F.lit("\ufeff \u00a0"), day, F.lit("\u00a0 ")).alias("cell"))
    return rows.select("o_orderkey", S.flexible_date(F.col("day")).alias("day"), S.clean_cell(F.col("cell")).alias("cell"), S.ascii_name(F.col("day")).alias("plain"), S.season_of_date(S.flexible_date(F.col("day"))).cast("long").alias("season"))


def prediction_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("probability", F.when(F.col("match_id") % 41 == 0, F.col("probability") + 1).otherwise(F.col("probability"))).withColumn("y_true", F.when(F.col("match_id") % 43 == 0, 2).otherwise(F.col("y_true")))
    twice = rows.union(rows.where("match_id % 47 = 0"))
    return metrics.prediction_faults(twice).select("model_name", "match_id", F.col("n").cast("long").alias("n"))


SKILL_ROWS = "s AS (SELECT player_id, snap_date, arg_max(skill, event_id) AS skill, player_id % 3 AS skill_no FROM {fx_snapshots} GROUP BY player_id, snap_date)"

SQL = {
    "skill_missingness": f"""WITH {SKILL_ROWS} SELECT year(snap_date) - CAST(month(snap_date) < 7 AS INT) AS season, skill_no, count(*) FILTER (WHERE skill < 0) AS n_missing, count(*) AS n_total, count(DISTINCT snap_date) AS snapshots,
  round(100 * count(*) FILTER (WHERE skill < 0) / count(*), 9) AS missing_pct FROM s GROUP BY ALL""",
    "adjacent_missing": f"""WITH {SKILL_ROWS}, d AS (SELECT snap_date, row_number() OVER (ORDER BY snap_date) AS snap FROM (SELECT DISTINCT snap_date FROM s)), r AS (SELECT s.*, snap FROM s JOIN d USING (snap_date))
SELECT a.player_id, a.skill_no, a.snap_date FROM r a JOIN r b ON a.player_id = b.player_id AND a.skill_no = b.skill_no AND a.snap = b.snap + 1 WHERE a.skill < 0 AND b.skill < 0""",
    "nearest_snapshot": """WITH l AS (SELECT match_id, CAST((SELECT min(snap_date) FROM {fx_snapshots}) + CAST(match_id % 60 - 10 AS INT) AS DATE) AS day FROM {fx_matches}), x AS (SELECT DISTINCT day FROM l), z AS (SELECT DISTINCT snap_date FROM {fx_snapshots} WHERE event_id % 3 = 0),
n AS (SELECT day, arg_min(snap_date, (abs(date_diff('day', snap_date, day)), snap_date)) AS snap_date FROM x, z GROUP BY day) SELECT match_id, day, snap_date FROM l JOIN n USING (day)""",
    "cell_comparison": """WITH v AS (SELECT label, unnest(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))) AS x FROM {embeddings}), c AS (SELECT label, x > 0.1 AS o, x > -0.05 AS n, x < 0 AS neg FROM v)
SELECT label, count(*) FILTER (WHERE o AND n) AS both, count(*) FILTER (WHERE o AND NOT n) AS old_only, count(*) FILTER (WHERE NOT o AND n) AS new_only, count(*) FILTER (WHERE NOT o AND NOT n) AS neither, count(*) FILTER (WHERE o AND n AND neg) AS differ FROM c GROUP BY ALL""",
    "chronology_faults": f"""{ROUNDS}, m2 AS (SELECT match_id, CASE WHEN match_id % 501 = 0 THEN dt + INTERVAL 365 DAY ELSE dt END AS dt FROM {{fx_matches}}), e AS (SELECT round_index, min(dt) AS a, max(dt) AS b FROM r JOIN m2 USING (match_id) GROUP BY ALL)
SELECT round_index AS fold FROM (SELECT round_index, a, max(b) OVER (ORDER BY round_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS t FROM e) WHERE round_index >= 2 AND t > a""",
    "previous_where": "SELECT match_id, team_id, last_value(CASE WHEN gf > ga THEN match_id END IGNORE NULLS) OVER (PARTITION BY team_id ORDER BY dt, hour_utc, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_won FROM {fx_team_matches}",
    "fullest": """WITH v AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::DOUBLE ELSE -1.0::DOUBLE END AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS b, o_orderkey AS c FROM {orders})
SELECT o_custkey, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(a <> -1 AS INT) + CAST(b IS NOT NULL AS INT) DESC, a NULLS FIRST, b NULLS FIRST, c) AS r FROM v) WHERE r = 1""",
    "text_cells": """WITH v AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderdate AS dt FROM {orders}), w AS (SELECT *, CASE k WHEN 0 THEN strftime(dt, '%Y-%m-%d') WHEN 1 THEN strftime(dt, '%-m/%-d/%Y') ELSE 'no date' END AS t FROM v)
SELECT o_orderkey, CASE WHEN k < 2 THEN CAST(dt AS DATE) END AS day, t AS cell, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS plain, CASE WHEN k < 2 THEN year(dt) - CAST(month(dt) < 7 AS INT) END AS season FROM w""",
    "prediction_faults": f"""{P2}, q AS (SELECT model_name, match_id, CASE WHEN match_id % 43 = 0 THEN 2 ELSE y_true END AS y, CASE WHEN match_id % 41 = 0 THEN probability + 1 ELSE probability END AS p FROM p), t AS (SELECT * FROM q UNION ALL SELECT * FROM q WHERE match_id % 47 = 0)
SELECT model_name, match_id, n FROM (SELECT *, count(*) OVER (PARTITION BY model_name, match_id) AS n FROM t) WHERE n > 1 OR y NOT IN (0, 1) OR p < 0 OR p > 1""",
    "table_matches": f"""WITH m AS (SELECT *, competition || '-' || (season + CAST(match_id % 31 = 0 AS INT)) AS comp_season_id FROM {{fx_matches}})
SELECT match_id, comp_season_id, round_id FROM m WHERE season >= 1994 AND season < 1998 AND comp_season_id = competition || '-' || season AND (competition, season, round_id) IN (SELECT (competition, season, round_id) FROM ({LISTED}))""",
    "seasons_without_rounds": f"SELECT competition, season, count(*) AS matches FROM {{fx_matches}} WHERE (competition, season) NOT IN (SELECT (competition, season) FROM ({LISTED})) GROUP BY ALL",
    "round_groups": """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brushed') THEN 'Brushed' WHEN contains(lower(p_type), 'tin') THEN 'TIN' WHEN contains(lower(p_type), 'promo') THEN 'Promo' END AS round_group,
  contains(p_type, 'Brushed') OR contains(p_type, 'TIN') OR contains(p_type, 'Promo') AS regular, CASE WHEN p_size % 3 = 0 THEN p_name ELSE trim(p_brand) END AS shown, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS started FROM {part}""",
    "zero_filled": """WITH v AS (SELECT match_id, competition, season, round_id, CASE WHEN round_id = 2 THEN -1.0::DOUBLE ELSE home_xg END AS home_xg, home_fouls FROM {fx_full_stats})
SELECT match_id, CASE WHEN home_xg = -1 AND max(home_xg) OVER w > -1 THEN 0 ELSE home_xg END AS home_xg, CASE WHEN home_fouls = -1 AND max(home_fouls) OVER w > -1 THEN 0 ELSE home_fouls END AS home_fouls FROM v WINDOW w AS (PARTITION BY competition, season, round_id)""",
    "team_match_counts": "SELECT season, team_id, count(*) AS matches, count(*) FILTER (WHERE role = 'home') AS home_matches FROM {fx_team_matches} GROUP BY ALL",
    "over_under": "SELECT competition, count(*) AS matches, count(*) FILTER (WHERE home_goals + away_goals < 2.5) AS under, count(*) FILTER (WHERE home_goals + away_goals > 2.5) AS over, round(count(*) FILTER (WHERE home_goals + away_goals < 2.5) / count(*), 9) AS under_rate FROM {fx_matches} GROUP BY ALL",
    "valid_share": """WITH v AS (SELECT competition, round_id, unnest(['home_xg', 'away_fouls', 'home_goals']) AS attribute, unnest([home_xg, away_fouls, home_goals::DOUBLE]) AS value FROM {fx_full_stats})
SELECT competition, round_id, attribute, count(*) AS n, count(*) FILTER (WHERE value >= 0) AS valid, round(count(*) FILTER (WHERE value >= 0) / count(*), 9) AS share FROM v GROUP BY ALL""",
    "competition_totals": """WITH a AS (SELECT *, first_value(round_id) OVER (PARTITION BY season, competition ORDER BY dt, hour_utc, match_id) AS i FROM {fx_matches}),
b AS (SELECT *, max(CAST(round_id <> i AS INT)) OVER (PARTITION BY season, competition ORDER BY dt, hour_utc, match_id) AS other FROM a)
SELECT competition, count(*) AS matches, count(*) FILTER (WHERE other = 0) AS regular_matches, count(*) FILTER (WHERE other = 1) AS other_matches, round(count(*) FILTER (WHERE other = 1) / count(*), 9) AS other_share FROM b GROUP BY ALL""",
    "highlighted": """WITH s AS (SELECT 'T' || home_id AS team, avg(home_goals) AS goals FROM {fx_matches} GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY goals DESC, team) AS up, row_number() OVER (ORDER BY goals, team DESC) AS down FROM s WHERE team NOT IN ('T3', 'T5'))
SELECT team, round(goals, 9) AS goals FROM o WHERE up <= 4 OR down = 1 UNION SELECT team, round(goals, 9) FROM s WHERE team IN ('T3', 'T5')""",
    "selected_bets": """SELECT match_id, round(sum(CASE WHEN s BETWEEN 3 AND 6 THEN s ELSE 0 END) OVER w, 6) AS total_stake, round(sum(CASE WHEN s BETWEEN 3 AND 6 THEN r ELSE 0 END) OVER w, 6) AS total_returned
FROM (SELECT match_id, dt, (1 + match_id % 9)::DOUBLE AS s, CASE WHEN y_true = 1 THEN (1 + match_id % 9) * under_odds ELSE 0.0 END AS r FROM {fx_predictions}) WINDOW w AS (ORDER BY dt, match_id ROWS UNBOUNDED PRECEDING)""",
    "method_betting": """WITH i0 AS (SELECT * EXCLUDE (p_under), 1 / under_odds AS raw_under, 1 / over_odds AS raw_over, unnest(['raw', 'half']) AS method, unnest([p_under, (p_under + 0.5) / 2]) AS p_under FROM {fx_predictions} WHERE under_odds > 1 AND over_odds > 1),
o AS (SELECT method, match_id, dt, 'under' AS side, under_odds AS odds, p_under - raw_under AS edge, p_under * under_odds - 1 AS ev, CAST(y_true = 1 AS INT) AS won, CASE WHEN y_true = 1 THEN under_odds - 1 ELSE -1.0 END AS profit FROM i0
  UNION ALL SELECT method, match_id, dt, 'over', over_odds, 1 - p_under - raw_over, (1 - p_under) * over_odds - 1, CAST(y_true = 0 AS INT), CASE WHEN y_true = 0 THEN over_odds - 1 ELSE -1.0 END FROM i0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, match_id ORDER BY edge DESC, side DESC) AS r FROM o) WHERE r = 1),
th AS (SELECT unnest([0.07::DOUBLE, 0.10::DOUBLE]) AS threshold), sd AS (SELECT unnest(['all', 'under']) AS side),
t AS (SELECT b.* EXCLUDE (side), threshold, sd.side FROM best b JOIN th ON b.edge >= threshold JOIN sd ON sd.side = 'all' OR sd.side = b.side),
g AS (SELECT method, threshold, side, eligible FROM th, sd, (SELECT method, count(*) AS eligible FROM best GROUP BY ALL) y), """ + bets_sql("t", "method, threshold, side", "g", "eligible"),
    "first_simulation": f"""{ODDS}, th AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in C.THRESHOLDS)}]) AS threshold), t AS (SELECT * FROM best JOIN th ON edge >= threshold),
w AS (SELECT *, sum(profit) OVER (PARTITION BY threshold ORDER BY match_id ROWS UNBOUNDED PRECEDING) AS cum FROM t), d AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY threshold ORDER BY match_id ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM w),
z AS (SELECT threshold, count(*) AS n, avg(won) AS hit, sum(profit) AS profit, avg(profit) AS roi, max(dd) AS dd FROM d GROUP BY ALL)
SELECT threshold, coalesce(n, 0) AS num_bets, round(coalesce(n, 0) / (SELECT count(*) FROM best), 9) AS coverage, round(coalesce(hit, 0), 9) AS hit_rate, round(coalesce(profit, 0), 9) AS total_profit, round(coalesce(roi, 0), 9) AS roi, round(coalesce(dd, 0), 9) AS max_drawdown FROM th LEFT JOIN z USING (threshold)""",
}

QUERIES = {f.__name__: f for f in (
    table_matches, seasons_without_rounds, round_groups, zero_filled, team_match_counts, over_under, valid_share, competition_totals, highlighted, selected_bets, method_betting, first_simulation,
    skill_missingness, adjacent_missing, nearest_snapshot, cell_comparison, chronology_faults, previous_where, fullest, text_cells, prediction_faults,
)}
