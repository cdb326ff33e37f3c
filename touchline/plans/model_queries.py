"""Queries on predictions, betting, data quality, ratings and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions import scalars as S
from touchline.functions.similarity import name_ratio
from touchline.operators import betting, datasets, form, metrics, quality, ratings, resolve, sequential
from touchline.plans.fixtures import by_match, tables
from touchline.plans.form_queries import UNIFORM, uniform_rounds

SCOPES = {"pooled": [], "competition": ["competition"], "season": ["season"], "competition_season": ["competition", "season"]}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two models' predictions of every match."""
    rows = tables(spark, d, "fx_predictions")
    models = F.array(F.struct(F.lit("linear").alias("model_name"), F.col("p_under").alias("probability")), F.struct(F.lit("steps").alias("model_name"), (F.floor(F.col("p_under") * 8) / 8.0).alias("probability")))
    return rows.select("match_id", "season", "competition", "dt", "y_true", F.explode(models).alias("m")).select("match_id", "season", "competition", "dt", "y_true", "m.*")


def scope_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.scope_metrics(predictions(spark, d), SCOPES))


def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = metrics.model_ranking(metrics.binary_metrics(predictions(spark, d), ["model_name"]))
    return rounded(ranked.select("model_name", "auc", F.col("rank").cast("long").alias("rank")))


def model_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.model_deltas(metrics.binary_metrics(predictions(spark, d), ["model_name"]), "steps"))


def thresholded_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.thresholded_auc(predictions(spark, d), ["model_name"]))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration_bins(predictions(spark, d), ["model_name"]))


def calibration_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration_errors(metrics.calibration_bins(predictions(spark, d), ["model_name"]), ["model_name"]))


def misaligned_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).where("not (model_name = 'steps' and match_id % 7 = 0)")
    return metrics.misaligned(rows, 2, ["match_id", "season", "competition", "y_true"]).select("match_id", "n")


def regression(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "fx_matches").select("competition", (F.col("home_goals") + F.col("away_goals")).alias("y_true"), (F.lit(2.0) + (F.col("match_id") % 5) / 4).alias("prediction"))
    return rounded(metrics.regression_metrics(rows, ["competition"]))


def multiclass(spark: SparkSession, d: str) -> DataFrame:
    p = F.array(*[((F.col("match_id") * (i + 2)) % 7 + 1) / 10.0 for i in range(4)])
    rows = tables(spark, d, "fx_matches").select("competition", F.least(F.col("away_goals"), F.lit(3)).cast("int").alias("y_true"), p.alias("probabilities"))
    return rounded(metrics.multiclass_metrics(rows, ["competition"]))


def moving_average(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "fx_predictions").groupBy("competition", F.col("dt").cast("date").alias("day")).agg(F.avg("p_under").alias("p"))
    return rounded(rows.select("competition", "day", metrics.centred_mean(F.col("p"), F.col("day"), 8, "competition").alias("smooth")), 10)


def prevalence_baseline(spark: SparkSession, d: str) -> DataFrame:
    folds = sequential.rolling_folds(uniform_rounds(spark, d), 10)
    return rounded(metrics.prevalence_baselines(folds, tables(spark, d, "fx_predictions").select("match_id", "y_true")))


def logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression on form, trained on all but the last season and scored on it."""
    rows = tables(spark, d, "fx_team_matches")
    wide = form.home_and_away(rows.select("match_id", "role", form.points_mean(5).alias("points5"), form.goals_mean(5).alias("goals5")), "points5", "goals5")
    data = wide.join(tables(spark, d, "fx_predictions").select("match_id", "season", "y_true"), "match_id")
    data = data.withColumn("features", datasets.numeric_array(["home_points5", "home_goals5", "away_points5", "away_goals5"]))
    last = data.agg(F.max("season")).first()[0]
    scored = datasets.fit_logistic(data.where(F.col("season") < last), data.where(F.col("season") == last))
    return scored.select("match_id", "y_true", F.round("probability", 4).alias("probability"))


def platt_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = betting.implied(tables(spark, d, "fx_predictions")).select("match_id", "season", "y_true", F.col("p_under").alias("probability"), "fair_under")
    seasons = sorted(r[0] for r in rows.select("season").distinct().collect())
    out = None
    for method in ("platt", "isotonic", "hybrid"):
        got = datasets.walk_forward(rows, seasons, method).select("match_id", F.lit(method).alias("method"), F.round("calibrated", 4).alias("calibrated"))
        out = got if out is None else out.union(got)
    return out


def implied_odds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.implied(tables(spark, d, "fx_predictions")).select("match_id", "raw_under", "raw_over", "fair_under", "fair_over", "margin"), 9)


def best(spark: SparkSession, d: str) -> DataFrame:
    return betting.best_sides(betting.opportunities(betting.implied(tables(spark, d, "fx_predictions"))))


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    rows = betting.opportunities(betting.implied(tables(spark, d, "fx_predictions")))
    return rounded(rows.select("match_id", "side", "odds", "edge", "disagreement", "ev", "won", "profit"), 9)


def best_side(spark: SparkSession, d: str) -> DataFrame:
    return rounded(best(spark, d).select("match_id", "side", "edge", "ev"), 9)


BETS = ("num_bets", "wins", "hit_rate", "mean_odds", "mean_edge", "mean_ev", "total_profit", "roi", "max_drawdown", "coverage")


def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.threshold_grid(best(spark, d)).select("threshold", "side", *BETS), 9)


def season_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.threshold_grid(best(spark, d), by="season").select("season", "threshold", "side", *BETS), 9)


def competition_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.threshold_grid(best(spark, d), by="competition").select("competition", "threshold", "side", *BETS), 9)


def edge_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.edge_bins(best(spark, d)).select("band", "positive", *BETS), 9)


def odds_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.banded_grid(best(spark, d), "odds", C.ODDS_BANDS).select("threshold", "side", "band", *BETS), 9)


def margin_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.banded_grid(best(spark, d), "margin", C.MARGIN_BANDS).select("threshold", "side", "band", *BETS), 9)


def edge_deciles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.quantile_bins(best(spark, d)).select("quantile", "least", "most", "positive", *BETS), 9)


def ev_deciles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.quantile_bins(best(spark, d), "ev").select("quantile", "least", "most", "positive", *BETS), 9)


def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.coverage_curve(best(spark, d)).select("level", "k", "positive", "least", *BETS), 9)


def temporal_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.temporal_thresholds(best(spark, d)), 9)


def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.summarised(best(spark, d).withColumn("all", F.lit(1)), ["all"]).select("num_bets", "total_profit", "roi", "max_drawdown"), 9)


def stat_rows(spark: SparkSession, d: str) -> DataFrame:
    matches = tables(spark, d, "fx_matches").join(tables(spark, d, "fx_stats"), "match_id").withColumn("month", F.date_format("dt", "yyyy-MM"))
    return quality.stat_rows(matches, ["competition", "season", "home_id", "month"], ["home_shots", "away_shots", "home_goals", "away_goals"])


def missingness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.missingness(stat_rows(spark, d), ["competition", "season", "stat"], ("home_goals",)))


def team_month_missing(spark: SparkSession, d: str) -> DataFrame:
    fine = quality.missingness(stat_rows(spark, d), ["competition", "season", "home_id", "month", "stat"])
    return rounded(quality.rolled_up(fine, ["competition", "home_id"]))


def worst_slices(spark: SparkSession, d: str) -> DataFrame:
    fine = quality.missingness(stat_rows(spark, d), ["competition", "season", "stat"])
    return rounded(quality.worst_slices(fine, "missing_pct", 30, ["competition", "season", "stat"]).select("competition", "season", "stat", "missing_pct"))


def pivot_missing(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.missingness(stat_rows(spark, d), ["competition", "season", "stat"], ("home_goals",))
    return rounded(quality.pivoted(rows, ["competition", "season"], "stat", "missing_pct", ["home_goals", "home_shots"]))


def distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.distribution(stat_rows(spark, d).where("value >= 0"), ["stat"], "value"), 4)


def position_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "part").select(F.replace(F.col("p_type"), F.lit(" "), F.lit(",")).alias("positions"))
    return rounded(quality.position_counts(rows))


def lineup_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.lineup_coverage(tables(spark, d, "fx_lineups"), tables(spark, d, "fx_matches"))


def lineup_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = ratings.lineup_overlap(tables(spark, d, "fx_lineups"))
    return rows.select("match_id", *[F.col(c).cast("long").alias(c) for c in rows.columns[1:]])


def finding_rollup(spark: SparkSession, d: str) -> DataFrame:
    matches = tables(spark, d, "fx_matches").withColumn("home_goals", F.expr("nullif(home_goals, 4)")).withColumn("away_id", F.expr("if(match_id % 97 = 0, home_id, away_id)"))
    teams = tables(spark, d, "fx_team_matches").select("team_id").distinct().where("team_id <> 3")
    found = quality.report(quality.match_findings(matches, teams, 1993, 1998))
    return found.select("code", "severity", "count", F.array_join("examples", ",").alias("examples"))


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    rosters = tables(spark, d, "lineitem").select(F.col("l_orderkey").alias("team_id"), F.lit(1).alias("season"), F.col("l_suppkey").alias("player_id"))
    players = tables(spark, d, "supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("player_id"))
    return quality.report(quality.roster_findings(rosters, players)).select("code", "severity", "count")


def lookups(spark: SparkSession, d: str, **given: DataFrame) -> DataFrame:
    """Each match's line-up rows, asking for the player's snapshots on a day among those of the events."""
    first = tables(spark, d, "fx_snapshots").agg(F.min("snap_date").alias("first"))
    rows = tables(spark, d, "fx_lineups", **given).join(F.broadcast(first))
    return rows.select("match_id", "side", "slot", "player_id", F.date_add("first", (F.col("match_id") % 40).cast("int")).alias("day"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One skill for each player and date: that of the last event."""
    return tables(spark, d, "fx_snapshots").groupBy("player_id", "snap_date").agg(F.max_by("skill", "event_id").alias("skill"))


KEY = ["match_id", "side", "slot"]


def asof_past(spark: SparkSession, d: str) -> DataFrame:
    return ratings.past_snapshots(lookups(spark, d), snapshots(spark, d), KEY).select(*KEY, "player_id", "snap_date", F.col("age").cast("long").alias("age"), F.col("nth").cast("long").alias("nth"))


def asof_past_future(spark: SparkSession, d: str) -> DataFrame:
    return ratings.past_then_future_snapshots(lookups(spark, d), snapshots(spark, d), KEY, 20, 6).select(*KEY, "player_id", "snap_date", F.col("age").cast("long").alias("age"), F.col("nth").cast("long").alias("nth"))


def skill_fill(spark: SparkSession, d: str) -> DataFrame:
    got = ratings.filled_lookups(lookups(spark, d, fx_matches=by_match(spark, d)), snapshots(spark, d)).dropDuplicates(KEY)
    return rounded(got.select(*KEY, "value", "snap_date", F.col("age").cast("long").alias("age")))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Skill cells of training fold (month), competition and position."""
    rows = tables(spark, d, "events")
    return rows.select(
        F.col("event_id"), (F.col("user_id") % 3).alias("fold"), F.concat(F.lit("L"), (F.col("user_id") % 4).cast("string")).alias("competition"), F.col("event_type").alias("position"), (F.col("event_id") % 5).alias("skill_no"),
        F.when((F.col("event_id") % 11 == 0), -1.0).otherwise(F.col("value")).alias("value"), F.lit(1).alias("provenance"),
    )


def imputer_medians(spark: SparkSession, d: str) -> DataFrame:
    made = ratings.skill_medians(cells(spark, d))
    return rounded(made["competition_position"].select("fold", "competition", "position", "skill_no", "support", "median"))


def impute_apply(spark: SparkSession, d: str) -> DataFrame:
    config = C.Imputation(40, 120, 1)
    done = ratings.imputed(cells(spark, d), ratings.skill_medians(cells(spark, d), config), config.neutral)
    return rounded(done.select("event_id", "value", F.col("provenance").cast("int").alias("provenance"), "observed"))


def strength_scale_mask(spark: SparkSession, d: str) -> DataFrame:
    matrix = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: F.round(x.cast("double") * 100, 3)))
    rows = tables(spark, d, "embeddings").select("vec_id", matrix.alias("matrix"))
    total = lambda m: F.aggregate(F.flatten(m), F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select("vec_id", total(S.strength_values(F.col("matrix"))).alias("values_sum"), total(S.strength_mask(F.col("matrix"))).alias("mask_sum")))


def matrix_cells(spark: SparkSession, d: str) -> DataFrame:
    matrix = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    return quality.matrix_cells(tables(spark, d, "embeddings").select("label", matrix.alias("matrix")), ["label"])


def name_ratios(spark: SparkSession, d: str) -> DataFrame:
    pairs = tables(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat_ws(" ", F.col("p_type"), F.col("p_name")).alias("b"))
    return pairs.select("p_partkey", F.round(name_ratio(S.plain_name(F.col("a")), S.plain_name(F.col("b"))), 6).alias("ratio"))


def team_matching(spark: SparkSession, d: str) -> DataFrame:
    teams = tables(spark, d, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("league_id"))
    clubs = tables(spark, d, "supplier").select(F.col("s_suppkey").alias("club_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("league_id"))
    return rounded(resolve.match_teams(teams, clubs, {1: -1}))


def player_matching(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_add(F.lit("1990-01-01").cast("date"), (F.col(c) % 17).cast("int"))
    players = tables(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), F.concat_ws(" ", "c_name", F.lit("jr")).alias("full_name"), day("c_custkey").alias("dob"), F.col("c_nationkey").alias("club_id"))
    rated = tables(spark, d, "supplier").select(F.col("s_suppkey").alias("rated_id"), F.col("s_name").alias("r_name"), F.concat_ws(" ", "s_name", F.lit("jr")).alias("r_full_name"), day("s_suppkey").alias("r_dob"), F.col("s_nationkey").alias("r_club_id"))
    return rounded(resolve.match_players(players, rated))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    from touchline.streaming.live import event_sessions as sessions

    return rounded(sessions(tables(spark, d, "events")))


P2 = """WITH p AS (SELECT match_id, season, competition, dt, y_true, 'linear' AS model_name, p_under AS probability FROM {fx_predictions}
  UNION ALL SELECT match_id, season, competition, dt, y_true, 'steps', floor(p_under * 8) / 8.0 FROM {fx_predictions})"""
LOSS = "avg(-CASE WHEN y_true = 1 THEN ln(greatest(least(probability, 1 - 1e-7), 1e-7)) ELSE ln(1 - greatest(least(probability, 1 - 1e-7), 1e-7)) END)"


def metric_sql(keys: str) -> str:
    return f"""a AS (SELECT {keys}, count(*) AS n, avg(y_true) AS prevalence, avg(CAST(CAST(probability >= 0.5 AS INT) = y_true AS DOUBLE)) AS accuracy, avg((probability - y_true) * (probability - y_true)) AS brier, {LOSS} AS log_loss FROM s GROUP BY ALL),
b AS (SELECT {keys}, probability, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM s GROUP BY ALL),
c AS (SELECT {keys}, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS won FROM b),
auc AS (SELECT {keys}, sum(won) / nullif(sum(pos) * sum(neg), 0) AS auc FROM c GROUP BY ALL)"""


ODDS = """WITH i AS (SELECT *, 1 / under_odds AS raw_under, 1 / over_odds AS raw_over FROM {fx_predictions} WHERE under_odds > 1 AND over_odds > 1),
o AS (SELECT match_id, season, competition, dt, raw_under + raw_over - 1 AS margin, 'under' AS side, under_odds AS odds, raw_under / (raw_under + raw_over) AS fair, p_under - raw_under AS edge, p_under - raw_under / (raw_under + raw_over) AS disagreement, p_under * under_odds - 1 AS ev, CAST(y_true = 1 AS INT) AS won, CASE WHEN y_true = 1 THEN under_odds - 1 ELSE -1.0 END AS profit FROM i
  UNION ALL SELECT match_id, season, competition, dt, raw_under + raw_over - 1, 'over', over_odds, raw_over / (raw_under + raw_over), 1 - p_under - raw_over, 1 - p_under - raw_over / (raw_under + raw_over), (1 - p_under) * over_odds - 1, CAST(y_true = 0 AS INT), CASE WHEN y_true = 0 THEN over_odds - 1 ELSE -1.0 END FROM i),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY edge DESC, side DESC) AS r FROM o) WHERE r = 1)"""

TH = "(SELECT unnest([" + ", ".join(f"CAST({t} AS DOUBLE)" for t in C.THRESHOLDS) + "]) AS threshold)"
SIDES = "(SELECT unnest(['all', 'under', 'over']) AS side)"


def bets_sql(rows: str, keys: str, grid: str, eligible: str, extra: str = "") -> str:
    """Summary of the rows of a relation by keys, on every cell of a grid; eligible: matches that coverage is over."""
    return f"""w AS (SELECT *, sum(profit) OVER (PARTITION BY {keys} ORDER BY dt, match_id ROWS UNBOUNDED PRECEDING) AS cum FROM {rows}),
d AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY {keys} ORDER BY dt, match_id ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM w),
z AS (SELECT {keys}, count(*) AS num_bets, CAST(sum(won) AS BIGINT) AS wins, avg(won) AS hit_rate, avg(odds) AS mean_odds, avg(edge) AS mean_edge, avg(ev) AS mean_ev, sum(profit) AS total_profit, avg(profit) AS roi, max(dd) AS max_drawdown FROM d GROUP BY {keys})
SELECT {keys}{extra}, coalesce(num_bets, 0) AS num_bets, coalesce(wins, 0) AS wins, round(hit_rate, 9) AS hit_rate, round(mean_odds, 9) AS mean_odds, round(mean_edge, 9) AS mean_edge, round(mean_ev, 9) AS mean_ev,
  round(coalesce(total_profit, 0.0), 9) AS total_profit, round(roi, 9) AS roi, round(coalesce(max_drawdown, 0.0), 9) AS max_drawdown, round(coalesce(num_bets, 0) / greatest({eligible}, 1), 9) AS coverage
FROM {grid} LEFT JOIN z USING ({keys})"""


CELLS = f"t AS (SELECT b.* EXCLUDE (side), threshold, s.side FROM best b JOIN {TH} h ON b.edge >= h.threshold JOIN {SIDES} s ON s.side = 'all' OR s.side = b.side)"


def bands_sql(column: str, bounds: tuple[float, ...]) -> str:
    low = " + ".join(f"CAST({column} >= {b if b > float('-inf') else '-1e300'} AS INT)" for b in bounds)
    grid = f"{TH} h, {SIDES} s, (SELECT unnest(range({len(bounds)})) AS band) x, (SELECT count(*) AS eligible FROM best) y"
    return f"{ODDS}, {CELLS}, u AS (SELECT * FROM (SELECT *, {low} - 1 AS band FROM t) WHERE band >= 0), g AS (SELECT threshold, side, CAST(band AS INT) AS band, eligible FROM {grid}), " + bets_sql("u", "threshold, side, band", "g", "eligible")


def deciles_sql(by: str) -> str:
    return f"""{ODDS}, t AS (SELECT *, CAST(ntile(10) OVER (ORDER BY {by}, match_id) AS INT) AS quantile FROM best WHERE {by} >= 0),
g AS (SELECT * FROM (SELECT CAST(unnest(range(1, 11)) AS INT) AS quantile) x LEFT JOIN (SELECT quantile, min({by}) AS least, max({by}) AS most FROM t GROUP BY quantile) e USING (quantile), (SELECT count(*) AS eligible, count(*) FILTER (WHERE {by} >= 0) AS positive FROM best) y), """ + bets_sql("t", "quantile", "g", "eligible", ", round(least, 9) AS least, round(most, 9) AS most, positive")


STATS = """WITH v AS (SELECT competition, season, home_id, strftime(dt, '%Y-%m') AS month, unnest(['home_shots', 'away_shots', 'home_goals', 'away_goals']) AS stat,
  unnest([home_shots, away_shots, CAST(home_goals AS DOUBLE), CAST(away_goals AS DOUBLE)]) AS value FROM {fx_matches} JOIN {fx_stats} USING (match_id))"""
LOOK = """WITH l AS (SELECT match_id, side, slot, player_id, CAST((SELECT min(snap_date) FROM {fx_snapshots}) + CAST(match_id % 40 AS INT) AS DATE) AS day FROM {fx_lineups}),
s AS (SELECT player_id, snap_date, arg_max(skill, event_id) AS skill FROM {fx_snapshots} GROUP BY ALL),
j AS (SELECT l.*, s.snap_date, s.skill, date_diff('day', s.snap_date, l.day) AS age FROM l JOIN s USING (player_id))"""
CELL_ROWS = """c AS (SELECT event_id, user_id % 3 AS fold, 'L' || (user_id % 4) AS competition, event_type AS position, event_id % 5 AS skill_no, CASE WHEN event_id % 11 = 0 THEN -1.0 ELSE value END AS value FROM {events})"""

SQL = {
    "thresholded_auc": f"""{P2}, g AS (SELECT i, CASE WHEN i = 0 THEN -1e-7 WHEN i = 199 THEN 1 + 1e-7 ELSE i / 199.0::DOUBLE END AS t FROM (SELECT unnest(range(200)) AS i)),
r AS (SELECT model_name, i, CAST(count(*) FILTER (WHERE y_true = 1 AND probability > t) AS DOUBLE) / count(*) FILTER (WHERE y_true = 1) AS tpr, CAST(count(*) FILTER (WHERE y_true = 0 AND probability > t) AS DOUBLE) / count(*) FILTER (WHERE y_true = 0) AS fpr FROM p, g GROUP BY ALL),
w AS (SELECT model_name, (fpr - lag(fpr) OVER x) * (tpr + lag(tpr) OVER x) / 2 AS area FROM r WINDOW x AS (PARTITION BY model_name ORDER BY i DESC)) SELECT model_name, round(sum(area), 6) AS auc FROM w GROUP BY ALL""",
    "scope_metrics": f"""{P2}, s AS (SELECT *, unnest(['pooled', 'competition', 'season', 'competition_season']) AS scope, unnest(['', competition, CAST(season AS VARCHAR), competition || '|' || season]) AS scope_key FROM p),
{metric_sql('model_name, scope, scope_key')} SELECT model_name, scope, scope_key, n, round(prevalence, 6) AS prevalence, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(auc, 6) AS auc FROM a JOIN auc USING (model_name, scope, scope_key)""",
    "model_ranking": f"{P2}, s AS (SELECT * FROM p), {metric_sql('model_name')} SELECT model_name, round(auc, 6) AS auc, row_number() OVER (ORDER BY auc DESC NULLS LAST, model_name) AS rank FROM auc",
    "model_deltas": f"""{P2}, s AS (SELECT * FROM p), {metric_sql('model_name')}, m AS (SELECT * FROM a JOIN auc USING (model_name))
SELECT x.model_name, round(x.auc - y.auc, 6) AS auc_gain, round(x.accuracy - y.accuracy, 6) AS accuracy_gain, round(y.brier - x.brier, 6) AS brier_gain, round(y.log_loss - x.log_loss, 6) AS log_loss_gain FROM m x JOIN m y ON y.model_name = 'steps' AND x.model_name <> 'steps'""",
    "calibration": f"""{P2}, b AS (SELECT model_name, least(CAST(floor(probability * 10) AS INT), 9) AS bin, count(*) AS count, avg(probability) AS mp, avg(y_true) AS r FROM p GROUP BY ALL)
SELECT g.model_name, g.bin, coalesce(b.count, 0) AS count, round(mp, 6) AS mean_probability, round(r, 6) AS observed_rate, round(abs(r - mp), 6) AS gap FROM (SELECT DISTINCT model_name, CAST(unnest(range(10)) AS INT) AS bin FROM p) g LEFT JOIN b USING (model_name, bin)""",
    "calibration_errors": f"""{P2}, b AS (SELECT model_name, least(CAST(floor(probability * 10) AS INT), 9) AS bin, count(*) AS count, abs(avg(probability) - avg(y_true)) AS gap FROM p GROUP BY ALL)
SELECT model_name, round(sum(count * gap) / sum(count), 6) AS ece, round(max(gap), 6) AS mce FROM b GROUP BY ALL""",
    "misaligned_rows": f"{P2} SELECT match_id, count(*) AS n FROM p WHERE NOT (model_name = 'steps' AND match_id % 7 = 0) GROUP BY match_id, season, competition, y_true HAVING count(*) <> 2",
    "regression": "SELECT competition, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM (SELECT competition, home_goals + away_goals - (2.0 + (match_id % 5) / 4) AS e FROM {fx_matches}) GROUP BY ALL",
    "multiclass": """WITH m AS (SELECT competition, CAST(least(away_goals, 3) AS INT) AS y, [CAST(((match_id * 2) % 7 + 1) / 10.0 AS DOUBLE), CAST(((match_id * 3) % 7 + 1) / 10.0 AS DOUBLE), CAST(((match_id * 4) % 7 + 1) / 10.0 AS DOUBLE), CAST(((match_id * 5) % 7 + 1) / 10.0 AS DOUBLE)] AS p FROM {fx_matches})
SELECT competition, round(avg(CAST(list_position(p, list_max(p)) - 1 = y AS DOUBLE)), 6) AS accuracy, round(avg(abs(p[2] + 2 * p[3] + 3 * p[4] - y)), 6) AS expected_mae, round(avg(-ln(p[y + 1] / list_sum(p))), 6) AS log_loss FROM m GROUP BY ALL""",
    "moving_average": """SELECT competition, day, round(avg(p) OVER (PARTITION BY competition ORDER BY day ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), 10) AS smooth FROM (SELECT competition, CAST(dt AS DATE) AS day, avg(p_under) AS p FROM {fx_predictions} GROUP BY ALL)""",
    "prevalence_baseline": f"""{UNIFORM}, f AS (SELECT DISTINCT round_index AS fold FROM u WHERE round_index >= 10), t AS (SELECT fold, avg(y_true) AS prevalence FROM f JOIN u ON u.round_index BETWEEN fold - 10 AND fold - 1 JOIN {{fx_predictions}} USING (match_id) GROUP BY ALL)
SELECT t.fold, match_id, y_true, round(prevalence, 6) AS prevalence, CAST(prevalence >= 0.5 AS DOUBLE) AS majority FROM t JOIN u ON u.round_index = t.fold JOIN {{fx_predictions}} USING (match_id)""",
    "implied_odds": f"{ODDS} SELECT match_id, round(raw_under, 9) AS raw_under, round(raw_over, 9) AS raw_over, round(raw_under / (raw_under + raw_over), 9) AS fair_under, round(raw_over / (raw_under + raw_over), 9) AS fair_over, round(raw_under + raw_over - 1, 9) AS margin FROM i",
    "opportunities": f"{ODDS} SELECT match_id, side, round(odds, 9) AS odds, round(edge, 9) AS edge, round(disagreement, 9) AS disagreement, round(ev, 9) AS ev, won, round(profit, 9) AS profit FROM o",
    "best_side": f"{ODDS} SELECT match_id, side, round(edge, 9) AS edge, round(ev, 9) AS ev FROM best",
    "threshold_grid": f"{ODDS}, {CELLS}, g AS (SELECT threshold, side, eligible FROM {TH} h, {SIDES} s, (SELECT count(*) AS eligible FROM best) y), " + bets_sql("t", "threshold, side", "g", "eligible"),
    "season_grid": f"{ODDS}, {CELLS}, g AS (SELECT season, threshold, side, eligible FROM {TH} h, {SIDES} s, (SELECT season, count(*) AS eligible FROM best GROUP BY ALL) y), " + bets_sql("t", "season, threshold, side", "g", "eligible"),
    "competition_grid": f"{ODDS}, {CELLS}, g AS (SELECT competition, threshold, side, eligible FROM {TH} h, {SIDES} s, (SELECT competition, count(*) AS eligible FROM best GROUP BY ALL) y), " + bets_sql("t", "competition, threshold, side", "g", "eligible"),
    "edge_bins": f"{ODDS}, t AS (SELECT *, CAST(" + " + ".join(f"CAST(edge >= {b} AS INT)" for b in C.EDGE_BINS) + f" - 1 AS INT) AS band FROM best WHERE edge >= 0), g AS (SELECT CAST(band AS INT) AS band, eligible, positive FROM (SELECT unnest(range({len(C.EDGE_BINS)})) AS band) x, (SELECT count(*) AS eligible, count(*) FILTER (WHERE edge >= 0) AS positive FROM best) y), " + bets_sql("t", "band", "g", "eligible", ", positive"),
    "odds_bands": bands_sql("odds", C.ODDS_BANDS),
    "margin_bands": bands_sql("margin", C.MARGIN_BANDS),
    "edge_deciles": deciles_sql("edge"),
    "ev_deciles": deciles_sql("ev"),
    "coverage_curve": f"""{ODDS}, y AS (SELECT count(*) AS eligible, count(*) FILTER (WHERE edge >= 0) AS positive FROM best), k AS (SELECT level, CAST(greatest(1, ceil(positive * level)) AS BIGINT) AS k, eligible, positive, nth FROM y, (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in C.COVERAGE_LEVELS)}]) AS level, unnest(range({len(C.COVERAGE_LEVELS)})) AS nth)),
q AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY nth) AS r FROM k) WHERE r = 1), n AS (SELECT *, row_number() OVER (ORDER BY edge DESC, ev DESC, match_id) AS rn FROM best WHERE edge >= 0),
t AS (SELECT n.*, level FROM n JOIN q ON rn <= k), g AS (SELECT q.*, least FROM q LEFT JOIN (SELECT level, min(edge) AS least FROM t GROUP BY ALL) USING (level)), """ + bets_sql("t", "level", "g", "eligible", ", k, positive, round(least, 9) AS least"),
    "temporal_threshold": f"""{ODDS}, t AS (SELECT b.*, threshold FROM best b JOIN {TH} h ON edge >= threshold), w AS (SELECT *, sum(profit) OVER x AS cum FROM t WINDOW x AS (PARTITION BY season, threshold ORDER BY dt, match_id ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY season, threshold ORDER BY dt, match_id ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM w), per AS (SELECT season, threshold, count(*) AS n, sum(profit) AS profit, max(dd) AS dd FROM dd GROUP BY ALL),
s AS (SELECT DISTINCT season FROM best), e AS (SELECT a.season AS test_season, b.season FROM s a JOIN s b ON b.season < a.season), named AS (SELECT test_season, string_agg(season, ',' ORDER BY season) AS development_seasons FROM e GROUP BY ALL),
dev AS (SELECT test_season, threshold, CAST(sum(n) AS BIGINT) AS n, sum(profit) AS profit FROM e JOIN per USING (season) GROUP BY ALL HAVING sum(n) >= 100),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_season ORDER BY profit / n DESC, threshold) AS r FROM dev) WHERE r = 1)
SELECT test_season, development_seasons, pick.threshold AS selected_threshold, CASE WHEN pick.threshold IS NULL THEN 'insufficient-development-bets' ELSE 'selected' END AS selection_status, coalesce(pick.n, 0) AS development_bets, round(pick.profit / pick.n, 9) AS development_roi,
  coalesce(per.n, 0) AS test_bets, round(per.profit / per.n, 9) AS test_roi, round(coalesce(per.profit, 0.0), 9) AS test_profit, round(coalesce(per.dd, 0.0), 9) AS test_drawdown FROM named LEFT JOIN pick USING (test_season) LEFT JOIN per ON per.season = test_season AND per.threshold = pick.threshold""",
    "drawdown": f"""{ODDS}, w AS (SELECT *, sum(profit) OVER (ORDER BY dt, match_id ROWS UNBOUNDED PRECEDING) AS cum FROM best), d AS (SELECT *, greatest(0, max(cum) OVER (ORDER BY dt, match_id ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM w)
SELECT count(*) AS num_bets, round(sum(profit), 9) AS total_profit, round(avg(profit), 9) AS roi, round(max(dd), 9) AS max_drawdown FROM d""",
    "missingness": f"{STATS} SELECT competition, season, stat, count(*) FILTER (WHERE value IS NULL OR value = -1 OR (stat = 'home_goals' AND value = 0)) AS n_missing, count(*) FILTER (WHERE value = 0) AS n_zero, count(*) AS n_total, round(100 * count(*) FILTER (WHERE value IS NULL OR value = -1 OR (stat = 'home_goals' AND value = 0)) / count(*), 6) AS missing_pct FROM v GROUP BY ALL",
    "team_month_missing": f"""{STATS}, f AS (SELECT competition, season, home_id, month, stat, count(*) FILTER (WHERE value IS NULL OR value = -1) AS m, count(*) AS n FROM v GROUP BY ALL)
SELECT competition, home_id, CAST(sum(m) AS BIGINT) AS n_missing, CAST(sum(n) AS BIGINT) AS n_total, round(max(100 * m / n), 6) AS worst_pct, round(median(100 * m / n), 6) AS median_pct, round(100 * sum(m) / sum(n), 6) AS missing_pct FROM f GROUP BY ALL""",
    "worst_slices": f"{STATS} SELECT competition, season, stat, round(100 * count(*) FILTER (WHERE value IS NULL OR value = -1) / count(*), 6) AS missing_pct FROM v GROUP BY ALL ORDER BY 100 * count(*) FILTER (WHERE value IS NULL OR value = -1) / count(*) DESC, competition, season, stat LIMIT 30",
    "pivot_missing": f"{STATS} SELECT competition || ' | ' || season AS row, round(100 * avg(CAST(value = -1 OR value = 0 AS INT)) FILTER (WHERE stat = 'home_goals'), 6) AS home_goals, round(100 * avg(CAST(value = -1 AS INT)) FILTER (WHERE stat = 'home_shots'), 6) AS home_shots FROM v GROUP BY ALL",
    "distribution": f"{STATS} SELECT stat, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.97), 4) AS p97, round(quantile_cont(value, 0.99), 4) AS p99, round(quantile_cont(value, 0.99), 4) AS recommended FROM v WHERE value >= 0 GROUP BY ALL",
    "position_counts": "SELECT position, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT unnest(list_distinct(list_transform(string_split(p_type, ' '), lambda x: trim(x)))) AS position FROM {part}) WHERE position <> '' GROUP BY ALL",
    "lineup_coverage": """WITH z AS (SELECT match_id, side, count(*) AS size FROM {fx_lineups} GROUP BY ALL), r AS (SELECT competition, season, CASE WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN size < 11 THEN 'partial' WHEN size = 11 THEN 'full' ELSE 'oversized' END AS bucket FROM {fx_matches} m CROSS JOIN (SELECT unnest([0, 1]) AS side) x LEFT JOIN z USING (match_id, side))
SELECT competition, season, bucket, count(*) AS n FROM r GROUP BY GROUPING SETS ((competition, season, bucket), (bucket))""",
    "lineup_overlap": """SELECT match_id, len(h) AS home_size, len(a) AS away_size, len(h) - len(list_distinct(h)) AS home_twice, len(a) - len(list_distinct(a)) AS away_twice, len(list_intersect(list_distinct(h), list_distinct(a))) AS on_both FROM (
  SELECT match_id, coalesce(list(player_id) FILTER (WHERE side = 0), []) AS h, coalesce(list(player_id) FILTER (WHERE side = 1), []) AS a FROM {fx_lineups} GROUP BY ALL)""",
    "finding_rollup": """WITH m AS (SELECT match_id, season, dt, home_id, CASE WHEN match_id % 97 = 0 THEN home_id ELSE away_id END AS away_id, nullif(home_goals, 4) AS home_goals, away_goals FROM {fx_matches}),
f AS (SELECT 'same_team' AS code, match_id FROM m WHERE home_id = away_id UNION ALL SELECT 'bad_goals', match_id FROM m WHERE home_goals IS NULL OR away_goals IS NULL OR home_goals < 0 OR away_goals < 0
  UNION ALL SELECT 'season_range', match_id FROM m WHERE season < 1993 OR season >= 1998 UNION ALL SELECT 'unknown_home', match_id FROM m WHERE home_id = 3 UNION ALL SELECT 'unknown_away', match_id FROM m WHERE away_id = 3)
SELECT code, 'critical' AS severity, count(*) AS count, array_to_string(list_sort(list(CAST(match_id AS VARCHAR)))[1:5], ',') AS examples FROM f GROUP BY code""",
    "duplicate_keys": """WITH r AS (SELECT l_orderkey AS t, l_suppkey AS p FROM {lineitem}) SELECT 'roster_repeats' AS code, 'warning' AS severity, count(*) AS count FROM (SELECT 1 FROM r GROUP BY t, p HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'roster_unknown_player', 'critical', count(*) FROM r WHERE p NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_suppkey % 10 <> 3) HAVING count(*) > 0""",
    "asof_past": f"{LOOK} SELECT match_id, side, slot, player_id, snap_date, age, nth FROM (SELECT *, dense_rank() OVER (PARTITION BY match_id, side, slot ORDER BY age) AS nth FROM j WHERE age BETWEEN 0 AND 120) WHERE nth <= 6",
    "asof_past_future": f"{LOOK} SELECT match_id, side, slot, player_id, snap_date, age, nth FROM (SELECT *, dense_rank() OVER (PARTITION BY match_id, side, slot ORDER BY age < 0, abs(age)) AS nth FROM j WHERE abs(age) <= 20) WHERE nth <= 6",
    "skill_fill": f"""{LOOK}, n AS (SELECT *, dense_rank() OVER (PARTITION BY match_id, side, slot ORDER BY age) AS nth FROM j WHERE age BETWEEN 0 AND 120)
SELECT match_id, side, slot, round(arg_min(skill, nth), 6) AS value, arg_min(snap_date, nth) AS snap_date, arg_min(age, nth) AS age FROM n WHERE nth <= 6 AND skill >= 0 GROUP BY ALL""",
    "imputer_medians": f"WITH {CELL_ROWS} SELECT fold, competition, position, skill_no, count(*) AS support, round(median(value), 6) AS median FROM c WHERE value >= 0 GROUP BY ALL HAVING count(*) >= 20",
    "impute_apply": f"""WITH {CELL_ROWS}, a AS (SELECT fold, competition, position, skill_no, median(value) AS m FROM c WHERE value >= 0 GROUP BY ALL HAVING count(*) >= 40),
b AS (SELECT fold, position, skill_no, median(value) AS m FROM c WHERE value >= 0 GROUP BY ALL HAVING count(*) >= 120), g AS (SELECT fold, skill_no, median(value) AS m FROM c WHERE value >= 0 GROUP BY ALL)
SELECT event_id, round(CASE WHEN value >= 0 THEN value ELSE coalesce(a.m, b.m, g.m, 50.0) END, 6) AS value, CASE WHEN value >= 0 THEN 1 WHEN a.m IS NOT NULL THEN 3 WHEN b.m IS NOT NULL THEN 4 WHEN g.m IS NOT NULL THEN 5 ELSE 6 END AS provenance, CAST(value >= 0 AS INT) AS observed
FROM c LEFT JOIN a USING (fold, competition, position, skill_no) LEFT JOIN b USING (fold, position, skill_no) LEFT JOIN g USING (fold, skill_no)""",
    "strength_scale_mask": "SELECT vec_id, round(list_sum(list_transform(e, lambda x: CASE WHEN x >= 0 THEN least(x / 100, 1.0) ELSE 0.0 END)), 6) AS values_sum, CAST(len(list_filter(e, lambda x: x >= 0)) AS DOUBLE) AS mask_sum FROM (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 100, 3)) AS e FROM {embeddings})",
    "matrix_cells": """SELECT label, CAST(sum(len(list_filter(embedding, lambda x: x >= 0))) AS BIGINT) AS observed, CAST(sum(len(embedding)) AS BIGINT) AS cells,
CAST(sum(CAST(len(list_filter(embedding[1:16], lambda x: x >= 0)) > 0 AS INT) + CAST(len(list_filter(embedding[17:32], lambda x: x >= 0)) > 0 AS INT) + CAST(len(list_filter(embedding[33:48], lambda x: x >= 0)) > 0 AS INT) + CAST(len(list_filter(embedding[49:64], lambda x: x >= 0)) > 0 AS INT)) AS BIGINT) AS rows_observed FROM {embeddings} GROUP BY ALL""",
    "event_sessions": """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY user_id, k""",
}

QUERIES = {f.__name__: f for f in (
    scope_metrics, model_ranking, model_deltas, thresholded_auc, calibration, calibration_errors, misaligned_rows, regression, multiclass, moving_average, prevalence_baseline, logistic_baseline, platt_calibration,
    implied_odds, opportunities, best_side, threshold_grid, season_grid, competition_grid, edge_bins, odds_bands, margin_bands, edge_deciles, ev_deciles, coverage_curve, temporal_threshold, drawdown,
    missingness, team_month_missing, worst_slices, pivot_missing, distribution, position_counts, lineup_coverage, lineup_overlap, finding_rollup, duplicate_keys, asof_past, asof_past_future, skill_fill,
    imputer_medians, impute_apply, strength_scale_mask, matrix_cells, name_ratios, team_matching, player_matching, event_sessions,
)}
