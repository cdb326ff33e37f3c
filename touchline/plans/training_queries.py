"""Queries on rolling models and fold-local imputation, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.lineage import written
from touchline.operators import datasets, form, imputation, rolling, sequential
from touchline.plans.fixtures import tables
from touchline.plans.form_queries import UNIFORM, sql_mean, uniform_rounds
from touchline.plans.model_queries import rounded

WINDOW = 25
CLASSES = 11
TRIAL = 3
AUDITED = 6
SUPPORT = C.Imputation(competition_support=40, position_support=60)


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Matches in rounds of 50, with goals and both teams' mean points of the last five."""
    team = tables(spark, d, "fx_team_matches")
    wide = form.home_and_away(team.select("match_id", "role", form.points_mean(5).alias("points5")), "points5")
    placed = sequential.uniform_rounds(sequential.order_rank(tables(spark, d, "fx_matches"))).withColumn("goals", F.col("home_goals") + F.col("away_goals"))
    return placed.select("match_id", "round_index", "goals").join(wide, "match_id").select("match_id", "round_index", "goals", datasets.numeric_array(["home_points5", "away_points5"]).cast("array<double>").alias("features"))


def rolling_majority(spark: SparkSession, d: str) -> DataFrame:
    """Majority models of three targets: mean goals, the share of each number of goals, and the class that is most frequent."""
    goals = rows(spark, d).select("match_id", "round_index", F.least("goals", F.lit(CLASSES - 1)).alias("y"))
    got = rolling.majority(goals, WINDOW, CLASSES)
    return rounded(got.select("match_id", "y", "n", "mean", F.col("top").cast("long").alias("top"), "expected", F.get("dist", F.lit(2)).alias("share2")), 9)


def ridge(spark: SparkSession, d: str) -> DataFrame:
    data = rows(spark, d).withColumn("y", F.col("goals").cast("double"))
    return rolling.predicted(data, rolling.ridge_weights(data, WINDOW))


def rolling_ridge(spark: SparkSession, d: str) -> DataFrame:
    return ridge(spark, d).select("match_id", "fold", "y", F.round("prediction", 6).alias("prediction"))


def rolling_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rolling.fold_metrics(ridge(spark, d)), 5)


def rolling_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Under 2.5 goals by logistic regression of every fold, the intercept penalised like a weight."""
    data = written(rows(spark, d).withColumn("y", (F.col("goals") <= 2).cast("double")), "rounds")
    got = rolling.predicted(data, rolling.logistic_weights(data, WINDOW, free_intercept=False), "logit")
    return got.select("match_id", "fold", "y", F.round("prediction", 6).alias("probability"))


def trial_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the rounds that the first folds read."""
    return written(rows(spark, d).where(F.col("round_index") < WINDOW + TRIAL).withColumn("y", (F.col("goals") <= 2).cast("double")), "trial")


def trial_layers(spark: SparkSession, d: str) -> DataFrame:
    """The trial run of a layered model: the first three folds, weights carried from one to the next, the rate falling."""
    data = trial_rows(spark, d)
    folds = rolling.first_folds(data, WINDOW, TRIAL)
    rate = lambda fold: datasets.learning_rate("exponential", 0.05, fold - WINDOW, TRIAL)
    got = rolling.fitted_by_fold(data, folds, WINDOW, rolling.layered([2, 4, 2], rate, 10, 3))
    return got.select("match_id", "fold", "y", F.round("probability", 3).alias("probability"))


def cells(spark: SparkSession, d: str, folds: DataFrame) -> DataFrame:
    """Cells of line-ups in the rounds of the folds with their round, competition and position; unresolved ones are -1. Matches of other rounds, which no fold reads, are left out before cells are made."""
    used = F.broadcast(imputation.fold_rounds(folds, WINDOW).select("round_index").distinct())  # some rounds for each audited fold
    placed = written(uniform_rounds(spark, d).join(used, "round_index", "left_semi"), "rounds")
    matches = written(tables(spark, d, "fx_matches").join(placed, "match_id", "left_semi"), "matches")
    listed = tables(spark, d, "fx_cells", fx_matches=matches).join(matches.select("match_id", "competition"), "match_id").join(placed, "match_id")
    value = F.when(F.col("match_id") % 43 == 5, -1.0).otherwise(F.col("value"))
    position = F.when(F.col("slot") == 0, "Goalkeeper").when(F.col("slot") < 5, "Defender").otherwise("Forward")
    return listed.select("match_id", "round_index", "competition", "side", "slot", position.alias("position"), "skill_no", value.alias("value"), F.when(value >= 0, 1).otherwise(0).alias("provenance"))


def audited_folds(spark: SparkSession, d: str) -> DataFrame:
    last = uniform_rounds(spark, d).agg(F.max("round_index")).first()[0]
    return spark.createDataFrame([(f,) for f in sequential.spaced_folds(last + 1, WINDOW, AUDITED)], "fold long")


def fold_imputation(spark: SparkSession, d: str) -> DataFrame:
    """Cells by provenance and part of each audited fold, imputed by what its own training rounds hold."""
    folds = audited_folds(spark, d)
    done = imputation.impute_folds(cells(spark, d, folds), folds, WINDOW, SUPPORT)
    return rounded(imputation.diagnostics(done), 6)


def imputation_findings(spark: SparkSession, d: str) -> DataFrame:
    folds = audited_folds(spark, d)
    done = imputation.impute_folds(cells(spark, d, folds), folds, WINDOW, SUPPORT)
    return imputation.audit(done, ["fold", "part", "match_id", "side", "slot", "skill_no"]).select("code", "severity", "n")


_ROWS = f"""{UNIFORM}, team AS (SELECT match_id, role, {sql_mean('CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END', 'team_id', 5, 3.0)} AS p FROM {{fx_team_matches}}),
rows_ AS (SELECT u.match_id, u.round_index, home_goals + away_goals AS goals, CAST(CAST(h.p AS FLOAT) AS DOUBLE) AS x1, CAST(CAST(a.p AS FLOAT) AS DOUBLE) AS x2 FROM u JOIN {{fx_matches}} m USING (match_id)
  JOIN team h ON h.match_id = u.match_id AND h.role = 'home' JOIN team a ON a.match_id = u.match_id AND a.role = 'away'),
f AS (SELECT DISTINCT round_index AS fold FROM u WHERE round_index >= {WINDOW})"""
_RIDGE = f"""{_ROWS}, sums AS (
  SELECT fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(goals) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, goals) AS c1, covar_pop(x2, goals) AS c2
  FROM f JOIN rows_ r ON r.round_index BETWEEN fold - {WINDOW} AND fold - 1 GROUP BY fold),
scaled AS (SELECT *, n + 1.0 AS a, n * c12 / (s1 * s2) AS b, n * c1 / s1 AS r1, n * c2 / s2 AS r2 FROM sums),
solved AS (SELECT fold, m1, m2, my, (a * r1 - b * r2) / (a * a - b * b) / s1 AS w1, (a * r2 - b * r1) / (a * a - b * b) / s2 AS w2 FROM scaled),
scored AS (SELECT r.match_id, s.fold, CAST(goals AS DOUBLE) AS y, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS prediction FROM solved s JOIN rows_ r ON r.round_index = s.fold)"""
_SPACED = f"""last_round AS (SELECT max(round_index) AS top FROM u),
audited AS (SELECT DISTINCT {WINDOW} + (i * (top - {WINDOW})) // {AUDITED - 1} AS fold FROM last_round, range({AUDITED}) t(i) WHERE top >= {WINDOW})"""
_CELLS = f"""{UNIFORM}, {_SPACED},
cells AS (
  SELECT c.match_id, round_index, competition, side, slot, CASE WHEN slot = 0 THEN 'Goalkeeper' WHEN slot < 5 THEN 'Defender' ELSE 'Forward' END AS position, skill_no, CASE WHEN c.match_id % 43 = 5 THEN -1 ELSE value END AS value
  FROM {{fx_cells}} c JOIN {{fx_matches}} USING (match_id) JOIN u USING (match_id)),
member AS (SELECT fold, CASE WHEN round_index = fold THEN 'validation' ELSE 'training' END AS part, cells.* FROM audited JOIN cells ON round_index BETWEEN fold - {WINDOW} AND fold),
seen AS (SELECT * FROM member WHERE part = 'training' AND value >= 0),
l0 AS (SELECT fold, competition, position, skill_no, median(value) AS v FROM seen GROUP BY ALL HAVING count(*) >= {SUPPORT.competition_support}),
l1 AS (SELECT fold, position, skill_no, median(value) AS v FROM seen GROUP BY ALL HAVING count(*) >= {SUPPORT.position_support}),
l2 AS (SELECT fold, skill_no, median(value) AS v FROM seen GROUP BY ALL HAVING count(*) >= {SUPPORT.global_support}),
done AS (
  SELECT m.*, CASE WHEN m.value >= 0 THEN 1 WHEN l0.v IS NOT NULL THEN 3 WHEN l1.v IS NOT NULL THEN 4 WHEN l2.v IS NOT NULL THEN 5 ELSE 6 END AS provenance, CASE WHEN m.value >= 0 THEN m.value ELSE coalesce(l0.v, l1.v, l2.v, {SUPPORT.neutral}) END AS filled
  FROM member m LEFT JOIN l0 USING (fold, competition, position, skill_no) LEFT JOIN l1 ON l1.fold = m.fold AND l1.position = m.position AND l1.skill_no = m.skill_no LEFT JOIN l2 ON l2.fold = m.fold AND l2.skill_no = m.skill_no)"""

SQL = {
    "rolling_majority": f"""{_ROWS}, capped AS (SELECT match_id, round_index, least(goals, {CLASSES - 1}) AS y FROM rows_), per AS (SELECT fold, y, count(*) AS c FROM f JOIN capped ON round_index BETWEEN fold - {WINDOW} AND fold - 1 GROUP BY ALL),
t AS (SELECT fold, CAST(sum(c) AS BIGINT) AS n, sum(c * y) / sum(c) AS mean, coalesce(sum(c) FILTER (y = 2), 0) / sum(c) AS share2, arg_min(y, -1000 * c + y) AS top FROM per GROUP BY fold)
SELECT match_id, y, n, round(mean, 9) AS mean, CAST(top AS BIGINT) AS top, round(mean, 9) AS expected, round(share2, 9) AS share2 FROM t JOIN capped ON round_index = fold""",
    "rolling_ridge": f"{_RIDGE} SELECT match_id, fold, y, round(prediction, 6) AS prediction FROM scored",
    "rolling_metrics": f"{_RIDGE} SELECT fold, count(*) AS n, round(avg(abs(prediction - y)), 5) AS mae, round(sqrt(avg((prediction - y) * (prediction - y))), 5) AS rmse FROM scored GROUP BY GROUPING SETS ((fold), ())",
    "fold_imputation": f"{_CELLS} SELECT fold, part, CAST(provenance AS INT) AS provenance, count(*) AS cells, count(DISTINCT match_id) AS matches, round(avg(filled), 6) AS mean_value FROM done GROUP BY ALL",
    "imputation_findings": f"""{_CELLS} SELECT 'audited_neutral_fallback_cells' AS code, 'warning' AS severity, count(*) AS n FROM done WHERE provenance = 6 HAVING count(*) > 0
UNION ALL SELECT 'imputed_cells', 'warning', count(*) FROM done WHERE provenance BETWEEN 3 AND 5 HAVING count(*) > 0""",
}

QUERIES = {f.__name__: f for f in (rolling_majority, rolling_ridge, rolling_metrics, rolling_logistic, trial_layers, fold_imputation, imputation_findings)}
