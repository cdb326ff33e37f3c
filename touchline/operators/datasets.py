"""Model-ready arrays and baselines on Spark's own estimators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.lineage import written
from touchline.functions.scalars import clip_probability, logit, strength_mask, strength_values


def numeric_array(columns: list[str]) -> Column:
    """The columns in order as 32-bit floats, null as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns])


def flat_array(numbers: Column, home: Column, away: Column) -> Column:
    return F.concat(numbers, F.flatten(home), F.flatten(away))


def strength_tensor(home: Column, away: Column) -> Column:
    """Home values, home mask, away values, away mask."""
    return F.array(strength_values(home), strength_mask(home), strength_values(away), strength_mask(away))


def role_means(matrix: Column, roles: Column, role: int, width: int = C.SKILLS) -> Column:
    """Mean of each skill over the rows of a role that have any observed cell; zeros without one."""
    rows = F.filter(F.zip_with(matrix, roles, lambda r, p: F.struct(r.alias("r"), p.alias("p"))), lambda x: (x["p"] == role) & F.exists(x["r"], lambda v: v >= 0))
    sums = F.aggregate(rows, F.array_repeat(F.lit(0.0), width), lambda a, x: F.zip_with(a, x["r"], lambda s, v: s + F.greatest(v, F.lit(0.0))))
    return F.transform(sums, lambda s: s / F.greatest(F.size(rows), F.lit(1)))


def grouped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal rows of columns once, with their number as weight."""
    return rows.groupBy(*columns).agg(F.count("*").cast("double").alias("weight"))


def fit_weighted(training: DataFrame, validation: DataFrame, features: str = "features", c: float = 1.0) -> DataFrame:
    """`fit_logistic` for training rows that count `weight` times each."""
    n, positives = training.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("y_true"))).first()
    if not n or positives in (0, n):
        return validation.withColumn("probability", F.lit(positives / n if n else 0.5))
    each = training.select("weight", F.posexplode(F.col(features).cast("array<double>")).alias("i", "x")).groupBy("i")
    sums = {r.i: (r.s / n, r.q) for r in each.agg(F.sum(F.col("weight") * F.col("x")).alias("s"), F.sum(F.col("weight") * F.col("x") * F.col("x")).alias("q")).collect()}  # a row for each feature
    scale = [(mean, (max(q - n * mean * mean, 0.0) / max(n - 1, 1)) ** 0.5) for _, (mean, q) in sorted(sums.items())]
    own = F.array(*[(F.get(F.col(features), F.lit(i)) - mean) / std if std else F.lit(0.0) for i, (mean, std) in enumerate(scale)])
    vectors = [x.withColumn("_s", array_to_vector(own)) for x in (training, validation)]
    model = LogisticRegression(featuresCol="_s", labelCol="y_true", weightCol="weight", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False).fit(vectors[0])
    scored = model.transform(vectors[1])
    return scored.withColumn("_p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "_s").withColumnRenamed("_p", "probability")


def fit_logistic(training: DataFrame, validation: DataFrame, features: str = "features", c: float = 1.0) -> DataFrame:
    """validation with probability of y_true = 1: standardised features, L2 strength 1/c over the rows; the constant share for one class."""
    n, positives = training.agg(F.count("*"), F.sum(F.col("y_true").cast("long"))).first()
    if not n or positives in (0, n):
        return validation.withColumn("probability", F.lit(float(positives or 0) / n if n else 0.5))
    vectors = [x.withColumn("_v", array_to_vector(F.col(features).cast("array<double>"))) for x in (training, validation)]
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(vectors[0])
    model = LogisticRegression(featuresCol="_s", labelCol="y_true", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False).fit(scaler.transform(vectors[0]))
    scored = model.transform(scaler.transform(vectors[1]))
    return scored.withColumn("_p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "_v", "_s").withColumnRenamed("_p", "probability")


def walk_forward(rows: DataFrame, seasons: list[int], method: str = "platt") -> DataFrame:
    """Each season but the first, with `calibrated`: fitted on earlier seasons by Platt scaling, isotonic regression or model and market together.

    Fits read equal rows of a season once, with their number as weight, which leaves sums and optima as they are.
    """
    out = None
    inputs = ["probability", "fair_under"] if method == "hybrid" else ["probability"]
    past = written(grouped(rows, ["season", *inputs, "y_true"]), "grouped")
    for season in seasons[1:]:
        earlier, now = past.where(F.col("season") < season), rows.where(F.col("season") == season)
        if method == "isotonic":
            model = IsotonicRegression(featuresCol="_x", labelCol="y_true", weightCol="weight").fit(earlier.withColumn("_x", F.col("probability")).withColumn("y_true", F.col("y_true").cast("double")))
            got = model.transform(now.withColumn("_x", F.col("probability"))).withColumn("calibrated", clip_probability(F.col("prediction"))).drop("prediction", "_x")
        else:
            own = [logit(clip_probability(F.col(x))) for x in inputs]
            kept = [x.withColumn("features", F.array(*own)).withColumnRenamed("probability", "_raw") for x in (earlier, now)]
            got = fit_weighted(kept[0], kept[1], c=1e9).withColumn("calibrated", clip_probability(F.col("probability"))).drop("features", "probability").withColumnRenamed("_raw", "probability")
        got = got.select(*rows.columns, "calibrated")
        out = got if out is None else out.unionByName(got)
    return out


def learning_rate(schedule: str, start: float, step: int, steps: int, decay: float = 0.96, least: float = 0.0) -> float:
    """Constant, exponential or cosine rate of a round."""
    import math

    share = step / max(1, steps - 1)
    rates = {"constant": start, "exponential": start * decay**step, "cosine": least + (start - least) * (1 + math.cos(math.pi * share)) / 2}
    return rates[schedule]


def permutation_importance(scored: Callable[[DataFrame], DataFrame], rows: DataFrame, columns: list[str], key: str, seed: int = 1) -> DataFrame:
    """(column, loss_of_accuracy): accuracy of scored(rows) (y_true, probability) less that with the column dealt out anew.

    Values move along a hashed order within hashed blocks, so that no window holds the table.
    """
    spark = rows.sparkSession

    def accuracy(df: DataFrame) -> float:
        return scored(df).agg(F.avg(((F.col("probability") >= 0.5).cast("int") == F.col("y_true")).cast("double"))).first()[0]

    base, out = accuracy(rows), []
    for i, c in enumerate(columns):
        block = F.pmod(F.xxhash64(F.lit(seed + i), key), F.lit(256))
        w = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + i + 1), key), key)
        moved = F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        out.append((c, base - accuracy(rows.withColumn(c, moved))))
    return spark.createDataFrame(out, "column string, loss_of_accuracy double")
