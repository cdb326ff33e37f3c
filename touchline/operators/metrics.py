"""Prediction metrics over any set of scopes, exact AUC, calibration, comparison of models and simple baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import ratio

LOG_LOSS_FLOOR = 1e-7
SCORE_BUCKETS = 4096


def loss_terms(y: Column, p: Column, floor: float = LOG_LOSS_FLOOR) -> Column:
    clipped = F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor))
    return -F.when(y == 1, F.ln(clipped)).otherwise(F.ln(1 - clipped))


def scoped(rows: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """Each row once for each scope, with scope and scope_key (its group's values, joined)."""
    marks = [F.struct(F.lit(name).alias("scope"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("scope_key")) for name, columns in scopes.items()]
    return rows.withColumn("_s", F.explode(F.array(*marks))).select("*", "_s.scope", "_s.scope_key").drop("_s")


def binary_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, prevalence, accuracy, Brier, log loss and exact AUC (null for a single class) of rows(y_true, probability) by keys.

    AUC counts, for each distinct probability of a group, its positives and negatives; negatives below come from a running sum over the
    distinct probabilities of a bucket (of SCORE_BUCKETS even ones) and the sums of lower buckets, so that no task sees a whole group. Equal
    probabilities count a half.
    """
    y, p = F.col("y_true"), F.col("probability")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y.cast("double")).alias("prevalence"), F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss_terms(y, p)).alias("log_loss"),
    )
    steps = rows.groupBy(*keys, "probability").agg(F.sum((y == 1).cast("long")).alias("pos"), F.sum((y == 0).cast("long")).alias("neg"))
    steps = steps.withColumn("bucket", F.floor(p * SCORE_BUCKETS))
    earlier = lambda by, *group: F.coalesce(F.sum("neg").over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = steps.groupBy(*keys, "bucket").agg(F.sum("neg").alias("neg")).select(*keys, "bucket", earlier("bucket", *keys).alias("lower"))
    below = F.col("lower") + earlier("probability", *keys, "bucket")
    pairs = steps.join(lower, [*keys, "bucket"]).withColumn("won", F.col("pos") * (below + F.col("neg") / 2.0))
    auc = pairs.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))
    return sums.join(auc, keys)


def scope_metrics(rows: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    return binary_metrics(scoped(rows, scopes), ["model_name", "scope", "scope_key"])


def thresholded_auc(rows: DataFrame, keys: list[str], thresholds: int = 200) -> DataFrame:
    """AUC by trapezoids over evenly spaced thresholds."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(thresholds - 1)), lambda i: F.when(i == 0, -1e-7).when(i == thresholds - 1, 1 + 1e-7).otherwise(i / (thresholds - 1.0)))
    at = F.size(F.filter(cut, lambda t: t < F.col("probability")))
    # a row is predicted positive at its first `at` thresholds
    counts = rows.withColumn("at", at).groupBy(*keys, "at").agg(F.sum((F.col("y_true") == 1).cast("long")).alias("pos"), F.sum((F.col("y_true") == 0).cast("long")).alias("neg"))
    grid = counts.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(thresholds))))
    above = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rates = grid.join(counts.withColumnRenamed("at", "i"), [*keys, "i"], "left").select(*keys, "i", (F.sum(F.coalesce("pos", F.lit(0))).over(above) / F.sum("pos").over(whole)).alias("tpr"), (F.sum(F.coalesce("neg", F.lit(0))).over(above) / F.sum("neg").over(whole)).alias("fpr"))
    step = Window.partitionBy(*keys).orderBy(F.desc("i"))
    area = (F.col("fpr") - F.lag("fpr").over(step)) * (F.col("tpr") + F.lag("tpr").over(step)) / 2
    return rates.withColumn("area", area).groupBy(*keys).agg(F.sum("area").alias("auc"))


def calibration_bins(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Every bin of every group, empty ones with null means: bin, count, mean_probability, observed_rate, gap."""
    bin_of = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    filled = rows.withColumn("bin", bin_of).groupBy(*keys, "bin").agg(F.count("*").alias("count"), F.avg("probability").alias("mean_probability"), F.avg(F.col("y_true").cast("double")).alias("observed_rate"))
    grid = filled.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    got = grid.join(filled, [*keys, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return got.withColumn("gap", F.abs(F.col("observed_rate") - F.col("mean_probability")))


def calibration_errors(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and maximum calibration error."""
    return bins.groupBy(*keys).agg((F.sum(F.col("count") * F.col("gap")) / F.sum("count")).alias("ece"), F.max("gap").alias("mce"))


def model_ranking(metrics: DataFrame) -> DataFrame:
    """Models by AUC (best first), then by name; one row for each model."""
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("auc"), "model_name")))


def model_deltas(metrics: DataFrame, baseline: str) -> DataFrame:
    """Each model against the baseline: what it gains (losses the other way round)."""
    base = metrics.where(F.col("model_name") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in ("auc", "accuracy", "brier", "log_loss")])
    other = metrics.where(F.col("model_name") != baseline)
    joined = other.join(F.broadcast(base))
    return joined.select("model_name", *[(F.col(c) - F.col(f"b_{c}")).alias(f"{c}_gain") for c in ("auc", "accuracy")], *[(F.col(f"b_{c}") - F.col(c)).alias(f"{c}_gain") for c in ("brier", "log_loss")])


def regression_metrics(rows: DataFrame, keys: list[str], y: str = "y_true", p: str = "prediction") -> DataFrame:
    off = F.col(y) - F.col(p)
    return rows.groupBy(*keys).agg(F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"))


def multiclass_metrics(rows: DataFrame, keys: list[str], floor: float = 1e-8) -> DataFrame:
    """Accuracy, error of the expected class and log loss of rows(y_true int, probabilities array)."""
    p = F.col("probabilities")
    top = F.array_position(p, F.array_max(p)) - 1
    expected = F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    clipped = F.transform(p, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(floor)))
    own = F.get(clipped, F.col("y_true")) / F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy(*keys).agg(
        F.avg((top == F.col("y_true")).cast("double")).alias("accuracy"), F.avg(F.abs(expected - F.col("y_true"))).alias("expected_mae"), F.avg(-F.ln(own)).alias("log_loss")
    )


def misaligned(rows: DataFrame, models: int, signature: list[str]) -> DataFrame:
    """Signatures that not all models predict exactly once."""
    return rows.groupBy(*signature).agg(F.count("*").alias("n"), F.countDistinct("model_name").alias("models")).where((F.col("n") != models) | (F.col("models") != models))


def prediction_faults(rows: DataFrame) -> DataFrame:
    """Rows whose target is not 0 or 1, whose probability is not in [0, 1], or whose id repeats."""
    n = F.count("*").over(Window.partitionBy("model_name", "match_id"))
    p = F.col("probability")
    good = F.coalesce(F.col("y_true").isin(0, 1) & (p >= 0) & (p <= 1) & ~F.isnan(p), F.lit(False))
    return rows.withColumn("n", n).where(~good | (F.col("n") > 1))


def prevalence_baselines(folds: DataFrame, targets: DataFrame) -> DataFrame:
    """(fold, match_id, y_true, prevalence, majority) of validation matches: the training mean, and the class it makes more likely."""
    rows = folds.join(targets, "match_id")
    trained = rows.where("part = 'training'").groupBy("fold").agg(F.avg(F.col("y_true").cast("double")).alias("prevalence"))
    return rows.where("part = 'validation'").join(trained, "fold").select("fold", "match_id", "y_true", "prevalence", (F.col("prevalence") >= 0.5).cast("double").alias("majority"))


def centred_mean(value: Column, order: Column, half: int, *partition: str) -> Column:
    """Mean of the values around a row, NaN skipped, cut off at the ends."""
    return F.avg(F.nanvl(value, F.lit(None).cast("double"))).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(-half, half))


def rates(rows: DataFrame, keys: list[str], *pairs: tuple[str, str]) -> DataFrame:
    """Sums of the columns of pairs by keys, and the ratio of each pair (0 for a zero denominator)."""
    names = sorted({x for pair in pairs for x in pair})
    sums = rows.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in names])
    return sums.select("*", *[ratio(F.col(a), F.col(b), 0.0).alias(f"{a}_rate") for a, b in pairs])
