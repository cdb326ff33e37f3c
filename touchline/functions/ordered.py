"""Ranks and running values over a whole table without a single-task window.

The order's leading part is a bucket (a day, a rounded score): windows run within buckets, and totals of earlier buckets are added from a
table with one row for each bucket, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_rank(df: DataFrame, bucket: Column, order: list[Column], descending: bool = False) -> DataFrame:
    """df with rn (from 1 over all rows, buckets first) and n (all rows). bucket must not be null and must agree with order."""
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy("_bucket").agg(F.count("*").alias("_size"))
    by = F.desc("_bucket") if descending else F.asc("_bucket")
    run = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_bucket", F.coalesce(F.sum("_size").over(run), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("n"))
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return marked.withColumn("_rn", inner).join(before, "_bucket").withColumn("rn", F.col("_rn") + F.col("_before")).drop("_bucket", "_before", "_rn")


def with_running_profit(df: DataFrame, groups: list[str], day: str, order: list[str], value: str) -> DataFrame:
    """df with cumulative (running sum of value within groups, by day and order) and drawdown (from its peak so far, at least 0)."""
    keys = [*groups, day]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_sum", F.sum(value).over(inside))
    rows = rows.withColumn("_peak", F.max("_sum").over(inside))
    days = rows.groupBy(*keys).agg(F.sum(value).alias("_total"), F.max("_sum").alias("_top"))
    earlier = Window.partitionBy(*groups).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    days = days.withColumn("_peak_before", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("_before") + F.col("_top")).over(earlier), F.lit(0.0))))
    joined = rows.join(days.select(*keys, "_before", "_peak_before"), keys)
    joined = joined.withColumn("cumulative", F.col("_sum") + F.col("_before"))
    joined = joined.withColumn("drawdown", F.greatest(F.col("_peak_before"), F.col("_peak") + F.col("_before")) - F.col("cumulative"))
    return joined.drop("_sum", "_peak", "_before", "_peak_before")
