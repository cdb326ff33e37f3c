"""Connected components of an edge table by alternating large-star and small-star rounds.

Defined results: edges with a null end and loops link nothing; repeated edges count once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import dropped, stored


def _unsettled(edges: DataFrame) -> bool:
    """Whether edges (u over v) are no stars yet: some node has two edges up, or one up and one down."""
    ends = F.array(*[F.struct(F.col(x).alias("node"), F.lit(int(x == "u")).alias("up"), F.lit(int(x == "v")).alias("down")) for x in "uv"])
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").limit(1).count() > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v) that is not the smallest of its component; root is the smallest.

    Each round is two joins on a node, hot nodes being split by the skew-join rule; rounds grow with the logarithm of a component's size. They end
    when every edge leads to a node that leads nowhere else, which then is the smallest of its component.
    """
    spark = edges.sparkSession
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while _unsettled(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = stored(pairs.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(spark, now)
        now = done
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
