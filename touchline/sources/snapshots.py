"""A snapshot: one Parquet table for each entity, and _meta with the schema version."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
ENV = "TOUCHLINE_SNAPSHOT"


def snapshot_path(value: str | None = None) -> str:
    """The argument, else the environment's path, else an error."""
    path = value or os.environ.get(ENV)
    if not path:
        raise ValueError(f"no snapshot path: give one or set {ENV}")
    return path


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = spark.createDataFrame([(VERSION, sorted(tables))], "version int, tables array<string>")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/_meta.parquet")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables by name; another version is refused."""
    meta = spark.read.parquet(f"{path}/_meta.parquet").first()
    if meta.version != VERSION:
        raise ValueError(f"snapshot version {meta.version}, not {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta.tables}


def try_load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    try:
        return load_snapshot(spark, path)
    except (AnalysisException, ValueError):
        return None


def with_defaults(df: DataFrame, schema: str, defaults: dict[str, object]) -> DataFrame:
    """df in the schema's columns; those it lacks get their default, or null."""
    empty = df.sparkSession.createDataFrame([], schema)
    full = empty.unionByName(df.select(*[c for c in df.columns if c in empty.columns]), allowMissingColumns=True)
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(empty.schema[c].dataType)) for c, v in defaults.items() if c not in df.columns})


def summary_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file below a path, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.upper(F.sha2("content", 256)).alias("sha256"))
