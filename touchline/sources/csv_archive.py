"""Dated CSV archives: skill files named by date with damaged rows, record files, merges and diffs."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.scalars import clean_cell, flexible_date


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, snap_date, line, cells) of every line of the files YYYY-MM-DD.csv; other names are passed over. Quotes are read as CSV does."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.csv")
    files = text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.csv$", 1).alias("day"), "value")
    dated = files.select(F.col("day").alias("file"), F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date").alias("snap_date"), "value").where("snap_date is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, day, text in frame.itertuples(index=False, name=None):
                rows = [(file, day, i, cells) for i, cells in enumerate(csv.reader(text.splitlines())) if cells]
                yield pd.DataFrame(rows, columns=["file", "snap_date", "line", "cells"])

    return dated.mapInPandas(run, "file string, snap_date date, line long, cells array<string>")


def _cell(at: Column) -> Column:
    return clean_cell(F.get(F.col("cells"), at))


def skill_snapshots(cells: DataFrame, required: tuple[str, ...] = ("player_id", "name", "dob"), first_skill: str = "crossing", skills: int = C.SKILLS) -> DataFrame:
    """(snap_date, player_id, name, dob, skills, shifted, line): valid rows of files whose header has the required names; of a player's rows the last wins.

    A row whose cell two before the first skill is a number although the column there is text, and whose last two skill cells are empty or text, has its
    skills two cells early; they are read from there. Bad cells are -1.
    """
    header = cells.where("line = 0").select("file", F.transform("cells", lambda c: F.lower(clean_cell(c))).alias("names"))
    good = header.where(F.size(F.array_intersect("names", F.array(*[F.lit(x) for x in (*required, first_skill)]))) == len(required) + 1)
    at = {x: F.array_position("names", x).cast("int") - 1 for x in (*required, first_skill)}
    rows = cells.where("line > 0").join(good.select("file", *[c.alias(f"at_{k}") for k, c in at.items()]), "file")
    first = F.col(f"at_{first_skill}")
    number = lambda c: c.try_cast("double").isNotNull()
    tail = [_cell(first + skills - k) for k in (2, 1)]
    shifted = number(_cell(first - 2)) & number(_cell(first - 1)) & ~number(tail[0]) & ~number(tail[1])
    rows = rows.withColumn("shifted", F.coalesce(shifted, F.lit(False))).withColumn("start", first - F.when(F.col("shifted"), 2).otherwise(0))
    values = F.transform(F.sequence(F.lit(0), F.lit(skills - 1)), lambda i: F.coalesce(clean_cell(F.get(F.col("cells"), F.col("start") + i)).try_cast("double"), F.lit(C.MISSING)))
    made = rows.select("snap_date", _cell(F.col("at_player_id")).try_cast("long").alias("player_id"), _cell(F.col("at_name")).alias("name"), flexible_date(_cell(F.col("at_dob"))).alias("dob"), values.alias("skills"), "shifted", "line")
    last = F.row_number().over(Window.partitionBy("snap_date", "player_id").orderBy(F.desc("line")))
    return made.where("player_id is not null and dob is not null").withColumn("_r", last).where("_r = 1").drop("_r")


def last_by_id(rows: DataFrame, key: str = "player_id", width: int | None = None) -> DataFrame:
    """(line of the id's first row, cells): the last row of each id, blank ids and rows without cells dropped, short rows padded."""
    cleaned = rows.where(F.size("cells") > 0).where(F.trim(F.col(key)) != "")
    best = cleaned.groupBy(key).agg(F.min("line").alias("line"), F.max_by("cells", "line").alias("cells"))
    if width is None:
        return best
    return best.withColumn("cells", F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), 1, width))


def merged(frames: list[DataFrame]) -> DataFrame:
    """The distinct rows of frames with equal columns."""
    if any(f.columns != frames[0].columns for f in frames):
        raise ValueError("headers differ")
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def only_in(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a whose key b lacks, and the other way round."""
    return a.join(b.select(key), key, "left_anti"), b.join(a.select(key), key, "left_anti")


def new_records(stored: DataFrame, fetched: DataFrame, key: str = "match_id") -> DataFrame:
    """stored and those fetched whose key it lacks, each key once."""
    return stored.unionByName(fetched.dropDuplicates([key]).join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def fullest(rows: DataFrame, key: list[str], missing: float = C.MISSING) -> DataFrame:
    """Of the rows of a key the one with the most known values."""
    others = [c for c in rows.columns if c not in key]
    known = sum([(F.col(c).isNotNull() & ~F.col(c).cast("string").try_cast("double").eqNullSafe(F.lit(missing))).cast("int") for c in others], F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_known"), *others))
    return rows.withColumn("_known", known).withColumn("_r", nth).where("_r = 1").drop("_r", "_known")


def write_records(df: DataFrame, path: str) -> bool:
    """CSV with sorted columns; nothing for an empty frame."""
    if df.isEmpty():
        return False
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", "true").csv(path)
    return True
