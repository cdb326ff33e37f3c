"""League tables, season dates, regular-season flags and match selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.config import Selection
from touchline.functions.ordered import with_rank
from touchline.functions.scalars import clip01, points, ratio
from touchline.operators.form import in_order

LEAGUE = ("season", "competition")


def select_matches(matches: DataFrame, config: Selection, with_rounds: bool = True) -> DataFrame:
    """Matches of the configured competitions and seasons, not excluded, and in a listed round of theirs."""
    spark = matches.sparkSession
    kept = matches.where(F.col("competition").isin(*config.competitions) & (F.col("season") >= config.first_season) & (F.col("season") < config.last_season))
    if config.excluded:
        out = spark.createDataFrame([*config.excluded], "competition string, season long")
        kept = kept.join(F.broadcast(out), ["competition", "season"], "left_anti")
    return kept.join(F.broadcast(round_table(spark, config)), ["competition", "season", "round_id"], "left_semi") if with_rounds else kept


def round_table(spark: SparkSession, config: Selection) -> DataFrame:
    """The configured (competition, season, round_id), whose number the configuration bounds."""
    rows = [(c, s, r) for (c, s), rounds in config.rounds.items() for r in rounds]
    return spark.createDataFrame(rows, "competition string, season long, round_id long")


def first_rounds(matches: DataFrame, listed: DataFrame) -> DataFrame:
    """For (competition, season) that are not listed: the round of the chronologically first match."""
    unlisted = matches.join(listed.select("competition", "season").distinct(), ["competition", "season"], "left_anti")
    first = F.min_by("round_id", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(in_order())]))
    return unlisted.groupBy("competition", "season").agg(first.alias("round_id"))


def link_competitions(matches: DataFrame, membership: DataFrame) -> DataFrame:
    """matches with comp_season_id of membership(match_id, comp_season_id, ord): of several the last, of none null."""
    last = membership.groupBy("match_id").agg(F.max_by("comp_season_id", "ord").alias("comp_season_id"))
    return matches.join(last, "match_id", "left")


def membership_faults(matches: DataFrame, membership: DataFrame) -> DataFrame:
    """Matches in no or in several comp-seasons, with their number."""
    n = membership.groupBy("match_id").agg(F.countDistinct("comp_season_id").alias("n"))
    return matches.select("match_id").join(n, "match_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def season_table(team_rows: DataFrame) -> DataFrame:
    """Played, goals, points and mean points of each team of each season, with its place."""
    got = team_rows.groupBy(*LEAGUE, "team_id").agg(
        F.count("*").alias("played"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.sum(points(F.col("gf"), F.col("ga"))).cast("long").alias("points")
    )
    ranked = got.withColumn("mean_points", ratio(F.col("points"), F.col("played"), 0.0))
    place = F.row_number().over(Window.partitionBy(*LEAGUE).orderBy(*table_order("mean_points", "gf", "ga"))).cast("long")
    return ranked.withColumn("place", place)


def table_order(mean: str, gf: str, ga: str) -> list[Column]:
    return [F.desc(mean), F.desc(F.col(gf) - F.col(ga)), F.desc(gf), F.asc("team_id")]


def slot_keys(by_match: bool = False) -> list[str]:
    return [*LEAGUE, "dt", "hour", *(["match_id"] if by_match else [])]


def slot_places(team_rows: DataFrame, by_match: bool = False) -> DataFrame:
    """(slot_keys, team_id, place01) of every team of the season before every slot (same date and hour, the unknown hour -1).

    by_match: every match is a slot of its own, so that matches of the same date and hour with a smaller id count too.
    Teams are put against slots within a season, which both are bounded by; each season is a partition of its own.
    """
    slot = slot_keys(by_match)
    rows = team_rows.withColumn("hour", F.coalesce("hour_utc", F.lit(-1)))
    slots = rows.select(*slot).distinct()
    teams = rows.select(*LEAGUE, "team_id").distinct()
    per_slot = rows.groupBy(*slot, "team_id").agg(
        F.count("*").alias("played"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.sum(points(F.col("gf"), F.col("ga"))).alias("points")
    )
    dense = slots.join(teams, [*LEAGUE]).join(per_slot, [*slot, "team_id"], "left")
    before = Window.partitionBy(*LEAGUE, "team_id").orderBy(*slot[len(LEAGUE) :]).rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("played", "gf", "ga", "points")}
    so_far = dense.select(*slot, "team_id", *(v.alias(f"b_{k}") for k, v in sums.items())).withColumn("b_mean", ratio(F.col("b_points"), F.col("b_played"), 0.0))
    at = Window.partitionBy(*slot)
    rank = F.row_number().over(at.orderBy(*table_order("b_mean", "b_gf", "b_ga")))
    n = F.count("*").over(at)
    places = so_far.withColumn("place01", F.when(n > 1, 1 - (rank - 1) / (n - 1)).otherwise(F.lit(1.0)))
    return places.select(*slot, "team_id", "place01")


def pre_match_places(team_rows: DataFrame, by_match: bool = False) -> DataFrame:
    """(match_id, team_id, place01) before each match: its teams' places of slot_places."""
    slot = slot_keys(by_match)
    asked = team_rows.withColumn("hour", F.coalesce("hour_utc", F.lit(-1))).select(*dict.fromkeys(["match_id", *slot, "team_id"]))
    return asked.join(slot_places(team_rows, by_match), [*slot, "team_id"]).select("match_id", "team_id", "place01")


def season_dates(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*LEAGUE).agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def projected_end(day: Column, season: Column, first_month: int) -> Column:
    """A template end date moved into a season; 29 February falls back to the month's last day."""
    year = season + (F.month(day) < first_month).cast("int")
    first = F.make_date(year, F.month(day), F.lit(1))
    return F.least(F.date_add(first, F.dayofmonth(day) - 1), F.last_day(first))


def season_position() -> Column:
    """Where a match lies between its season's first and last dates (first_dt, last_dt), with its hour."""
    day = F.lit(86400.0)
    passed = F.unix_timestamp("dt") - F.unix_timestamp("first_dt") + F.coalesce(F.col("hour_utc"), F.lit(0)) * 3600
    return clip01(F.coalesce(F.try_divide(passed / day, (F.unix_timestamp("last_dt") - F.unix_timestamp("first_dt")) / day), F.lit(0.0)))


def regular_season(matches: DataFrame) -> DataFrame:
    """matches with regular: true until the round first differs from the season's first round."""
    w = Window.partitionBy(*LEAGUE).orderBy(*in_order())
    marked = matches.withColumn("initial_round", F.first("round_id").over(w))
    left = F.max((F.col("round_id") != F.col("initial_round")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("regular", left == 0)


def season_breakdown(matches: DataFrame) -> DataFrame:
    """Regular and other matches of each season, with its rounds."""
    flagged = regular_season(matches)
    return flagged.groupBy(*LEAGUE).agg(
        F.count("*").alias("matches"), F.count_if("regular").alias("regular_matches"), F.count_if(~F.col("regular")).alias("other_matches"),
        F.countDistinct("round_id").alias("rounds"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
    )


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """(value, dense_id) of the distinct values in ascending order, from 0; ranked within buckets (a text's first three characters, a number's
    multiples of 4,096) and by the sizes of earlier buckets."""
    rows = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    text = rows.schema["value"].dataType.typeName() in ("string", "varchar", "char")
    bucket = F.substring("value", 1, 3) if text else F.floor(F.col("value") / 4096)
    return with_rank(rows, bucket, [F.col("value")]).select("value", (F.col("rn") - 1).cast("long").alias("dense_id"))


def most_frequent(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that which came first."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
