"""Table eligibility, round names, small repairs and report aggregates of match data; one shuffle by its keys each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import FIRST_SEASON, LAST_SEASON
from touchline.functions.ordered import with_running_profit
from touchline.functions.scalars import ratio


def table_matches(matches: DataFrame, seasons: DataFrame, rounds: DataFrame, first: int = FIRST_SEASON, last: int = LAST_SEASON) -> DataFrame:
    """Matches that count in a league table: dated, of a season in [first, last), whose competition and comp_season_id are those of a row of
    seasons(competition, season, comp_season_id), in a round of rounds(competition, season, round_id). A season without rounds has no table."""
    dated = matches.where(F.col("dt").isNotNull() & (F.col("season") >= first) & (F.col("season") < last))
    own = dated.join(seasons.select("competition", "season", "comp_season_id").distinct(), ["competition", "season", "comp_season_id"], "left_semi")
    return own.join(rounds.select("competition", "season", "round_id").distinct(), ["competition", "season", "round_id"], "left_semi")


def seasons_without_rounds(matches: DataFrame, rounds: DataFrame) -> DataFrame:
    """(competition, season, matches) of seasons that have matches but no listed round."""
    counts = matches.groupBy("competition", "season").agg(F.count("*").alias("matches"))
    return counts.join(rounds.select("competition", "season").distinct(), ["competition", "season"], "left_anti")


def round_group(name: Column, keywords: Sequence[str]) -> Column:
    """The first of keywords that a round's name contains, whatever the case; null for none."""
    found = [F.when(F.contains(F.lower(name), F.lit(k.lower())), F.lit(k)) for k in keywords]
    return F.coalesce(*found, F.lit(None).cast("string"))


def is_regular(name: Column, keywords: Sequence[str]) -> Column:
    """Whether a round's name contains one of keywords, as written."""
    return F.coalesce(F.greatest(*[F.contains(name, F.lit(k)) for k in keywords], F.lit(False)), F.lit(False))


def display_name(known_as: Column, full_name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(known_as), F.lit("")), full_name)


def backfilled(start: Column, end: Column) -> Column:
    """A starting value, or the last one where it is empty."""
    return F.coalesce(F.when(F.trim(start) != "", start), end)


def zero_filled(rows: DataFrame, batch: list[str], columns: list[str]) -> DataFrame:
    """rows with -1 as 0 in each column that some row of the batch has a value of."""
    have = rows.groupBy(*batch).agg(*[(F.max(c) > -1).alias(f"_has_{c}") for c in columns])
    joined = rows.join(have, batch)
    return joined.select(*[F.when(F.col(f"_has_{c}") & (F.col(c) == -1), F.lit(0).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def team_match_counts(team_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of each team, at home and in all."""
    return team_rows.groupBy(*keys, "team_id").agg(F.count("*").alias("matches"), F.count_if(F.col("role") == "home").alias("home_matches"))


def over_under(matches: DataFrame, keys: list[str], line: float = 2.5) -> DataFrame:
    """Matches with fewer and with more goals than the line, and the share of the first."""
    total = F.col("home_goals") + F.col("away_goals")
    counts = matches.where(total.isNotNull()).groupBy(*keys).agg(F.count("*").alias("matches"), F.count_if(total < line).alias("under"), F.count_if(total > line).alias("over"))
    return counts.withColumn("under_rate", ratio(F.col("under"), F.col("matches"), 0.0))


def valid_share(rows: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Share of known values (0 or more) of each attribute by keys."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("value")) for a in attributes])
    long = rows.select(*keys, F.inline(pairs))
    got = long.groupBy(*keys, "attribute").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 0).alias("valid"))
    return got.withColumn("share", ratio(F.col("valid"), F.col("n"), 0.0))


def competition_totals(breakdown: DataFrame) -> DataFrame:
    """Sums over the seasons of league.season_breakdown, and the share of matches outside of the regular season."""
    sums = breakdown.groupBy("competition").agg(*[F.sum(c).alias(c) for c in ("matches", "regular_matches", "other_matches")])
    return sums.withColumn("other_share", ratio(F.col("other_matches"), F.col("matches"), 0.0))


def highlighted(summary: DataFrame, name: str, value: str, fixed: Sequence[str], top: int = 4, bottom: int = 1) -> DataFrame:
    """The fixed names, and the top and bottom rows of the others by value (ties by name): one row a name, as many as a report shows."""
    others = summary.where(~F.col(name).isin(list(fixed)))
    best = others.orderBy(F.desc(value), name).limit(top)
    worst = others.orderBy(value, F.desc(name)).limit(bottom)
    return best.union(worst).union(summary.where(F.col(name).isin(list(fixed)))).distinct()


def selected_bets(bets: DataFrame, least: float, most: float) -> DataFrame:
    """bets(dt, match_id, stake, returned) with running sums of stakes and returns over those whose stake is in [least, most]; others show the last sums."""
    chosen = F.col("stake").between(least, most)
    rows = bets.withColumn("day", F.col("dt").cast("date")).withColumn("_stake", F.when(chosen, F.col("stake")).otherwise(0.0)).withColumn("_back", F.when(chosen, F.col("returned")).otherwise(0.0))
    staked = with_running_profit(rows, [], "day", ["dt", "match_id"], "_stake").withColumnRenamed("cumulative", "total_stake").drop("drawdown")
    back = with_running_profit(rows, [], "day", ["dt", "match_id"], "_back").select("match_id", F.col("cumulative").alias("total_returned"))
    return staked.join(back, "match_id").drop("_stake", "_back", "day")


def shortened_mean(value: Column, order: Column, window: int, *partition: str) -> Column:
    """Centred moving average, or the value itself where a partition has fewer rows than the window."""
    whole = Window.partitionBy(*partition)
    half = window // 2
    return F.when(F.count("*").over(whole) < window, value).otherwise(F.avg(value).over(whole.orderBy(order).rowsBetween(-half, half)))


def _listed(matches: DataFrame, listed: DataFrame) -> DataFrame:
    """matches with kept: whether (competition, season, round_id) is listed."""
    known = listed.select("competition", "season", "round_id", F.lit(True).alias("kept")).distinct()
    return matches.join(known, ["competition", "season", "round_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def season_shares(matches: DataFrame, listed: DataFrame) -> DataFrame:
    """Of each (competition, season) of matches(…, regular): regular and other matches, kept or filtered by the listed rounds, distinct rounds of each, and matches a team."""
    rows = _listed(matches, listed)
    other = ~F.col("regular")
    rounds = lambda keep: F.count_distinct(F.when(keep, F.col("round_id")))
    keys = ["competition", "season"]
    got = rows.groupBy(*keys).agg(
        F.count("*").alias("matches"), F.count_if("regular").alias("regular_matches"), F.count_if(other).alias("other_matches"), F.count_if(other & F.col("kept")).alias("other_kept"),
        F.count_if(other & ~F.col("kept")).alias("other_filtered"), rounds(F.lit(True)).alias("rounds"), rounds(F.col("regular")).alias("regular_rounds"), rounds(other).alias("other_rounds"),
        rounds(F.col("kept")).alias("kept_rounds"), rounds(~F.col("kept")).alias("filtered_rounds"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
    )
    teams = rows.select(*keys, F.explode(F.array("home_id", "away_id")).alias("team_id")).where("team_id is not null").groupBy(*keys, "team_id").agg(F.count("*").alias("n"))
    sizes = teams.groupBy(*keys).agg(F.count("*").alias("teams"), F.min("n").alias("least_matches"), F.max("n").alias("most_matches"), F.median("n").alias("median_matches"))
    return got.join(sizes, keys, "left").withColumn("other_share", ratio(F.col("other_matches"), F.col("matches"), 0.0))


def round_types(matches: DataFrame, listed: DataFrame, only_affected: bool = False) -> DataFrame:
    """Of each (competition, season, round_id): matches, teams, regular and other, whether kept, and the type that follows; only_affected: seasons with other matches alone."""
    keys = ["competition", "season"]
    rows = _listed(matches, listed).where("round_id is not null")
    if only_affected:
        rows = rows.join(matches.where("not regular").select(*keys).distinct(), keys, "left_semi")
    one = rows.groupBy(*keys, "round_id").agg(
        F.count("*").alias("matches"), F.count_if("regular").alias("regular_matches"), F.count_if(~F.col("regular")).alias("other_matches"), F.bool_or("kept").alias("kept"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")
    )
    teams = rows.select(*keys, "round_id", F.explode(F.array("home_id", "away_id")).alias("team_id")).groupBy(*keys, "round_id").agg(F.count_distinct("team_id").alias("teams"))
    kind = F.when(F.col("other_matches") == 0, "regular").when(F.col("regular_matches") == 0, "other").otherwise("mixed")
    return one.join(teams, [*keys, "round_id"]).withColumn("round_type", kind)


def missing_skill_rates(strength: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Of each competition and of all (null): cells, missing cells, rows and rows without any cell of strength(competition, matrix), and their shares; matrices of another shape are left out.

    In place of matrices, strength may have what `validation.cell_counts` gives.
    """
    if "matrix" in strength.columns:
        fits = (F.size("matrix") == shape[0]) & F.forall("matrix", lambda r: F.size(r) == shape[1])
        lost = F.transform("matrix", lambda r: F.size(F.filter(r, lambda x: F.coalesce(x < 0, F.lit(True)))))
        rows = strength.where(fits).select("competition", F.aggregate(lost, F.lit(0), lambda a, x: a + x).alias("lost"), F.size(F.filter(lost, lambda x: x == shape[1])).alias("empty"))
    else:
        rows = strength.where("ok").select("competition", "lost", "empty")
    got = rows.groupingSets([["competition"], []], "competition").agg((F.count("*") * shape[0] * shape[1]).alias("cells"), F.sum("lost").alias("missing_cells"), (F.count("*") * shape[0]).alias("player_rows"), F.sum("empty").alias("empty_rows"))
    return got.withColumn("missing_share", ratio(F.col("missing_cells"), F.col("cells"), 0.0)).withColumn("empty_share", ratio(F.col("empty_rows"), F.col("player_rows"), 0.0))


def variant_gains(metrics: DataFrame, baseline: str, keys: list[str], values: list[str]) -> DataFrame:
    """Of each group and variant but the baseline of metrics(variant, keys…, values…): the values and what they gain on the baseline's; groups that only one side has give null gains."""
    base = metrics.where(F.col("variant") == baseline).select(*keys, *[F.col(v).alias(f"base_{v}") for v in values])
    rows = metrics.where(F.col("variant") != baseline).select("variant", *keys, *values).join(base, keys, "left")
    return rows.select("variant", *keys, *values, *[(F.col(v) - F.col(f"base_{v}")).alias(f"{v}_gain") for v in values])
