"""Team form: the two-rows-per-match view and windows over a team's earlier matches.

Every window is partitioned by team (and role), so one shuffle by team serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.scalars import clip01, known, points, scaled

ORDER = ("dt", "hour_key", "match_id")


def in_order() -> list[Column]:
    """Chronological order: date, hour (unknown first), id."""
    return [F.col("dt"), F.coalesce(F.col("hour_utc"), F.lit(-1)), F.col("match_id")]


def team_matches(matches: DataFrame, home_stats: dict[str, str] | None = None, away_stats: dict[str, str] | None = None) -> DataFrame:
    """Two rows per match: team_id, role, gf, ga, and own_/opp_ statistics named by the keys of home_stats and away_stats."""
    home_stats, away_stats = home_stats or {}, away_stats or {}
    sides = []
    for role, own, opp, mine, theirs in (("home", "home", "away", home_stats, away_stats), ("away", "away", "home", away_stats, home_stats)):
        values = [F.col(f"{own}_id").alias("team_id"), F.col(f"{opp}_id").alias("opponent_id"), F.lit(role).alias("role"), F.col(f"{own}_goals").alias("gf"), F.col(f"{opp}_goals").alias("ga")]
        values += [F.col(c).alias(f"own_{k}") for k, c in mine.items()] + [F.col(c).alias(f"opp_{k}") for k, c in theirs.items()]
        sides.append(F.struct(*values))
    kept = [c for c in matches.columns if c in ("match_id", "dt", "hour_utc", "season", "competition", "comp_season_id", "round_id")]
    return matches.select(*kept, F.explode(F.array(*sides)).alias("side")).select(*kept, "side.*")


def last_n(n: int, *partition: str):
    """The n rows before the current one of a team's matches."""
    return Window.partitionBy(*(partition or ("team_id",))).orderBy(*in_order()).rowsBetween(-n, -1)


def mean_last_n(value: Column, n: int, normalise: Callable[[Column], Column] = clip01, partition: tuple[str, ...] = ("team_id",)) -> Column:
    """Normalised mean of a value over the last n rows; missing values shrink the denominator; without any the least value."""
    mean = F.avg(value).over(last_n(n, *partition))
    return F.when(mean.isNull(), F.lit(C.ALMOST_ZERO)).otherwise(normalise(mean))


def stat_mean(column: str, n: int, most: float) -> Column:
    return mean_last_n(known(F.col(column)), n, lambda x: scaled(x, most))


def total_mean(own: str, opponent: str, n: int, most: float) -> Column:
    """Mean of both sides' sum, missing where either is."""
    return mean_last_n(known(F.col(own)) + known(F.col(opponent)), n, lambda x: scaled(x, most))


def points_mean(n: int) -> Column:
    return mean_last_n(points(F.col("gf"), F.col("ga")).cast("double"), n, lambda x: scaled(x, C.SCALES["points"]))


def goals_mean(n: int) -> Column:
    return mean_last_n(F.col("gf").cast("double"), n, lambda x: scaled(x, C.SCALES["goals"]))


def role_goals(n: int) -> tuple[Column, Column]:
    """Means of goals scored and conceded over the team's last n matches in this role."""
    made = [mean_last_n(F.col(c).cast("double"), n, lambda x: scaled(x, C.SCALES["goals"]), ("team_id", "role")) for c in ("gf", "ga")]
    return made[0], made[1]


def match_load(days: int, most: float | None = None) -> Column:
    """Matches of the team strictly before this one and at most days calendar days ago, by day; scaled if most is given.

    Those before this one, less those before the first of these days: both counts run on from row to row, however many matches a day has.
    """
    day = F.datediff(F.col("dt").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    earlier = F.row_number().over(Window.partitionBy("team_id").orderBy(*in_order())) - 1
    long_ago = F.count("*").over(Window.partitionBy("team_id").orderBy(day).rangeBetween(Window.unboundedPreceding, -days - 1))
    load = (earlier - F.when(day.isNull(), 0).otherwise(long_ago)) / F.lit(float(days))
    return load if most is None else scaled(load, most)


def previous_match(*fields: str, partition: tuple[str, ...] = ("team_id",)) -> Column:
    """The fields of the team's match before this one, as a struct; null for the first."""
    return F.lag(F.struct(*fields)).over(Window.partitionBy(*partition).orderBy(*in_order()))


def previous_where(condition: Column, *fields: str) -> Column:
    """The fields of the team's last earlier match for which condition holds."""
    return F.last(F.when(condition, F.struct(*fields)), ignorenulls=True).over(last_n_all())


def last_n_all():
    return Window.partitionBy("team_id").orderBy(*in_order()).rowsBetween(Window.unboundedPreceding, -1)


def last_matches(n: int, *fields: str) -> Column:
    """The last n earlier matches, oldest first."""
    return F.collect_list(F.struct(*fields)).over(last_n(n))


def padded_sequence(vector: Column, n: int, width: int) -> Column:
    """The last n earlier vectors, padded in front with zero vectors to n."""
    seen = F.collect_list(vector).over(last_n(n))
    zero = F.array_repeat(F.lit(0.0), width)
    return F.concat(F.array_repeat(zero, F.lit(n) - F.size(seen)), seen)


def home_and_away(rows: DataFrame, *columns: str) -> DataFrame:
    """Back to one row per match: home_ and away_ of each column."""
    aggs = [F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}") for role in ("home", "away") for c in columns]
    return rows.groupBy("match_id").agg(*aggs)


def form_features(rows: DataFrame, n: int = 5, long_n: int = 20, days: int = 14) -> DataFrame:
    """The rolling features of a team view that has own_ and opp_ shots."""
    scored, conceded = role_goals(long_n)
    return rows.select(
        "match_id", "team_id", "role", points_mean(n).alias("points_n"), goals_mean(n).alias("goals_n"),
        stat_mean("own_shots", n, C.SCALES["shots"]).alias("shots_n"), total_mean("own_shots", "opp_shots", n, 2 * C.SCALES["shots"]).alias("total_shots_n"),
        scored.alias("role_scored_n"), conceded.alias("role_conceded_n"), match_load(days, C.SCALES["load"]).alias("load"),
    )
