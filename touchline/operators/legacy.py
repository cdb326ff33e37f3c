"""Variants of an older data feed: other bounds, other conventions for empty histories, imitated players."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.ordered import with_rank
from touchline.functions.scalars import points, ratio
from touchline.operators.form import in_order, last_n
from touchline.operators.sequential import streamed

# Fixed values of the older feed.
LOW, HIGH = 0.001, 0.999
INIT_ELO, ELO_LEAST, ELO_MOST = 1500.0, 1000.0, 2000.0
FORMATION = (("goalkeeper", 1), ("defender", 4), ("midfielder", 4), ("attacker", 2))
ROW_ROLES = ("goalkeeper", "defender", "defender", "defender", "defender", "midfielder", "midfielder", "midfielder", "midfielder", "attacker", "attacker")
FALLBACK = (2024, 948)
LATE_DAYS, LATE_DAYS_LONG = 16, 46


def clip(x: Column) -> Column:
    return F.when(x <= 0, F.lit(LOW)).when(x >= 1, F.lit(HIGH)).otherwise(x)


def elo01(elo: Column) -> Column:
    """Elo between its bounds, the ends being exactly 0 and 1."""
    x = (elo - ELO_LEAST) / (ELO_MOST - ELO_LEAST)
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def mean_last_n(value: Column, n: int, most: float) -> Column:
    """Scaled mean over the last n rows; 0 for an empty history."""
    mean = F.avg(value).over(last_n(n))
    return F.when(mean.isNull(), F.lit(0.0)).otherwise(clip(mean / F.lit(float(most))))


def free_days_load(days: int, most: float = 0.24) -> Column:
    """1 less the scaled match load, where matches count by their time, not their day."""
    now = F.unix_timestamp("dt")
    w = Window.partitionBy("team_id").orderBy(now).rangeBetween(-days * 86400, 0)
    same = Window.partitionBy("team_id", "dt").orderBy(*in_order()).rowsBetween(0, Window.unboundedFollowing)
    return 1 - clip((F.count("*").over(w) - F.count("*").over(same)) / F.lit(float(days)) / most)


def places_so_far(team_rows: DataFrame) -> DataFrame:
    """(match_id, team_id, place01) with 1 - place / teams, over matches strictly before the match's time."""
    league = ["season", "competition"]
    slots, teams = team_rows.select(*league, "dt").distinct(), team_rows.select(*league, "team_id").distinct()
    per = team_rows.groupBy(*league, "dt", "team_id").agg(F.sum(points(F.col("gf"), F.col("ga"))).alias("p"), F.sum(F.col("gf") - F.col("ga")).alias("d"), F.sum("gf").alias("f"), F.count("*").alias("n"))
    before = Window.partitionBy(*league, "team_id").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    dense = slots.join(teams, league).join(per, [*league, "dt", "team_id"], "left").select(*league, "dt", "team_id", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in "pdfn"])
    at = Window.partitionBy(*league, "dt")
    rank = F.row_number().over(at.orderBy(F.desc(ratio(F.col("p"), F.col("n"), 0.0)), F.desc("d"), F.desc("f"), "team_id"))
    placed = dense.withColumn("place01", 1 - rank / F.count("*").over(at))
    return team_rows.select("match_id", *league, "dt", "team_id").join(placed.select(*league, "dt", "team_id", "place01"), [*league, "dt", "team_id"]).select("match_id", "team_id", "place01")


def country_windows(seasons: DataFrame, world: str = "World") -> DataFrame:
    """(country, season, start, end) of seasons(country, season, start, end): widened by those of `world` competitions."""
    own = seasons.where(F.col("country") != world).groupBy("country", "season").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    wide = seasons.where(F.col("country") == world).groupBy("season").agg(F.min("start").alias("w_start"), F.max("end").alias("w_end"))
    return own.join(wide, "season", "left").select("country", "season", F.least("start", "w_start").alias("start"), F.greatest("end", "w_end").alias("end"))


def place_in_season(day: Column, start: Column, end: Column, long: Column) -> Column:
    """Share of the season passed; just outside of it the ends; null further off. long: competitions with the longer margin."""
    margin = F.when(long, LATE_DAYS_LONG).otherwise(LATE_DAYS)
    inside = F.try_divide(F.datediff(day, start).cast("double"), F.datediff(end, start).cast("double"))
    return F.when((day >= start) & (day <= end), inside).when((day >= start) & (F.datediff(day, end) <= margin), HIGH).when((day <= end) & (F.datediff(start, day) <= margin), LOW)


def stat_value(stats: Column, name: str, side: int, percent: bool = False) -> Column:
    """The value of a named statistic in array<struct(statistics array<struct(type, value)>)> of two sides; missing ones -1; '45%' as 0.45."""
    own = F.get(F.filter(F.get(stats, F.lit(side))["statistics"], lambda s: s["type"] == name), F.lit(0))["value"]
    number = F.regexp_replace(own, "%", "").try_cast("double") / F.lit(100.0) if percent else own.try_cast("double")
    return F.when(F.size(stats) == 0, F.lit(C.MISSING)).when(F.size(stats) == 2, F.coalesce(number, F.lit(C.MISSING))).otherwise(F.raise_error(F.lit("two sides expected")))


def imitated_rows(asked: DataFrame, averages: DataFrame) -> DataFrame:
    """asked(…, season, team_id, role) with skills: the team's average of the role, else the fallback team's; an all-zero goalkeeper takes the overall one.

    averages(season, team_id, role, skills); the overall rows have season and team -1.
    """
    zero = F.forall("skills", lambda x: x == 0)
    overall = averages.where("season = -1 and team_id = -1 and role = 'goalkeeper'").select(F.first("skills").alias("_any"))
    usable = averages.join(F.broadcast(overall)).withColumn("skills", F.when((F.col("role") == "goalkeeper") & zero, F.col("_any")).otherwise(F.col("skills"))).drop("_any")
    spare = usable.where((F.col("season") == FALLBACK[0]) & (F.col("team_id") == FALLBACK[1])).select("role", F.col("skills").alias("_spare"))
    # one row a role at most
    got = asked.join(usable, ["season", "team_id", "role"], "left").join(F.broadcast(spare.dropDuplicates(["role"])), "role", "left")
    return got.withColumn("skills", F.coalesce("skills", "_spare")).drop("_spare")


def imitated_team(teams: DataFrame, averages: DataFrame) -> DataFrame:
    """(season, team_id, matrix): a 4-4-2 of role averages."""
    rows = teams.select("season", "team_id", F.posexplode(F.array(*[F.lit(r) for r in ROW_ROLES])).alias("slot", "role"))
    filled = imitated_rows(rows, averages).groupBy("season", "team_id").agg(F.array_sort(F.collect_list(F.struct("slot", "skills"))).alias("m"))
    return filled.select("season", "team_id", F.transform("m", lambda x: x["skills"]).alias("matrix"))


def balanced(matrix: Column, spare: Column) -> Column:
    """A matrix whose first row is a goalkeeper and whose others are not: rows that look otherwise are replaced by those of spare (a 4-4-2 matrix)."""

    def mean(row: Column, first: int, n: int) -> Column:
        return F.aggregate(F.slice(row, first, n), F.lit(0.0), lambda a, x: a + x) / n

    def row(r: Column, i: Column) -> Column:
        keeper = mean(r, 30, 4) - mean(r, 1, 29)
        return F.when(((i == 0) & (keeper < 0)) | ((i > 0) & (keeper > 0)), F.get(spare, i)).otherwise(r)

    return F.transform(matrix, row)


def previous_result_elo(matches: DataFrame, component: str = "competition", k: float = C.ELO_K) -> DataFrame:
    """(match_id, home_elo, away_elo): each team's rating is moved by the result of its previous match, against the expectation of this one."""

    def make() -> Callable[..., tuple]:
        state: dict[int, tuple[float, float]] = {}

        def step(m: int, home: int, away: int, hg: float, ag: float) -> tuple[int, float, float]:
            (rh, sh), (ra, sa) = state.get(home, (INIT_ELO, 0.5)), state.get(away, (INIT_ELO, 0.5))
            expected = 1 / (1 + 10 ** ((ra - rh) / 400))
            new = rh + k * (sh - expected), ra + k * (sa - (1 - expected))
            got = (hg > ag) + 0.5 * (hg == ag)
            state[home], state[away] = (new[0], got), (new[1], 1 - got)
            return (m, *new)

        return step

    return streamed(matches, component, make, ["match_id", "home_id", "away_id", "home_goals", "away_goals"], "match_id long, home_elo double, away_elo double")


def sample_pairs(rows: DataFrame, label: str, key: str, k: int = 10, seed: int = 1) -> DataFrame:
    """For each row k others of its label (same true) and k of other labels (same false), or all where there are fewer, drawn by hashed keys.

    Rows are ranked by label and hashed key, so that a label is an interval of ranks. Like rows are the next k in it; unlike ones are drawn from
    k equal strata of the ranks outside of it, one from each. So all draws are one equi-join on rank, and no label's rows are ever joined with
    each other. Rows without a label take no part.
    """
    hashed = F.xxhash64(F.lit(seed), key)
    known = rows.where(F.col(label).isNotNull()).select(key, label)
    placed = with_rank(known, F.struct(F.col(label), F.shiftrightunsigned(hashed, 56)), [hashed, F.col(key)]).withColumn("i", F.col("rn") - 1).drop("rn")
    spans = placed.groupBy(label).agg(F.min("i").alias("first"), F.count("*").alias("size"))
    sized = placed.join(spans, label).withColumn("others", F.col("n") - F.col("size"))
    i, first, size, others, step = (F.col(x) for x in ("i", "first", "size", "others", "step"))

    alike = sized.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).where(step < size)
    alike = alike.select(key, (first + (i - first + step) % size).alias("j"), F.lit(True).alias("same"))

    draws = F.least(others, F.lit(k))
    unlike = sized.where(others > 0).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(step < others)
    low, high = F.floor(step * others / draws), F.floor((step + 1) * others / draws)
    turned = (low + F.pmod(F.xxhash64(F.lit(seed + 1), "step", key), high - low) + F.pmod(F.xxhash64(F.lit(seed + 2), key), others)) % others
    unlike = unlike.select(key, turned.alias("j"), first.alias("first"), size.alias("size")).select(key, F.when(F.col("j") < first, F.col("j")).otherwise(F.col("j") + size).alias("j"), F.lit(False).alias("same"))

    return alike.union(unlike).join(placed.select(F.col("i").alias("j"), F.col(key).alias("other")), "j").select(key, "other", "same")


def hard_pairs(pairs: DataFrame, margin: float = 0.8) -> DataFrame:
    """Unlike pairs nearer than the margin."""
    return pairs.where(~F.col("same") & (F.col("distance") < margin))


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] over the table (0 where constant); the ends come from one aggregate row."""
    ends = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))])
    scaled = {c: ratio(F.col(c) - F.col(f"_a_{c}"), F.col(f"_b_{c}") - F.col(f"_a_{c}"), 0.0) for c in columns}
    return rows.join(F.broadcast(ends)).withColumns(scaled).select(*rows.columns)


def json_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns as JSON text, for CSV files."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def parsed_lineup(text: Column) -> Column:
    """A line-up of JSON objects with ids; any id that is no whole number empties it."""
    rows = F.from_json(text, "array<struct<id:string,pos:string>>")
    good = F.forall(rows, lambda x: F.coalesce(F.regexp_like(x["id"], F.lit("^[0-9]+$")), F.lit(False)))
    none = F.filter(rows, lambda x: F.lit(False))
    return F.when(good, rows).otherwise(none)


def clear_goalkeeper_scale(matrix: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Rows scaled by the ends (low, high percentile) of goalkeepers (first row) and of others, clipped to [0, 1]."""
    return F.transform(matrix, lambda r, i: F.transform(r, lambda x: F.least(F.greatest(F.when(i == 0, (x - low[0]) / (low[1] - low[0])).otherwise((x - high[0]) / (high[1] - high[0])), F.lit(0.0)), F.lit(1.0))))
