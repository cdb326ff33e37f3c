"""Folds that depend on every earlier step: Elo ratings and rounds without a repeated team."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.lineage import cut

ELO_SCHEMA = "match_id long, home_elo double, away_elo double, home_elo_after double, away_elo_after double"


class EloTable:
    """Ratings of the teams of one component, in match order."""

    def __init__(self, k: float = C.ELO_K, start: float = C.INIT_ELO, regression: float = C.ELO_SEASON_REGRESSION) -> None:
        self.k, self.start, self.regression, self.state = k, start, regression, {}

    def before(self, team: int, season: int) -> float:
        """A team's rating before a match of a season, drawn towards the start if its last match was of another one."""
        rating, last = self.state.get(team, (self.start, season))
        return rating if last == season else self.start + self.regression * (rating - self.start)

    def play(self, season: int, home: int, away: int, home_goals: float, away_goals: float) -> tuple[float, float, float, float]:
        rh, ra = self.before(home, season), self.before(away, season)
        expected = 1 / (1 + 10 ** ((ra - rh) / 400))
        got = (home_goals > away_goals) + 0.5 * (home_goals == away_goals)
        change = self.k * (got - expected)
        self.state[home], self.state[away] = (rh + change, season), (ra - change, season)
        return rh, ra, rh + change, ra - change


def streamed(rows: DataFrame, component: str, make: Callable[[], Callable[..., tuple]], columns: list[str], out: str) -> DataFrame:
    """One tuple of `out` for each row of `columns`, from a function that make() makes anew for each component and that keeps the component's state.

    A component's rows are one ordered stream through one task, since each step needs the one before; the task holds a batch and the state,
    not the component. It is dealt out by a hash of its own, since a repartition by the component itself is left out of the plan where rows come from a join
    by it, and the adaptive plan may then read that join's shuffle in pieces.
    """
    names = [x.split()[0] for x in out.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for frame in frames:
            made = []
            for key, *values in zip(*[frame[x].tolist() for x in (component, *columns)], strict=True):
                if step is None or key != now:
                    now, step = key, make()
                made.append(step(*values))
            yield pd.DataFrame(dict(zip(names, zip(*made, strict=True), strict=True)) if made else [], columns=names)

    hour = F.coalesce("hour_utc", F.lit(-1)).alias("_hour")
    ordered = rows.select(F.coalesce(F.col(component).cast("string"), F.lit("")).alias(component), "dt", hour, *columns).repartition(F.xxhash64(component))
    return ordered.sortWithinPartitions(component, "dt", "_hour", "match_id").mapInPandas(run, out)


def elo_ratings(matches: DataFrame, component: str = "competition") -> DataFrame:
    """Ratings before and after each match. Teams of different components never meet, so components run in parallel, each as one stream."""

    def make() -> Callable[..., tuple]:
        table = EloTable()
        return lambda match_id, *x: (match_id, *table.play(*x))

    return streamed(matches, component, make, ["match_id", "season", "home_id", "away_id", "home_goals", "away_goals"], ELO_SCHEMA)


ROUND_BLOCK = 1 << 20


def round_links(matches: DataFrame) -> DataFrame:
    """(match_id, i, following): each match's place in chronological order, from 0, and that of the match that ends a round which begins with it (null: none does).

    A round that begins with match i ends where a team plays for the second time from i on: at the least next match of a team over all
    matches from i on. That running minimum is taken within days, and over a table with one row for each day. A match of a team with itself ends no round by
    that, and unknown teams end none.
    """
    placed = order_rank(matches.select("match_id", "home_id", "away_id", "dt", "hour_utc")).withColumn("i", F.col("rn") - 1)
    sides = placed.select("i", F.explode(F.array_distinct(F.array_compact(F.array("home_id", "away_id")))).alias("team"))
    again = sides.select("i", F.lead("i").over(Window.partitionBy("team").orderBy("i")).alias("next")).groupBy("i").agg(F.min("next").alias("next"))
    days = placed.select("i", "match_id", F.coalesce(F.col("dt").cast("date"), F.lit("0001-01-01").cast("date")).alias("day")).join(again, "i", "left")
    later = F.min("first").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))
    per_day = days.groupBy("day").agg(F.min("next").alias("first")).select("day", later.alias("later"))
    inside = F.min("next").over(Window.partitionBy("day").orderBy(F.desc("i")))
    return days.withColumn("inside", inside).join(per_day, "day").select("match_id", "i", F.least("inside", "later").alias("following"))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each match of a block: the first match beyond the block that begins a round if it does, and the rounds until then."""
    rows = rows.sort_values("i", ignore_index=True)
    first, following = int(rows.i.iloc[0]), rows.following.fillna(-1).astype("int64").to_numpy()
    n, leave, steps = len(rows), following.copy(), np.ones(len(rows), np.int64)
    for k in range(n - 1, -1, -1):
        if first <= following[k] < first + n:
            leave[k], steps[k] = leave[following[k] - first], steps[following[k] - first] + 1
    return pd.DataFrame({"i": rows.i, "leave": pd.Series(leave).where(leave >= 0).astype("Int64"), "steps": steps})


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """The round of each match of a block, given the first match in it that begins a round and that round's number."""
    rows = rows.sort_values("i", ignore_index=True)
    first, following = int(rows.i.iloc[0]), rows.following.fillna(-1).astype("int64").to_numpy()
    starts, at = np.zeros(len(rows), np.int64), -1 if pd.isna(rows.entry.iloc[0]) else int(rows.entry.iloc[0])
    while first <= at < first + len(rows):
        starts[at - first] = 1
        at = following[at - first]
    return pd.DataFrame({"match_id": rows.match_id, "round_index": rows.number.iloc[0] + np.cumsum(starts) - 1})


def greedy_rounds(matches: DataFrame, block: int = ROUND_BLOCK) -> DataFrame:
    """(match_id, round_index): in order, a new round begins with the match one of whose teams already plays in the round.

    Rounds are the chain of round_links from the first match on. It is followed within blocks of matches; across blocks, each match knows where the chain that
    it begins leaves its block, and the blocks' entries are found by doubling: joins as many as the logarithm of the number of blocks, none where
    one block holds all. A task holds one block, which groupBy keeps whole: a repartition by block after the join by block is left out of the plan, and the
    adaptive plan may then read the join's shuffle in pieces.
    """
    links = round_links(matches).withColumn("block", F.floor(F.col("i") / block))
    last = links.agg(F.max("block")).first()[0] or 0
    spark = links.sparkSession
    if not last:
        rounds = links.withColumn("entry", F.lit(0).cast("long")).withColumn("number", F.lit(0).cast("long"))
        return rounds.groupBy("block").applyInPandas(_followed, "match_id long, round_index long")
    links = cut(links)
    exits = cut(links.select("block", "i", "following").groupBy("block").applyInPandas(_exits, "i long, leave long, steps long"))
    entries, jump = spark.createDataFrame([(0, 0)], "entry long, number long"), exits
    for _ in range(int(last).bit_length()):
        reached = entries.join(jump, F.col("entry") == F.col("i")).where("leave is not null").select(F.col("leave").alias("entry"), (F.col("number") + F.col("steps")).alias("number"))
        entries = cut(entries.union(reached))
        on = jump.select(F.col("i").alias("leave"), F.col("leave").alias("further"), F.col("steps").alias("more"))
        jump = cut(jump.join(on, "leave", "left").select("i", F.col("further").alias("leave"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    # a block without an entry belongs to the round before the next entry's, or to the last one; one row a block
    total = entries.join(exits.where("leave is null"), F.col("entry") == F.col("i")).agg(F.max(F.col("number") + F.col("steps"))).first()[0]
    first = entries.select(F.floor(F.col("entry") / block).alias("block"), "entry", "number")
    after = F.min("number").over(Window.orderBy("block").rowsBetween(0, Window.unboundedFollowing))
    blocks = spark.range(last + 1).select(F.col("id").alias("block")).join(first, "block", "left").select("block", "entry", F.coalesce(after, F.lit(total)).alias("number"))
    rounds = links.join(blocks, "block")
    return rounds.groupBy("block").applyInPandas(_followed, "match_id long, round_index long")


def uniform_rounds(ranked: DataFrame, size: int = 50, least: int = 25) -> DataFrame:
    """Rounds of a fixed size over rn (from 1) and n: the match that arrives when a round is full is lost; a short last round joins the one before."""
    step = size + 1
    kept = ranked.where((F.col("rn") - 1) % step != size).withColumn("round_index", F.floor((F.col("rn") - 1) / step))
    tail = F.col("n") % step
    last = F.floor((F.col("n") - 1) / step)
    short = (F.col("round_index") == last) & (last > 0) & (tail > 0) & (tail < least)
    return kept.withColumn("round_index", F.when(short, F.col("round_index") - 1).otherwise(F.col("round_index")).cast("long"))


def round_sizes(rounds: DataFrame) -> DataFrame:
    sizes = rounds.groupBy("round_index").count()
    return sizes.agg(F.count("*").alias("rounds"), F.min("count").alias("least"), F.max("count").alias("most"), F.avg("count").alias("mean"), F.median("count").alias("median"))


def repeated_teams(rounds: DataFrame, team_rows: DataFrame) -> DataFrame:
    """(round_index, team_id, n) of teams that play more than once in a round."""
    return team_rows.select("match_id", "team_id").join(rounds, "match_id").groupBy("round_index", "team_id").agg(F.count("*").alias("n")).where("n > 1")


def rolling_folds(rounds: DataFrame, window: int = 25) -> DataFrame:
    """(fold, match_id, part): each round from number `window` on is validated on the `window` rounds before it."""
    numbers = rounds.select(F.col("round_index").alias("fold")).distinct().where(F.col("fold") >= window)
    used = numbers.withColumn("round_index", F.explode(F.sequence(F.col("fold") - window, F.col("fold"))))
    part = F.when(F.col("round_index") == F.col("fold"), "validation").otherwise("training")
    return used.join(rounds, "round_index").select("fold", "match_id", part.alias("part"))


def spaced_folds(rounds: int, window: int, wanted: int) -> list[int]:
    """Evenly spaced fold numbers with the first and the last."""
    folds = list(range(window, rounds))
    if not folds or wanted < 1:
        raise ValueError("no folds to choose from")
    if wanted == 1 or len(folds) == 1:
        return folds[:1]
    wanted = min(wanted, len(folds))
    return [folds[i * (len(folds) - 1) // (wanted - 1)] for i in range(wanted)]


def chronology_faults(folds: DataFrame, matches: DataFrame) -> DataFrame:
    """Folds whose last training date is after the first validation date."""
    dated = folds.join(matches.select("match_id", "dt"), "match_id").groupBy("fold")
    ends = dated.agg(F.max(F.when(F.col("part") == "training", F.col("dt"))).alias("train_end"), F.min(F.when(F.col("part") == "validation", F.col("dt"))).alias("validation_start"))
    return ends.where("train_end > validation_start")


def order_rank(matches: DataFrame) -> DataFrame:
    """matches with rn and n in chronological order."""
    from touchline.functions.ordered import with_rank
    from touchline.operators.form import in_order

    return with_rank(matches, F.coalesce(F.col("dt").cast("date"), F.lit("0001-01-01").cast("date")), in_order())


def team_history_index(team_rows: DataFrame) -> DataFrame:
    """team_rows with each match's index in its team's history, from 0."""
    from touchline.operators.form import in_order

    return team_rows.withColumn("index", F.row_number().over(Window.partitionBy("team_id").orderBy(*in_order())) - 1)
