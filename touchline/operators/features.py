"""All pre-match features of a match in one row: ids, season and time, Elo, form, load, places, and optionally both strength matrices.

One shuffle by team brings its matches in order, from which each match's means and load are made in batches (NumPy, with the team's last rows kept from batch to batch);
what each step says of a match (times and places, ratings, either side's form) is then dealt out by match in one more shuffle and put side by side.
Places are looked up by slot (same season, competition, date and hour), whose teams are one map.

Defined results: a statistic that is null or -1 does not count, without any the feature is the least value; a match without a home or away team
has no row; a null hour counts as 0 in the times and comes first in order; a null date has month 1 and the least position; repeated rows of a match count as matches
of their own in the windows and give one row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from touchline import config as C
from touchline.functions.scalars import clip01, cyclic, elo01, known, points, season01
from touchline.operators import form, league
from touchline.operators.sequential import elo_ratings

#: Statistics of one side, and what their means are divided by; of both sides together.
SIDE_STATS = {
    "xg": "xg", "pre_match_xg": "pre_match_xg", "shots_on_target": "shots_on_target", "shots_off_target": "shots_off_target", "shots": "shots", "corners": "corners",
    "possession": "possession", "fouls": "fouls", "attacks": "attacks", "dangerous_attacks": "dangerous_attacks",
}
TOTAL_STATS = {"xg": "total_xg", "pre_match_xg": "total_pre_match_xg"}
LAST = (5, 20)
LOAD_DAYS = (10, 25)


def side_features() -> list[str]:
    """Names of one side's features, without home_ or away_ before them, in a fixed order."""
    stats = [f"{name}_last_{n}" for name in (*SIDE_STATS, *(f"total_{x}" for x in TOTAL_STATS), "points", "goals", "role_scored", "role_conceded") for n in LAST]
    return ["elo", "place", *stats, *(f"load_{n}" for n in LOAD_DAYS)]


def feature_names() -> list[str]:
    """The 78 numeric features in a fixed order."""
    return ["season", "hour_sin", "hour_cos", "month_sin", "month_cos", "position_in_season", *(f"{side}_{x}" for side in ("home", "away") for x in side_features())]


#: What a row of `parts` says of a match: its ids, times and places; its ratings; the form of a side; the load of a side.
FIXED, RATED, FORM, LOAD = 0, 1, 2, 4
FIXED_NAMES = ("season", "hour_sin", "hour_cos", "month_sin", "month_cos", "position_in_season", "home_place", "away_place")
NO_DAY, FIRST_DAY, DAY_BITS = -(1 << 37), 1 << 38, 40


def _clipped(x: np.ndarray) -> np.ndarray:
    """clip01 of an array; like there, NaN counts as large."""
    return np.where(x <= 0, C.ALMOST_ZERO, np.where(x < 1, x, C.ALMOST_ONE))


def _numbers(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Columns as one matrix, with 0 for nulls, and which of it is not null."""
    return np.column_stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns]), np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


class LastMeans:
    """Means over the last n rows of the same team before each row, for rows that come in batches, a team's rows together."""

    def __init__(self, last: Sequence[int]) -> None:
        self.last, self.kept = last, None

    def __call__(self, team: np.ndarray, value: np.ndarray, is_known: np.ndarray) -> np.ndarray:
        """(row, column, n); NaN counts as a value, and without any the mean is -inf. Summed from the oldest on, like a window."""
        size = len(team)
        if self.kept is not None:
            team, value, is_known = (np.concatenate(x) for x in zip(self.kept, (team, value, is_known), strict=True))
        keep = max(self.last)
        self.kept = team[-keep:], value[-keep:], is_known[-keep:]
        out = np.empty((size, value.shape[1], len(self.last)))
        for i, n in enumerate(self.last):
            total, count = np.zeros(value.shape), np.zeros(value.shape, np.int64)
            for lag in range(n, 0, -1):
                use = is_known[:-lag] & (team[lag:] == team[:-lag])[:, None]
                total[lag:] += np.where(use, value[:-lag], 0.0)
                count[lag:] += use
            mean = np.where(count > 0, total / np.maximum(count, 1), -np.inf)
            out[:, :, i] = mean[len(mean) - size :]
        return out


class Load:
    """Rows of the same team before each row and at most so many days ago, for rows that come in batches, a team's rows in order of days.

    Kept from batch to batch: the last team, its rows so far, and for each of its last days the rows before that day.
    """

    def __init__(self, days: Sequence[int]) -> None:
        self.days, self.team, self.seen = days, None, 0
        self.keys = self.before = np.zeros(0, np.int64)

    def __call__(self, team: np.ndarray, day: np.ndarray) -> np.ndarray:
        first = np.concatenate([[self.team is None or team[0] != self.team], team[1:] != team[:-1]])
        number = np.cumsum(first)
        base = np.concatenate([[-self.seen], np.flatnonzero(first)])
        place = np.arange(len(team)) - base[number]
        key = (number << DAY_BITS) + day + FIRST_DAY
        opens = np.concatenate([[not len(self.keys) or key[0] != self.keys[-1]], key[1:] != key[:-1]])
        keys, before = np.concatenate([self.keys, key[opens]]), np.concatenate([self.before, place[opens]])
        got = np.column_stack([place - before[np.searchsorted(keys, key - n)] for n in self.days])
        self.team, self.seen = team[-1], place[-1] + 1
        near = keys >= key[-1] - max(self.days)
        self.keys, self.before = keys[near] - (number[-1] << DAY_BITS), before[near]
        return got


def _history(values: int, of_role: int, scales: Sequence[float], days: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (match_id, part, team_id, day, values) in a team's order to (match_id, part, values): scaled means of the values over LAST, those of the last of_role
    values over the matches in the same role, and the scaled load."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, by_role, load = LastMeans(LAST), [LastMeans(LAST), LastMeans(LAST)], Load(days)
        for batch in batches:
            if not batch.num_rows:
                continue
            team, part, got = batch["team_id"].to_numpy(zero_copy_only=False), batch["part"].to_numpy(), []
            if values:
                value, is_known = _numbers([batch[f"v{i}"] for i in range(values)])
                free = len(scales) - of_role
                mean = np.empty((len(team), len(scales), len(LAST)))
                mean[:, :free] = means(team, value[:, :free], is_known[:, :free])
                for side in (0, 1):
                    at = part % 2 == side
                    mean[at, free:] = by_role[side](team[at], value[at, -of_role:], is_known[at, -of_role:])
                got.append(_clipped(mean / np.asarray(scales)[:, None]).reshape(len(team), -1))
            if days:
                day = batch["day"].fill_null(NO_DAY).to_numpy(zero_copy_only=False)
                got.append(_clipped(load(team, day) / np.asarray(days, float) / C.SCALES["load"]))
            flat = np.column_stack(got)
            lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())
            yield pa.RecordBatch.from_arrays([batch["match_id"], batch["part"], lists], ["match_id", "part", "values"])

    return run


def history(team_rows: DataFrame, part: int, stats: bool, days: Sequence[int]) -> DataFrame:
    """(match_id, part, values) of each row of a team view: with stats (own_ and opp_ of SIDE_STATS) the rolling features of side_features(), then the load of each of
    days; part is that of a home row, the next number that of an away row."""
    values: list[Column] = []
    scales: list[str] = []
    if stats:
        values += [known(F.col(f"own_{x}")) for x in SIDE_STATS] + [known(F.col(f"own_{x}")) + known(F.col(f"opp_{x}")) for x in TOTAL_STATS]
        values += [points(F.col("gf"), F.col("ga")), F.col("gf"), F.col("ga")]
        scales = [*SIDE_STATS.values(), *TOTAL_STATS.values(), "points", "goals", "goals", "goals"]
    made = [v.cast("double").alias(f"v{i}") for i, v in enumerate(values)]
    day = F.datediff(F.col("dt").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day")
    side = F.when(F.col("role") == "home", part).otherwise(part + 1).cast("int").alias("part")
    # dealt out by a hash of its own, as in sequential.streamed, so that each team is whole in its task
    rows = team_rows.select("match_id", side, "team_id", day, "dt", F.coalesce("hour_utc", F.lit(-1)).alias("_hour"), *made).repartition(F.xxhash64("team_id"))
    ordered = rows.sortWithinPartitions("team_id", "dt", "_hour", "match_id").drop("dt", "_hour")
    schema = StructType([team_rows.schema["match_id"], StructField("part", IntegerType()), StructField("values", ArrayType(DoubleType()))])
    return ordered.mapInArrow(_history(len(values), 2, [C.SCALES[x] for x in scales], days), schema)


def _side_by_side(out: Sequence[str], load_apart: bool, digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of parts, a match's together, to one row for each match that has a FIXED part. Of several rows of a side the largest of each feature counts."""
    shown = [x for x in side_features() if x not in ("elo", "place")]
    columns = {FIXED: FIXED_NAMES, RATED: ("home_elo", "away_elo")}
    for i, side in enumerate(("home", "away")):
        names = [f"{side}_{x}" for x in shown]
        columns |= {FORM + i: names[: -len(LOAD_DAYS)], LOAD + i: names[-len(LOAD_DAYS) :]} if load_apart else {FORM + i: names}

    def joined(rows: pa.Table) -> pa.RecordBatch:
        match, part = rows["match_id"].to_numpy(), rows["part"].to_numpy()
        fixed = np.flatnonzero(part == FIXED)
        fixed = fixed[np.concatenate([[True], match[fixed][1:] != match[fixed][:-1]])] if len(fixed) else fixed
        ids, features = match[fixed], {}
        for number, names in columns.items():
            at = np.flatnonzero(part == number)
            starts = np.flatnonzero(np.concatenate([[True], match[at][1:] != match[at][:-1]])) if len(at) else at
            value = pc.list_flatten(rows["values"].take(pa.array(at))).to_numpy().reshape(len(at), len(names))
            if len(starts) < len(at):
                value = np.maximum.reduceat(value, starts, axis=0) if number >= FORM else value[starts]
            own = match[at][starts]
            if len(own) == len(ids) and (own == ids).all():
                got = value
            else:
                got = np.full((len(ids), len(names)), C.ALMOST_ZERO)
                to = np.searchsorted(ids, own)
                has = to < len(ids)
                has[has] = ids[to[has]] == own[has]
                got[to[has]] = value[has]
            features |= dict(zip(names, (got if digits is None else np.round(got, digits)).T, strict=True))
        kept = rows.take(pa.array(fixed))
        return pa.RecordBatch.from_arrays([pa.array(features[x], from_pandas=True) if x in features else kept[x].combine_chunks() for x in out], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            match = rows["match_id"].to_numpy()
            whole = int(np.argmax(match == match[-1]))  # the last match may go on in the next batch
            held = rows.slice(whole).combine_chunks()
            if whole:
                yield joined(rows.slice(0, whole))
        if held is not None:
            yield joined(held)

    return run


def match_features(
    matches: DataFrame, every_match: DataFrame | None = None, competitions: Sequence[str] = (), strengths: DataFrame | None = None, digits: int | None = None
) -> DataFrame:
    """One row a match: match_id, comp_id (place in competitions, else -1), home_id, away_id, feature_names() and, with strengths, both matrices.

    matches: the league matches, with home_ and away_ of SIDE_STATS; every_match: those that count for load (the same if not given);
    strengths(match_id, side, matrix): a team's matrix in a match, side 0 for home; digits: decimals to which features are rounded.
    """
    whole = matches.where("home_id is not null and away_id is not null")
    names = {x: (f"home_{x}", f"away_{x}") for x in SIDE_STATS}
    sides = form.team_matches(whole, {k: v[0] for k, v in names.items()}, {k: v[1] for k, v in names.items()})
    form_rows = [history(sides, FORM, True, LOAD_DAYS if every_match is None else ())]
    if every_match is not None:
        form_rows.append(history(form.team_matches(every_match.where("home_id is not null and away_id is not null")), LOAD, False, LOAD_DAYS))
    slot = [*league.LEAGUE, "dt", "hour"]
    by_slot = league.slot_places(sides).groupBy(*slot).agg(F.map_from_entries(F.collect_list(F.struct("team_id", "place01"))).alias("places"))
    by_slot = by_slot.join(league.season_dates(whole), [*league.LEAGUE])
    hour_sin, hour_cos = cyclic(F.coalesce("hour_utc", F.lit(0)), 24)
    month_sin, month_cos = cyclic(F.coalesce(F.month("dt"), F.lit(1)), 12, 1)
    comp = F.array_position(F.array(*[F.lit(x) for x in competitions]), F.coalesce("competition", F.lit(""))).cast("int") - 1 if competitions else F.lit(-1)
    position = clip01(F.coalesce(league.season_position(), F.lit(C.ALMOST_ZERO)))
    place = [F.coalesce(F.try_element_at("places", f"{side}_id"), F.lit(C.ALMOST_ZERO)) for side in ("home", "away")]
    asked = whole.select("match_id", "home_id", "away_id", *league.LEAGUE, "dt", "hour_utc", F.coalesce("hour_utc", F.lit(-1)).alias("hour"))
    fixed = asked.join(by_slot, slot, "left").select(
        "match_id", F.lit(FIXED).alias("part"), F.array(season01(F.col("season")), hour_sin, hour_cos, month_sin, month_cos, position, *place).alias("values"),
        comp.alias("comp_id"), "home_id", "away_id",
    )
    rated = elo_ratings(whole).select("match_id", F.lit(RATED).alias("part"), F.array(elo01(F.col("home_elo")), elo01(F.col("away_elo"))).alias("values"))
    parts = fixed
    for x in (rated, *form_rows):
        parts = parts.unionByName(x, allowMissingColumns=True)
    parts = parts.where("match_id is not null").repartition(F.xxhash64("match_id")).sortWithinPartitions("match_id", "part")
    kept = ["match_id", "comp_id", "home_id", "away_id"]
    out = StructType([*[StructField(x, parts.schema[x].dataType) for x in kept], *[StructField(x, DoubleType()) for x in feature_names()]])
    got = parts.mapInArrow(_side_by_side(out.names, every_match is not None, digits), out)
    if strengths is not None:
        for side, name in enumerate(("home", "away")):
            own = strengths.where(F.col("side") == side).select("match_id", F.col("matrix").alias(f"{name}_strength"))
            got = got.join(own, "match_id", "left")
    return got
