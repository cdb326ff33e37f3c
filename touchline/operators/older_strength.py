"""The older feed's team strength: players by birthday and name, nearest skills filled from further snapshots, imitated players, and its look-ups.

Everything is joins on ids, birthdays and seasons with array expressions inside a row; only name ratios and line-up matrices leave the JVM (Arrow batches).

Defined results: null names are empty; an empty line-up gives the imitated 4-4-2 as it is; a team without averages takes the fallback team's; repeated line-up rows count each; empty
tables give no rows.
"""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from touchline import config as C
from touchline.operators import legacy, ratings
from touchline.operators.resolve import best_names

#: The older feed's least similarity, days around a match within which snapshots count, and where imitated rows are put (from 0).
LEAST_SIMILARITY = 55.0
MOST_DAYS = 270
PLACES = {"Goalkeeper": 0, "Defender": 1, "Midfielder": 6, "Forward": 10}
EXPECTED = {"Defender": 4, "Midfielder": 4, "Forward": 2}
ROLES = {"Goalkeeper": "goalkeeper", "Defender": "defender", "Midfielder": "midfielder", "Forward": "attacker"}

#: Roles of the detailed positions.
POSITION_ROLES = {
    "GK": ("goalkeeper",), "CB": ("defender",), "LB": ("defender",), "RB": ("defender",), "RWB": ("defender",), "LWB": ("defender",), "CDM": ("midfielder", "defender"), "CM": ("midfielder",), "LM": ("midfielder",),
    "RM": ("midfielder",), "CAM": ("midfielder", "attacker"), "ST": ("attacker",), "CF": ("attacker",), "LW": ("attacker",), "RW": ("attacker",),
}


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode())


def ascii_name(name: Column) -> Column:
    """Lower-case letters and digits of a name, accents taken off, single spaces between words."""
    kept = F.regexp_replace(F.lower(_decomposed(name)), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


@lru_cache(maxsize=1 << 16)
def block_ratio(a: str, b: str) -> float:
    """Twice the matching blocks over both lengths."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _block_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([block_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def match_feed_teams(teams: DataFrame, known: DataFrame) -> DataFrame:
    """(team_id, known_id, score): the known team of the same competition and season whose name shares most; ties to the smaller id, null where nothing is shared.

    teams(team_id, name, competition, season), known(known_id, known_name, competition, season).
    """
    pairs = teams.join(known, ["competition", "season"]).withColumn("score", _block_ratios(ascii_name(F.col("name")), ascii_name(F.col("known_name")))).where("score > 0")
    best = pairs.groupBy("team_id", "competition", "season").agg(F.max_by(F.struct("known_id", "score"), F.struct("score", -F.col("known_id"))).alias("b"))
    keys = ["team_id", "competition", "season"]
    return teams.select(*keys).distinct().join(best, keys, "left").select(*keys, F.col("b.known_id").alias("known_id"), F.col("b.score").alias("score"))


def match_by_birthday(players: DataFrame, rated: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(player_id, rated_id, score, reason): of the rated players born the same day the one whose name is most alike; matched, rejected (below least) or no_birthday.

    players(player_id, name, full_name, dob), rated(rated_id, r_name, r_full_name, dob); ties to the smaller id.
    """
    names = lambda *columns: F.array_sort(F.array_distinct(F.array(*[ascii_name(F.col(c)) for c in columns]))).alias("names")
    asked = players.select("player_id", F.col("dob").alias("block_key"), names("name", "full_name"))
    pairs = best_names(asked, rated.select(F.col("dob").alias("block_key"), "rated_id", names("r_name", "r_full_name")))
    best = pairs.groupBy("player_id").agg(F.max_by(F.struct("rated_id", F.col("best").alias("score")), F.struct("best", -F.col("rated_id"))).alias("b"))
    found = players.select("player_id").distinct().join(best, "player_id", "left")
    reason = F.when(F.col("b").isNull(), "no_birthday").when(F.col("b.score") < least, "rejected").otherwise("matched")
    return found.select("player_id", F.when(reason == "matched", F.col("b.rated_id")).alias("rated_id"), F.col("b.score").alias("score"), reason.alias("reason"))


def role_set(positions: Column) -> Column:
    """The roles of an array of detailed positions, goalkeeper to attacker; an unknown position is an error."""
    known = F.create_map(*[x for p, roles in POSITION_ROLES.items() for x in (F.lit(p), F.array(*map(F.lit, roles)))])
    each = F.transform(positions, lambda p: F.coalesce(F.try_element_at(known, p), F.raise_error(F.concat(F.lit("unknown position "), F.coalesce(p, F.lit("null")))).cast("array<string>")))
    found = F.flatten(each)
    return F.filter(F.array(*[F.lit(r) for r in ROLES.values()]), lambda r: F.array_contains(found, r))


def wide_averages(averages: DataFrame) -> DataFrame:
    """(season, team_id) with the averages of the four roles as columns; an all-zero goalkeeper is the overall one."""
    overall = averages.where("season = -1 and team_id = -1 and role = 'goalkeeper'").agg(F.first("skills").alias("_any"))
    wide = averages.where("season <> -1").groupBy("season", "team_id").agg(*[F.first(F.when(F.col("role") == r, F.col("skills")), ignorenulls=True).alias(r) for r in ROLES.values()])
    keeper = F.when(F.forall("goalkeeper", lambda x: x == 0), F.col("_any")).otherwise(F.col("goalkeeper"))
    return wide.join(overall).withColumn("goalkeeper", keeper).drop("_any")


def with_averages(rows: DataFrame, averages: DataFrame) -> DataFrame:
    """rows(season, team_id, …) with the four roles' averages, the fallback team's where the team has none (one row of it is joined)."""
    wide = wide_averages(averages)
    spare = wide.where((F.col("season") == legacy.FALLBACK[0]) & (F.col("team_id") == legacy.FALLBACK[1])).agg(*[F.first(r).alias(f"_{r}") for r in ROLES.values()])
    got = rows.join(wide, ["season", "team_id"], "left").join(spare)
    return got.select(*rows.columns, *[F.coalesce(r, f"_{r}").alias(r) for r in ROLES.values()])


def _role(position: Column) -> Column:
    """The average of a line-up position's role; another position is an error."""
    out = F.raise_error(F.concat(F.lit("no role for position "), F.coalesce(position, F.lit("null")))).cast("array<double>")
    for name, role in ROLES.items():
        out = F.when(position == name, F.col(role)).otherwise(out)
    return out


def nearest_skills(lookups: DataFrame, snapshots: DataFrame, averages: DataFrame, key: list[str], width: int = C.SKILLS, days: int = MOST_DAYS) -> DataFrame:
    """lookups with skills, and how they came about: from the snapshots less than `days` days off, nearest first (of two the earlier), each skill from the first that has it.

    Skills that none has are the team's average of the role that most of these snapshots' positions have (of equal ones the first); without
    snapshots the average of the line-up position. lookups(key…, player_id, day, season, team_id, position), snapshots(player_id, snap_date, skills, positions).
    """
    pairs = ratings._candidates(lookups.select(*key, "player_id", "day"), snapshots, days - 1, days - 1)
    near = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.abs("age").alias("off"), "snap_date", "skills", role_set(F.col("positions")).alias("roles")))).alias("near"))
    rows = with_averages(lookups.join(near, key, "left"), averages)
    roles = F.flatten(F.transform("near", lambda s: s["roles"]))
    counts = F.transform(roles, lambda r, i: F.struct(F.size(F.filter(roles, lambda x: x == r)).alias("n"), (-i).alias("first"), r.alias("role")))
    likely = F.array_max(counts)["role"]
    average = F.lit(None).cast("array<double>")
    for role in ROLES.values():
        average = F.when(likely == role, F.col(role)).otherwise(average)
    rows = rows.withColumn("_average", average)
    known = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(F.filter(F.transform("near", lambda s: F.coalesce(F.get(s["skills"], i), F.lit(C.MISSING)).cast("double")), lambda x: x != C.MISSING), F.lit(0)))
    rows = rows.withColumn("_known", known)
    filled = F.zip_with("_known", "_average", lambda a, b: F.coalesce(a, b))
    n_filled = F.size(F.filter("_known", lambda x: x.isNull()))
    none = F.col("near").isNull()
    return rows.select(*lookups.columns, F.when(none, _role(F.col("position"))).otherwise(filled).alias("skills"), F.when(none, "imitated").when(n_filled > 0, "filled").otherwise("observed").alias("source"), F.when(none, 0).otherwise(n_filled).alias("filled_skills"))


class SkillRows:
    """Rows of skills as one matrix, short rows padded with zeros: which have a null, and how far each looks like a goalkeeper's (NaN where that is null)."""

    def __init__(self, rows: pa.ListArray) -> None:
        self.rows = rows
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        self.cells = np.zeros((len(rows), max(33, int(lengths.max(initial=0)))))
        inside = np.arange(self.cells.shape[1]) < lengths[:, None]
        values = rows.flatten()
        self.cells[inside] = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
        gone = np.zeros(self.cells.shape, bool)
        gone[inside] = values.is_null().to_numpy(zero_copy_only=False)
        gone[rows.is_null().to_numpy(zero_copy_only=False)] = True
        self.null = gone.any(1)
        sums = [np.zeros(len(rows)), np.zeros(len(rows))]  # one skill after another, so that sums are those of a loop
        for i in range(33):
            sums[i >= 29] += self.cells[:, i]
        keeper = sums[1] / 4 - sums[0] / 29
        known = ~gone[:, :33].any(1)
        self.clumsy, self.keeping = known & (keeper < 0), known & ((keeper > 0) | np.isnan(keeper))


def _placed(batch: pa.RecordBatch, own: np.ndarray, roles: np.ndarray, table: SkillRows, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line-up the numbers of its matrix's rows in the table (-1 beyond its end), how many rows it has, and how many players have skills.

    own: the row of each player (-1: no skills), line-up after line-up; roles: the rows of each line-up's averages, goalkeeper to attacker.
    """
    n, names = len(batch), list(PLACES)
    players = batch["players"]
    lengths = pc.fill_null(pc.list_value_length(players), 0).to_numpy(zero_copy_only=False)
    if (lengths > size).any():
        raise ValueError("a line-up has too many players")
    rank = pc.fill_null(pc.index_in(pc.struct_field(players.flatten(), "position"), pa.array(names)), len(names)).to_numpy(zero_copy_only=False)
    seen = np.nonzero(own >= 0)[0]
    line = np.repeat(np.arange(n), lengths)[seen]
    seen = seen[np.argsort(line * 8 + rank[seen], kind="stable")]
    count = np.bincount(line, minlength=n)
    first = np.cumsum(count) - count
    blank = roles[:, [names.index(x) for x in ("Goalkeeper", *["Defender"] * 4, *["Midfielder"] * 4, *["Forward"] * 2)]]
    place = np.arange(max(size, blank.shape[1]))
    at = np.full((n, len(place)), -1)
    at[line, np.arange(len(line)) - first[line]] = own[seen]
    have = np.bincount(line * 8 + rank[seen], minlength=n * 8).reshape(n, 8)[:, : len(names)]
    over = have - [EXPECTED.get(x, 0) for x in names]
    over[have[:, 0] > 0, 0] = size + 1  # behind all others, and in no turn
    order = np.argsort(over * len(names) + np.arange(len(names)), axis=1)
    turns = len(names) - (have[:, 0] > 0)
    spot = np.array(list(PLACES.values()))
    grown = count.copy()
    for step in range(size):  # in turns of those that a 4-4-2 lacks most, equal ones in line-up order; no goalkeeper if there is one
        some = np.nonzero((grown < size) & (lengths > 0))[0]
        if not len(some):
            break
        name = order[some, step % turns[some]]
        put = np.minimum(spot[name], grown[some])
        moved = np.take_along_axis(at[some], np.maximum(place - (place > put[:, None]), 0), 1)
        moved[np.arange(len(some)), put] = roles[some, name]
        at[some] = moved
        grown[some] += 1
    spare = np.full_like(at, -1)
    spare[:, : blank.shape[1]] = blank
    wrong = np.where(place == 0, table.clumsy[at], table.keeping[at]) & (at >= 0)
    at = np.where(wrong | (lengths == 0)[:, None], spare, at)
    return at, np.where(lengths == 0, blank.shape[1], size), count


def _matrices(at: np.ndarray, height: np.ndarray, table: SkillRows) -> list[pa.Array]:
    """The matrices themselves."""
    inside = np.arange(at.shape[1]) < height[:, None]
    rows = table.rows.take(pa.array(np.where(at < 0, None, at)[inside], pa.int64()) if (at[inside] < 0).any() else pa.array(at[inside]))
    return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(height)]), pa.int32()), rows)]


#: What is made of a batch's matrices: columns from the rows' numbers, the numbers of rows and the table, and their schema.
Made = tuple[Callable[[np.ndarray, np.ndarray, SkillRows], list[pa.Array]], str]
WHOLE: Made = (_matrices, "matrix array<array<double>>")
AT_ONCE = 2048


def totals(at: np.ndarray, height: np.ndarray, table: SkillRows) -> list[pa.Array]:
    """The number of rows of each matrix, the sum of its first row and of all rows; a null in them gives null."""
    cells, null = table.cells[at], table.null[at]
    if (beyond := at < 0).any():
        cells[beyond], null[beyond] = 0.0, False
    return [pa.array(height, pa.int32()), pa.array(cells[:, 0].sum(1), mask=null[:, 0]), pa.array(cells.sum((1, 2)), mask=null.any(1))]


TOTALS: Made = (totals, "n_rows int, first_row double, total double")


def _columns(batch: pa.RecordBatch, own: np.ndarray, roles: np.ndarray, table: SkillRows, size: int, made: Made) -> list[pa.Array]:
    at, height, count = _placed(batch, own, roles, table, size)
    gone = batch["players"].is_null()
    out = [*made[0](at, height, table), pa.array(size - count, pa.int32())]
    return [batch["match_id"], batch["side"], *[pc.if_else(gone, pa.scalar(None, x.type), x) if gone.true_count else x for x in out]]


def _made(rows: DataFrame, run: Callable[[pa.RecordBatch], list[pa.Array]], made: Made) -> DataFrame:
    """run over a few line-ups of rows at once."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("match_id", "side"))
    schema = f"{kinds}, {made[1]}, imitated int"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), AT_ONCE):
                yield pa.RecordBatch.from_arrays(run(pa.RecordBatch.from_arrays([pa.concat_arrays([x.slice(a, AT_ONCE)]) for x in batch.columns], batch.schema.names)), names)

    return rows.mapInArrow(each, schema)


def lineup_matrix(lineups: DataFrame, averages: DataFrame, size: int = C.PLAYERS, made: Made = WHOLE) -> DataFrame:
    """(match_id, side, matrix, imitated): of lineups(match_id, side, season, team_id, players array<struct(position, skills)>) the rows in line-up order, completed and balanced.

    Players without skills are left out and imitated; an empty line-up is the 4-4-2 of averages, unbalanced; more than `size` players are an error.
    Rows stay numbers of rows until all are placed. made: what is given of a matrix in place of itself.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        skills = pc.struct_field(batch["players"].flatten(), "skills")
        own = np.where(skills.is_null().to_numpy(zero_copy_only=False), -1, np.arange(len(skills)))
        table = SkillRows(pa.concat_arrays([skills, *[batch[r] for r in ROLES.values()]]))
        roles = len(skills) + np.arange(len(ROLES) * len(batch)).reshape(len(ROLES), -1).T
        return _columns(batch, own, roles, table, size, made)

    return _made(with_averages(lineups, averages), run, made)


#: Most rows of skills and averages that go to each worker as they are (some 35 MB).
SHIPPED = 1 << 17


def lineup_matrix_by_player(lineups: DataFrame, skills: DataFrame, averages: DataFrame, size: int = C.PLAYERS, made: Made = WHOLE) -> DataFrame:
    """`lineup_matrix` of lineups(…, players array<struct(position, player_id)>) with skills(player_id, skills), one row a player; both tables are read more than once.

    Tables of up to SHIPPED rows go to the workers, so that no line-up carries skills; with larger ones each line-up is given its players' skills by a join.
    """
    wide = wide_averages(averages)
    if skills.count() + len(ROLES) * wide.count() > SHIPPED:
        players = lineups.select("match_id", "side", "season", "team_id", F.posexplode_outer("players").alias("_i", "_p"), F.col("players").isNull().alias("_gone"))
        listed = players.select("*", F.col("_p.player_id").alias("player_id")).join(skills, "player_id", "left")
        own = F.when(F.col("_i").isNotNull(), F.struct("_i", F.struct(F.col("_p.position").alias("position"), "skills").alias("p")))
        found = listed.groupBy("match_id", "side", "season", "team_id", "_gone").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["p"]).alias("players"))
        return lineup_matrix(found.withColumn("players", F.when(~F.col("_gone"), F.col("players"))), averages, size, made)
    wide = wide.where("team_id is not null")
    held, teams = skills.toArrow(), wide.toArrow()
    parts = [x.combine_chunks().cast(pa.list_(pa.float64())) for x in (held["skills"], *[teams[r] for r in ROLES.values()])]
    table = SkillRows(pa.concat_arrays([*parts, pa.array([None], pa.list_(pa.float64()))]))
    ids, seasons, clubs = (x.to_numpy() for x in (held["player_id"], teams["season"], teams["team_id"]))
    lacks = table.rows.is_null().to_numpy(zero_copy_only=False)
    found = len(ids) + np.arange(len(ROLES) * len(clubs)).reshape(len(ROLES), -1)
    common = found[:, (seasons == legacy.FALLBACK[0]) & (clubs == legacy.FALLBACK[1])] if len(clubs) else found
    common = common if common.shape[1] else np.full((len(ROLES), 1), len(lacks) - 1)
    of_team = np.concatenate([np.where(lacks[found], common, found), common], axis=1).T  # the fallback team's, where a team lacks a role; last those of other teams
    places, teams_at = pd.Index(ids), pd.MultiIndex.from_arrays([seasons, clubs])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        asked = pc.struct_field(batch["players"].flatten(), "player_id")
        known = asked.is_valid().to_numpy(zero_copy_only=False)
        own = np.where(known, places.get_indexer(pc.fill_null(asked, 0).to_numpy(zero_copy_only=False)), -1)
        own = np.where(lacks[own], -1, own)
        key = [pc.fill_null(batch[c], -1).to_numpy(zero_copy_only=False) for c in ("season", "team_id")]
        whole = batch["season"].is_valid().to_numpy(zero_copy_only=False) & batch["team_id"].is_valid().to_numpy(zero_copy_only=False)
        roles = of_team[np.where(whole, teams_at.get_indexer(pd.MultiIndex.from_arrays(key)), -1)]
        return _columns(batch, own, roles, table, size, made)

    return _made(lineups, run, made)


def round_of(asked: DataFrame, rounds: DataFrame) -> DataFrame:
    """asked(…, competition, season, name) with round_id of rounds(competition, season, round_name, round_id): by the name, else by the name without ` - n` after Round."""
    short = F.nullif(F.regexp_extract("name", r"(?i)^(.+?\bRound)\s*[–—-]\s*\d+$", 1), F.lit(""))
    own = rounds.groupBy("competition", "season", "round_name").agg(F.min("round_id").alias("round_id"))
    keyed = asked.withColumn("_short", short)
    for column, key in (("_a", "name"), ("_b", "_short")):
        keyed = keyed.join(own.withColumnRenamed("round_name", key).withColumnRenamed("round_id", column), ["competition", "season", key], "left")
    return keyed.select(*[c for c in asked.columns], F.coalesce("_a", "_b").alias("round_id"))


def season_ids(asked: DataFrame, leagues: DataFrame, current: int) -> DataFrame:
    """asked(…, country, league, season) with season_id of leagues(country, league, years array<struct(id, year)>), whose years are 2021 or 20212022; exactly one must fit, or none in the current season."""
    listed = leagues.select("country", "league", F.explode("years").alias("y")).select("country", "league", F.col("y.id").alias("id"), F.substring(F.col("y.year").cast("string"), 1, 4).cast("long").alias("season"), F.col("y.year").cast("string").alias("year"))
    fits = listed.where((F.length("year") == 4) | (F.col("year") == F.concat(F.col("season").cast("string"), (F.col("season") + 1).cast("string"))))
    one = fits.groupBy("country", "league", "season").agg(F.count("*").alias("_n"), F.first("id").alias("_id"))
    ok = F.when(F.col("_n") == 1, F.col("_id")).when(F.col("_n").isNull() & (F.col("season") == current), F.lit(None).cast("long")).otherwise(F.raise_error(F.lit("not exactly one season fits")).cast("long"))
    return asked.join(one, ["country", "league", "season"], "left").select(*asked.columns, ok.alias("season_id"))


def regular_teams(matches: DataFrame) -> DataFrame:
    """(competition, season, team_id) of teams with a regular match in it, of matches(…, regular)."""
    sides = matches.where("regular").select("competition", "season", F.explode(F.array("home_id", "away_id")).alias("team_id"))
    return sides.where("team_id is not null").distinct()


def regular_only(table: DataFrame, regular: DataFrame) -> DataFrame:
    """A league table without teams that never played a regular match there, placed anew by points, goal difference, goals and id."""
    kept = table.join(regular, ["competition", "season", "team_id"], "left_semi")
    order = [F.desc("mean_points"), F.desc(F.col("gf") - F.col("ga")), F.desc("gf"), F.asc("team_id")]
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("competition", "season").orderBy(*order)).cast("long"))
