"""Entity resolution of teams and players by names within blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.scalars import name_key, plain_name
from touchline.functions.similarity import two_best


#: Most expected names of a block on either side, and the parts that a key's players are spread over.
PLAYER_BLOCK, RATED_BLOCK, SALTS = 1024, 4096, 32


def _named(*names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array(*names)))


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two best rated names in a block, for each player's names of a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            players, rated = batch["players"][i].as_py(), batch["rated"][i].as_py()
            ids, copies = (np.array([r[x] for r in rated], np.int64) for x in ("rated_id", "copies"))
            best, least, second = two_best(players, [r["names"] for r in rated], ids, copies)
            key = batch.column("block_key").take(pa.array([i] * len(players)))
            yield pa.RecordBatch.from_arrays([key, pa.array(players, pa.list_(pa.string())), pa.array(best), pa.array(least), pa.array(second)], ["block_key", "names", "best", "rated_id", "second"])


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """rows(block_key, …) with the number of a block of about `size` rows of their key."""
    sizes = rows.groupBy("block_key").agg(F.count("*").alias("_n"))
    return rows.join(sizes, "block_key").withColumn("block", F.pmod(F.xxhash64("names"), F.ceil(F.col("_n") / size))).drop("_n")


def best_names(players: DataFrame, rated: DataFrame) -> DataFrame:
    """players with the rated_id (smallest of ties), best and second score of the rated of the same block_key; players without any are left out.

    players(block_key, names, …), rated(block_key, rated_id, names); names are arrays, a score is the best ratio of any name with any other; second is -1 if there is
    one candidate. Equal names are compared once. A key's names meet in blocks, whose pairs are spread over tasks, so that no pair of names is a row.
    """
    spark = players.sparkSession
    asked = _blocked(players.where("block_key is not null").select("block_key", "names").distinct(), PLAYER_BLOCK)
    asked = asked.groupBy("block_key", "block").agg(F.collect_list("names").alias("players")).withColumn("salt", F.pmod("block", F.lit(SALTS))).drop("block")
    known = _blocked(rated.where("block_key is not null").groupBy("block_key", "names").agg(F.min("rated_id").alias("rated_id"), F.count("*").alias("copies")), RATED_BLOCK)
    known = known.groupBy("block_key", "block").agg(F.collect_list(F.struct("names", "rated_id", "copies")).alias("rated")).drop("block")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = asked.repartition(parts, "block_key", "salt").join(known.repartition(parts, "block_key", "salt"), ["block_key", "salt"]).select("block_key", "players", "rated")
    kind = players.schema["block_key"].dataType.simpleString()
    made = pairs.mapInArrow(_block_pairs, f"block_key {kind}, names array<string>, best double, rated_id long, second double")
    both = F.sort_array(F.flatten(F.collect_list(F.array("best", "second"))), asc=False)
    found = made.groupBy("block_key", "names").agg(F.max(F.struct("best", (-F.col("rated_id")).alias("least"))).alias("_top"), both.alias("_two"))
    found = found.select("block_key", "names", (-F.col("_top.least")).alias("rated_id"), F.col("_top.best").alias("best"), F.get("_two", F.lit(1)).alias("second"))
    return players.join(found, ["block_key", "names"])


def match_teams(teams: DataFrame, clubs: DataFrame, overrides: dict[int, int] | None = None) -> DataFrame:
    """(team_id, club_id, score): the most similar club of the team's league; overrides first; ties to the smaller club id; -1 without candidates.

    teams(team_id, name, league_id), clubs(club_id, name, league_id): a league's names meet in blocks.
    """
    named = _named(plain_name(F.col("name"))).alias("names")
    found = best_names(teams.select("team_id", F.col("league_id").alias("block_key"), named), clubs.select(F.col("club_id").alias("rated_id"), F.col("league_id").alias("block_key"), named))
    best = found.groupBy("team_id").agg(F.max_by(F.struct(F.col("rated_id").alias("club_id"), F.col("best").alias("score")), F.struct("best", -F.col("rated_id"))).alias("b"))
    fixed = F.create_map(*[F.lit(x) for pair in (overrides or {}).items() for x in pair]) if overrides else F.lit(None).cast("map<bigint,bigint>")
    own = F.try_element_at(fixed, F.col("team_id"))
    return teams.select("team_id").join(best, "team_id", "left").select("team_id", F.coalesce(own.cast("long"), F.col("b.club_id"), F.lit(-1)).alias("club_id"), F.col("b.score").alias("score"))


def _staged(players: DataFrame, rated: DataFrame) -> tuple[DataFrame, list[tuple[list[str], DataFrame]]]:
    """players(…, key, stage) with the first stage that has candidates, and for each stage its keys and the rated rows that it may give."""
    own = players.withColumn("key", name_key(plain_name(F.col("full_name"))))
    other = rated.withColumn("r_key", name_key(plain_name(F.col("r_full_name"))))
    stages = [(["club_id", "dob"], other), (["club_id"], other), (["dob"], other), (["key"], other)]
    stage = F.lit(None).cast("int")
    for k, (keys, _) in reversed(list(enumerate(stages))):
        known = other.select(*[F.col(f"r_{x}").alias(x) for x in keys]).distinct().withColumn(f"has_{k}", F.lit(True))
        own = own.join(known, keys, "left")
        stage = F.when(F.col(f"has_{k}"), k).otherwise(stage)
    return own.withColumn("stage", stage), stages


def candidates(players: DataFrame, rated: DataFrame) -> DataFrame:
    """(player_id, rated_id, stage): of the four stages the first that has candidates.

    players(player_id, name, full_name, dob, club_id), rated(rated_id, r_name, r_full_name, r_dob, r_club_id). A player's stage is found by joins with the
    distinct keys of rated; then each stage's players alone are joined with rated, by an equi-join. A name bucket gives all of its rows.
    """
    own, stages = _staged(players, rated)
    own = own.select("player_id", "club_id", "dob", "key", "stage")
    found = []
    for k, (keys, side) in enumerate(stages):
        pairs = side.select("rated_id", *[F.col(f"r_{x}").alias(x) for x in keys])
        found.append(own.where(F.col("stage") == k).join(pairs, keys).select("player_id", "rated_id", "stage"))
    return found[0].union(found[1]).union(found[2]).union(found[3])


def match_players(players: DataFrame, rated: DataFrame) -> DataFrame:
    """(player_id, rated_id or null, best, second, used_dob, reason): the best name of the first stage with candidates, if it is similar enough.

    A stage that fails its threshold does not fall through to the next; a single candidate has second -1; ties go to the smaller rated_id.
    A stage's candidates are all compared, those of a name bucket too.
    """
    own, stages = _staged(players, rated)
    blank = lambda keys, of: [(F.col(of(x)) if x in keys else F.lit(None).cast(own.schema[x].dataType)).alias(x) for x in ("club_id", "dob", "key")]
    part = F.lit(None)
    sides = []
    for k, (keys, side) in enumerate(stages):
        part = F.when(F.col("stage") == k, F.struct(F.col("stage").alias("stage"), *blank(keys, str))).otherwise(part)
        known = side.where(" and ".join(f"r_{x} is not null" for x in keys))
        sides.append(known.select(F.struct(F.lit(k).alias("stage"), *blank(keys, "r_{}".format)).alias("block_key"), "rated_id", _named(plain_name(F.col("r_name")), plain_name(F.col("r_full_name"))).alias("names")))
    asked = own.select("player_id", "stage", part.alias("block_key"), _named(plain_name(F.col("name")), plain_name(F.col("full_name"))).alias("names"))
    top = best_names(asked, sides[0].union(sides[1]).union(sides[2]).union(sides[3]))
    named = F.array(*[F.lit(x[0]) for x in C.MATCH_STAGES])
    least = F.array(*[F.lit(x[1]) for x in C.MATCH_STAGES])
    good = F.col("best") >= F.get(least, F.col("stage"))
    got = top.select(
        "player_id", F.when(good, F.col("rated_id")).alias("rated_id"), "best", "second", F.col("stage").isin(0, 2).alias("used_dob"),
        F.concat(F.get(named, F.col("stage")), F.when(good, "_pass").otherwise("_fail")).alias("reason"),
    )
    return players.select("player_id").join(got, "player_id", "left").withColumn("reason", F.coalesce("reason", F.lit("no_candidates")))


def club_rosters(rated: DataFrame, teams: DataFrame) -> DataFrame:
    """(team_id, rated_id): players one of whose two clubs is the team's, as one equi-join."""
    clubs = rated.select("rated_id", F.explode(F.array_distinct(F.array_compact(F.array("club_id", "club_2_id")))).alias("club_id"))
    return clubs.join(teams.select("team_id", "club_id"), "club_id").select("team_id", "rated_id").distinct()
