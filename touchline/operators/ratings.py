"""As-of lookups of dated skill snapshots, line-ups, team strength and imputation.

Snapshots are joined to lookups by player and a bucket of days, so that the join is an equi-join on (player, bucket) however long a player's
history is; ages are filtered after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.lineage import written
from touchline.functions.scalars import goalkeeper_score, observed_skill, position_index, position_rank

PROVENANCE = {0: "unresolved", 1: "nearest", 2: "older", 3: "competition_position", 4: "position", 5: "global", 6: "neutral"}


def _candidates(lookups: DataFrame, snapshots: DataFrame, back: int, ahead: int) -> DataFrame:
    """Pairs of lookups(…, player_id, day) and snapshots(player_id, snap_date, …) with -ahead <= age <= back days."""
    width = max(back + ahead, 1)
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    asked = lookups.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((number - back) / width), F.floor((number + ahead) / width)))))
    dated = snapshots.withColumn("_b", F.floor(F.datediff(F.col("snap_date"), F.lit("1970-01-01").cast("date")) / width))
    pairs = asked.join(dated, ["player_id", "_b"]).drop("_b").withColumn("age", F.datediff("day", "snap_date"))
    return pairs.where((F.col("age") <= back) & (F.col("age") >= -ahead))


def _nearest(lookups: DataFrame, snapshots: DataFrame, key: list[str], back: int, ahead: int, order: list[Column], most: int) -> DataFrame:
    """lookups with their nearest snapshots by order, numbered by date. Numbers depend on player and day alone (and on those of key's columns that snapshots have), so
    they are found for distinct days of a player, and lookups join what was found."""
    own = ["player_id", "day", *[k for k in key if k in snapshots.columns and k not in ("player_id", "day")]]
    pairs = _candidates(lookups.select("player_id", "day").distinct(), snapshots, back, ahead)
    near = pairs.withColumn("nth", F.dense_rank().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("nth") <= most)
    return lookups.join(written(near, "nearest"), ["player_id", "day"])


def past_snapshots(lookups: DataFrame, snapshots: DataFrame, key: list[str], days: int = C.MAX_AGE_DAYS, most: int = C.MAX_SNAPSHOTS) -> DataFrame:
    """The nearest `most` snapshots, each date once, on or before the day and at most `days` old; nth from 1. key names a lookup."""
    return _nearest(lookups, snapshots, key, days, 0, [F.col("age")], most)


def past_then_future_snapshots(lookups: DataFrame, snapshots: DataFrame, key: list[str], days: int = C.MAX_AGE_DAYS, most: int = C.MAX_SNAPSHOTS) -> DataFrame:
    """Snapshots within `days` on either side: past ones first, nearest first, then future ones, nearest first."""
    return _nearest(lookups, snapshots, key, days, days, [F.col("age") < 0, F.abs("age")], most)


def filled_skills(candidates: DataFrame, key: list[str], skill: str = "skill") -> DataFrame:
    """The first observed value in nth order for each key, its date, age and provenance (1: from the nearest contributing snapshot, 2: older).

    key ends with the skill's number where there are several; "nearest contributing" is decided over the key without it.
    """
    seen = candidates.where(observed_skill(F.col(skill)).isNotNull())
    best = seen.groupBy(*key).agg(F.min_by(F.struct(F.col(skill).cast("double").alias("value"), "snap_date", "age", "nth"), "nth").alias("b"))
    outer = [k for k in key if k != "skill_no"]
    first = F.min("b.nth").over(Window.partitionBy(*outer))
    return best.withColumn("first", first).select(*key, "b.value", "b.snap_date", "b.age", F.when(F.col("b.nth") == F.col("first"), 1).otherwise(2).alias("provenance"))


def filled_lookups(lookups: DataFrame, snapshots: DataFrame, days: int = C.MAX_AGE_DAYS, most: int = C.MAX_SNAPSHOTS) -> DataFrame:
    """lookups(…, player_id, day) with value, snap_date, age and provenance of `filled_skills` over their past snapshots, found once for each distinct day of a player."""
    key = ["player_id", "day"]
    near = past_snapshots(lookups.select(*key).distinct(), snapshots, key, days, most)
    return lookups.join(written(filled_skills(near, [*key, "skill_no"] if "skill_no" in snapshots.columns else key), "filled"), key)


def skill_rows(snapshots: DataFrame) -> DataFrame:
    """snapshots(player_id, snap_date, skills array) as one row for each skill; of several rows of a player and date the last (line) wins."""
    once = snapshots.groupBy("player_id", "snap_date").agg(F.max_by("skills", "line").alias("skills"))
    return once.select("player_id", "snap_date", F.posexplode("skills").alias("skill_no", "skill"))


def adjacent_missing(skills: DataFrame) -> DataFrame:
    """(player_id, skill_no) rows missing in two adjacent snapshot dates of the whole archive; dates, not players, are numbered."""
    dates = skills.select("snap_date").distinct().withColumn("snap", F.row_number().over(Window.orderBy("snap_date")))
    rows = skills.join(dates, "snap_date").withColumn("missing", observed_skill(F.col("skill")).isNull())
    before = rows.select("player_id", "skill_no", (F.col("snap") + 1).alias("snap"), F.col("missing").alias("missing_before"))
    return rows.join(before, ["player_id", "skill_no", "snap"]).where("missing and missing_before")


def ordered_lineup(lineup: Column, size: int = C.PLAYERS) -> Column:
    """array<struct(player_id, position)> in position order (stable): a missing goalkeeper is put first, then padded, then cut to size."""
    marked = F.transform(lineup, lambda p, i: F.struct(position_rank(p["position"]).alias("rank"), i.alias("ord"), p["player_id"].alias("player_id"), p["position"].alias("position")))
    rows = F.transform(F.array_sort(marked), lambda p: F.struct(p["player_id"].alias("player_id"), p["position"].alias("position"), position_index(p["position"]).alias("index")))
    keeper = F.array(F.struct(F.lit(None).cast("long").alias("player_id"), F.lit("Goalkeeper").alias("position"), F.lit(0).alias("index")))
    blank = F.array_repeat(F.struct(F.lit(None).cast("long").alias("player_id"), F.lit("Unknown").alias("position"), F.lit(len(C.POSITIONS)).alias("index")), size)
    full = F.when(F.exists(rows, lambda p: p["position"] == "Goalkeeper"), rows).otherwise(F.concat(keeper, rows))
    return F.slice(F.concat(full, blank), 1, size)


def goalkeeper_first(rows: Column, width: int = C.SKILLS, least: float = 0.5) -> Column:
    """array<struct(position, skills)> with one goalkeeper row in front: the labelled one, else the best scoring of at least `least`, else a missing row."""
    scored = F.transform(rows, lambda r, i: F.struct(F.coalesce(goalkeeper_score(r["skills"]), F.lit(float("-inf"))).alias("score"), (-i).alias("ord")))
    best = F.array_max(scored)
    labelled = F.array_position(F.transform(rows, lambda r: r["position"]), "Goalkeeper").cast("int")
    at = F.when(labelled > 0, labelled).when(best["score"] >= least, 1 - best["ord"])
    missing = F.array(F.struct(F.lit("Goalkeeper").alias("position"), F.array_repeat(F.lit(C.MISSING), width).alias("skills")))
    moved = F.concat(F.slice(rows, at, 1), F.slice(rows, 1, at - 1), F.slice(rows, at + 1, F.size(rows)))
    return F.when(at.isNull(), F.concat(missing, rows)).otherwise(moved)


def lineup_overlap(lineups: DataFrame) -> DataFrame:
    """For lineups(match_id, side 0/1, slot, player_id): sizes, players named twice on a side and players on both sides."""
    lists = lineups.groupBy("match_id").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("player_id"))).alias("home"), F.collect_list(F.when(F.col("side") == 1, F.col("player_id"))).alias("away")
    )
    twice = lambda x: F.size(x) - F.size(F.array_distinct(x))
    return lists.select("match_id", F.size("home").alias("home_size"), F.size("away").alias("away_size"), twice("home").alias("home_twice"), twice("away").alias("away_twice"), F.size(F.array_intersect("home", "away")).alias("on_both"))


def team_strength(lineups: DataFrame, player_map: DataFrame, skills: DataFrame, size: int = C.PLAYERS) -> DataFrame:
    """(match_id, side, matrix): each side's rows in slot order with their filled skills, missing ones -1, padded to size rows of SKILLS.

    lineups(match_id, side, slot, day, player_id as listed), player_map(listed_id, player_id), skills as of skill_rows().
    """
    listed = lineups.withColumnRenamed("player_id", "listed_id").where(F.col("slot") < size)
    asked = listed.join(player_map.where("player_id > 0"), "listed_id").select("match_id", "side", "slot", "player_id", "day")
    key = ["match_id", "side", "slot"]
    filled = filled_skills(past_snapshots(asked, skills, [*key, "skill_no"]), [*key, "skill_no"])
    rows = filled.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("skill_no", "value"))).alias("by_no"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(C.SKILLS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("by_no"), i), F.lit(C.MISSING)))
    sides = rows.groupBy("match_id", "side").agg(F.map_from_entries(F.collect_list(F.struct("slot", vector.alias("v")))).alias("by_slot"))
    blank = F.array_repeat(F.lit(C.MISSING), C.SKILLS)
    every = lineups.select("match_id", "side").distinct().join(sides, ["match_id", "side"], "left")
    matrix = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(F.col("by_slot"), i.cast("long")), blank))
    return every.select("match_id", "side", matrix.alias("matrix"))


def skill_medians(cells: DataFrame, config: C.Imputation = C.Imputation()) -> dict[str, DataFrame]:
    """Medians of observed training cells(fold, competition, position, skill_no, value) by level, where the support suffices."""
    seen = cells.where("value >= 0")
    levels = {"competition_position": (["competition", "position"], config.competition_support), "position": (["position"], config.position_support), "global": ([], config.global_support)}
    return {
        name: seen.groupBy("fold", *keys, "skill_no").agg(F.count("*").alias("support"), F.median("value").alias("median")).where(F.col("support") >= least)
        for name, (keys, least) in levels.items()
    }


def imputed(cells: DataFrame, medians: dict[str, DataFrame], neutral: float = C.NEUTRAL_SKILL) -> DataFrame:
    """cells with value filled level by level, observed (1 or 0) and provenance (3 to 6 where filled)."""
    keys = {"competition_position": ["fold", "competition", "position", "skill_no"], "position": ["fold", "position", "skill_no"], "global": ["fold", "skill_no"]}
    out = cells
    for i, (name, on) in enumerate(keys.items()):
        out = out.join(medians[name].select(*on, F.col("median").alias(f"_m{i}")), on, "left")
    seen = F.col("value") >= 0
    code = F.when(seen, F.col("provenance")).when(F.col("_m0").isNotNull(), 3).when(F.col("_m1").isNotNull(), 4).when(F.col("_m2").isNotNull(), 5).otherwise(6)
    value = F.when(seen, F.col("value")).otherwise(F.coalesce("_m0", "_m1", "_m2", F.lit(neutral)))
    return out.withColumn("provenance", code).withColumn("observed", F.coalesce(seen.cast("int"), F.lit(0))).withColumn("value", value).drop("_m0", "_m1", "_m2")
