"""The older feed: fixtures, statistics and line-ups from JSON records, its wide skill files, its record files and its text logs.

Records are tables of one JSON text a row; rules are columns, look-ups joins. What is refused comes with the first rule that refuses it.

Defined results: records that are no JSON objects or lack an id are refused; fixtures already stored and repeated ones are passed over without a word; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.scalars import flexible_date
from touchline.operators import legacy, older_strength
from touchline.sources import ingest

#: Statuses of played matches and what the others mean, and the code of a draw.
PLAYED = ("FT", "AET", "PEN")
STATUSES = {"canceled": ("Canc", "CANC"), "postponed": ("PST",), "not_started": ("NS",), "not_scheduled": ("TBD",), "abandoned": ("ABD",), "technical_loss": ("AWD",), "walkover": ("WO",), "in_play": ("1H", "HT", "2H", "ET", "BT", "P", "SUSP", "INT", "LIVE")}
DRAW = -1
#: The feed's names of statistics, ours, and whether they are percentages.
STATS = {
    "shots_on_target": ("Shots on Goal", False), "shots": ("Total Shots", False), "shots_inside_box": ("Shots insidebox", False), "corners": ("Corner Kicks", False), "possession": ("Ball Possession", True), "passes_accurate": ("Passes %", True),
}
FIXTURE = (
    "fixture struct<id: long, date: string, status: struct<short: string>>, league struct<id: long, name: string, country: string, season: long, round: string>, "
    "teams struct<home: struct<id: long, winner: boolean>, away: struct<id: long, winner: boolean>>, score struct<fulltime: struct<home: long, away: long>>"
)
STATISTICS = "response array<struct<statistics: array<struct<type: string, value: string>>>>"
LINEUPS = "response array<struct<startXI: array<struct<player: struct<id: long, name: string, pos: string>>>>>"
MOST_MISSING = 5
REALIGNED_AT = 24


def fetch_from(comps: DataFrame, seasons: list[int], stored: DataFrame, first_day: str) -> DataFrame:
    """(comp_id, season, day): from which day on fixtures are to be fetched: the last stored one's, else first_day."""
    wanted = comps.select("comp_id", F.explode(F.array(*[F.lit(s).cast("long") for s in seasons])).alias("season"))
    last = stored.groupBy("comp_id", "season").agg(F.max("ts").alias("last"))
    return wanted.join(last, ["comp_id", "season"], "left").select("comp_id", "season", F.coalesce(F.date_format("last", "yyyy-MM-dd"), F.lit(first_day)).alias("day"))


def fixtures(records: DataFrame, comps: DataFrame, rounds: DataFrame, teams: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New played matches and refused records. records(comp_id, season, record: as asked for), comps(comp_id, name), rounds(competition, season, round_name, round_id), teams(team_id)."""
    rows = ingest.parsed(records.select(F.col("comp_id").alias("asked_id"), F.col("season").alias("asked_season"), "record"), FIXTURE)
    rows = rows.select("asked_id", "asked_season", F.col("fixture.id").alias("id"), F.col("fixture.date").alias("date"), F.col("fixture.status.short").alias("status"), "league", "teams", F.col("score.fulltime").alias("goals"))
    if stored is not None:
        rows = rows.join(stored.select(F.col("match_id").alias("id")), "id", "left_anti")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("date"))).where("id is null or _n = 1").drop("_n")
    rows = rows.join(comps.select(F.col("comp_id").alias("asked_id"), F.col("name").alias("competition")), "asked_id", "left").withColumn("season", F.col("asked_season")).withColumn("name", F.col("league.round"))
    rows = older_strength.round_of(rows, rounds)
    for side in ("home", "away"):
        known = teams.select(F.col("team_id").alias(f"{side}_id"), F.lit(True).alias(f"knows_{side}")).distinct()
        rows = rows.withColumn(f"{side}_id", F.col(f"teams.{side}.id")).join(known, f"{side}_id", "left")
    rules = [
        ("fixture_without_id", "critical", F.col("id").isNull()), *[(f"fixture_{code}", "warning", F.coalesce(F.col("status").isin(*names), F.lit(False))) for code, names in STATUSES.items()],
        ("fixture_of_unknown_status", "critical", ~F.col("status").isin(*PLAYED)), ("fixture_of_another_competition", "critical", (F.col("league.id") != F.col("asked_id")) | (F.col("league.name") != F.col("competition"))),
        ("fixture_of_another_season", "critical", F.col("league.season") != F.col("asked_season")), ("fixture_of_unknown_round", "critical", F.col("round_id").isNull()),
        ("fixture_of_unknown_home_team", "warning", F.col("knows_home").isNull()), ("fixture_of_unknown_away_team", "warning", F.col("knows_away").isNull()), ("fixture_without_goals", "critical", F.col("goals.home").isNull() | F.col("goals.away").isNull()),
    ]
    kept, refused = ingest._refused(rows, rules, "fixture")
    won = [F.coalesce(F.col(f"teams.{s}.winner"), F.lit(False)) for s in ("home", "away")]
    winner = F.when(won[0] & ~won[1], F.col("home_id")).when(won[1] & ~won[0], F.col("away_id")).otherwise(F.lit(DRAW))
    points = lambda a, b: F.when(F.col(f"goals.{a}") > F.col(f"goals.{b}"), 3).when(F.col(f"goals.{a}") == F.col(f"goals.{b}"), 1).otherwise(0).cast("long")
    part = lambda a, n: F.substring("date", a, n).try_cast("long")
    made = kept.select(
        F.col("id").alias("match_id"), F.col("asked_id").alias("comp_id"), "competition", F.col("league.country").alias("country"), "season", "round_id", F.to_timestamp("date").alias("ts"), part(12, 2).alias("hour"), part(6, 2).alias("month"),
        "home_id", "away_id", winner.alias("winner_id"), F.col("goals.home").alias("home_goals"), F.col("goals.away").alias("away_goals"), points("home", "away").alias("home_points"), points("away", "home").alias("away_points"),
    )
    return made, refused


def statistics(records: DataFrame) -> DataFrame:
    """(match_id, home_ and away_ statistics) of records(match_id, record); missing ones are -1, percentages shares."""
    rows = ingest.parsed(records.select("match_id", "record"), STATISTICS).withColumn("s", F.coalesce("response", F.from_json(F.lit("[]"), STATISTICS.split(" ", 1)[1])))
    return rows.select("match_id", *[legacy.stat_value(F.col("s"), theirs, i, percent).alias(f"{side}_{ours}") for ours, (theirs, percent) in STATS.items() for i, side in enumerate(("home", "away"))])


def feed_lineups(records: DataFrame) -> DataFrame:
    """(match_id, side, slot, player_id, name, position) of records(match_id, record); a list of 22 is cut to 11, another size than 11 and 0 is an error."""
    rows = ingest.parsed(records.select("match_id", "record"), LINEUPS)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.coalesce(F.transform(F.get("response", F.lit(i))["startXI"], lambda p: p["player"]), F.from_json(F.lit("[]"), "array<struct<id: long, name: string, pos: string>>")).alias("l")) for i in (0, 1)])
    one = rows.select("match_id", F.explode(sides).alias("s")).select("match_id", "s.side", F.col("s.l").alias("l"))
    size = F.size("l")
    repaired = F.when(size == 2 * C.PLAYERS, F.slice("l", 1, C.PLAYERS)).when(size.isin(0, C.PLAYERS), F.col("l")).otherwise(F.raise_error(F.lit("a line-up is neither 11 nor 22")).cast("array<struct<id: bigint, name: string, pos: string>>"))
    return one.select("match_id", "side", F.posexplode(repaired).alias("slot", "p")).select("match_id", "side", F.col("slot").cast("long").alias("slot"), F.col("p.id").alias("player_id"), F.col("p.name").alias("name"), F.col("p.pos").alias("position"))


def wide_skill_rows(cells: DataFrame, skills: tuple[str, ...], most_missing: int = MOST_MISSING) -> DataFrame:
    """(snap_date, player_id, name, full_name, dob, positions, skills, line) of `csv_archive.csv_cells`: the last row of each player and file.

    A row shorter than its header gets empty cells at place REALIGNED_AT; missing or odd skills are -1, and a player with more than most_missing + 1 of them is left out, as is
    one whose skills go on missing after that. Rows without id, names or birthday are an error.
    """
    header = cells.where("line = 0").select("file", F.transform("cells", lambda c: F.trim(c)).alias("names"))
    rows = cells.where("line > 0").join(header, "file")
    gap = F.size("names") - F.size("cells")
    aligned = F.when(gap > 0, F.concat(F.slice("cells", F.lit(1), F.lit(REALIGNED_AT)), F.array_repeat(F.lit(""), F.greatest(gap, F.lit(0))), F.slice("cells", F.lit(REALIGNED_AT + 1), F.size("cells")))).otherwise(F.col("cells"))
    rows = rows.withColumn("cells", aligned)
    of = lambda name: F.trim(F.coalesce(F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1), F.lit("")))
    values = F.array(*[F.coalesce(F.when(of(s).rlike(r"^[+-]?\d+$"), of(s).try_cast("double")), F.lit(C.MISSING)) for s in skills])
    dob = flexible_date(of("dob"))
    needed = of("player_id").try_cast("long").isNotNull() & (of("name") != "") & (of("full_name") != "") & dob.isNotNull()
    rows = rows.where(F.when(needed, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("id, names or birthday are missing in "), "file", F.lit(", line "), F.col("line").cast("string"))).cast("boolean")))
    name = F.when(F.contains(of("name"), F.lit("FIFA")), F.get(F.split(of("name"), " - FIFA"), F.lit(0))).otherwise(F.get(F.split(of("name"), " -"), F.lit(0)))
    positions = F.when(of("positions") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(of("positions"), ","), lambda p: F.trim(p)))
    made = rows.select("snap_date", of("player_id").try_cast("long").alias("player_id"), name.alias("name"), of("full_name").alias("full_name"), dob.alias("dob"), positions.alias("positions"), values.alias("skills"), "line")
    kept = made.where(F.size(F.filter("skills", lambda x: x == C.MISSING)) <= most_missing + 1)
    last = F.row_number().over(Window.partitionBy("snap_date", "player_id").orderBy(F.desc("line")))
    return kept.withColumn("_r", last).where("_r = 1").drop("_r")


def stored_records(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Records of text columns: stored ones without a -1 in any cell, and fetched ones of other matches with bet_placed; those with a readable start, as started.

    bet_placed: the recommended bet for, if it is above 0, else that against, to two digits; neither is an error.
    """
    complete = ~F.exists(F.array(*[F.trim(F.col(c).cast("string")) for c in stored.columns]), lambda v: F.coalesce(v == "-1", F.lit(False)))
    old = stored.where(complete)
    new = fetched.join(old.select("match_id"), "match_id", "left_anti").dropDuplicates(["match_id"])
    yes, no = (F.round(F.col(c).try_cast("double"), 2) for c in ("recommended_bet_yes", "recommended_bet_no"))
    bet = F.when(F.col("recommended_bet_yes").try_cast("double") > 0, yes).when(no > 0, no).otherwise(F.raise_error(F.lit("no bet was placed")).cast("double"))
    both = old.unionByName(new.withColumn("bet_placed", bet.cast("string")), allowMissingColumns=True)
    return both.withColumn("started", F.try_to_timestamp("match_start_datetime_utc", F.lit("yyyy-MM-dd HH:mm 'UTC'"))).where("started is not null")


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, metric, comp_id, season, value) of text logs: a line `name:` begins a metric, lines ` comp / season: value` belong to it; of repeated entries the last counts. A file is a row, as its lines have an order."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    name = F.nullif(F.regexp_extract("line", r"^(mp[0-9a-zA-Z_]+):\s*$", 1), F.lit(""))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda i: F.regexp_extract("line", r"^\s+(\d+)\s*/\s*(\d+):\s+(\d+)\s*$", i).try_cast("long")
    rows = lines.withColumn("metric", F.last(name, ignorenulls=True).over(before)).select("file", "n", "metric", part(1).alias("comp_id"), part(2).alias("season"), part(3).alias("value")).where("metric is not null and value is not null")
    return rows.groupBy("file", "metric", "comp_id", "season").agg(F.max_by("value", "n").alias("value"))


def first_known(row: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """row with each of our names from the first of its aliases that the row has a value in; names without any alias there are null."""
    have: dict[str, Column] = {n: F.coalesce(*[F.nullif(F.col(a).cast("string"), F.lit("")) for a in own if a in row.columns]) if any(a in row.columns for a in own) else F.lit(None).cast("string") for n, own in aliases.items()}
    return row.select("*", *[c.alias(n) for n, c in have.items() if n not in row.columns])
