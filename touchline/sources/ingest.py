"""Ingest of JSON records of a match service into tables: comp-seasons, teams, rosters, players, matches, line-ups, and what was refused.

Inputs are tables of raw records (`record`: one JSON object as text), as the paged source reads them, with the comp-season or match that they were asked for and
`ord`, their order of arrival. Fields are parsed with fixed schemas, so that a value of another type is null; every look-up of the
record-by-record original is a join on ids, and "first come, first kept" is the least `ord` of an id.

Rules: only complete matches between known teams that are not stored yet; of a team the first record; a player needs a birthday (seconds, above 0) and known clubs
in the comp-season, and is kept with the first record that has them, rosters being filled from records up to that one; a line-up with an id
that is no whole number refuses its match, unknown players are left out of it. Records that contradict their comp-season, or goals of -1, are refused as critical.

Defined results: records that are no JSON objects or lack an id are refused; repeated records count once; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import config as C

#: Fixed names of the service's match statistics and odds: our name, its name (sides a and b).
STATS = {
    "corners": "corners", "offsides": "offsides", "red_cards": "red_cards", "yellow_cards": "yellow_cards", "shots_on_target": "shotsOnTarget", "shots_off_target": "shotsOffTarget", "shots": "shots", "fouls": "fouls",
    "possession": "possession", "attacks": "attacks", "dangerous_attacks": "dangerous_attacks", "xg": "xg", "pre_match_xg": "xg_prematch",
}
ODDS = {
    "home_win": "odds_ft_1", "draw": "odds_ft_x", "away_win": "odds_ft_2", **{f"{s}{n}5": f"odds_ft_{s}{n}5" for s in ("over", "under") for n in range(5)}, "btts_yes": "odds_btts_yes", "btts_no": "odds_btts_no",
}
SIDES = {"home": "a", "away": "b"}
LEAGUE = "name string, country string, season array<struct<id: long, year: long>>"
TEAM = "id long, name string, cleanName string, english_name string, full_name string, shortHand string, country string, competition_id long"
PLAYER = "id long, full_name string, first_name string, last_name string, shorthand string, known_as string, position string, birthday long, nationality string, club_team_id long, club_team_2_id long, competition_id long"
MATCH = "id long, competition_id long, status string, homeID long, awayID long, season string, roundID long, game_week long, date_unix long, homeGoalCount long, awayGoalCount long, refereeID long, coach_a_ID long, coach_b_ID long, " + ", ".join(
    [*(f"team_{s}_{theirs} double" for theirs in STATS.values() for s in SIDES.values()), *(f"{theirs} double" for theirs in ODDS.values())]
)
LINEUP = "lineups struct<team_a: array<struct<player_id: long>>, team_b: array<struct<player_id: long>>>"


def parsed(records: DataFrame, schema: str) -> DataFrame:
    """The fields of a schema beside the columns of records."""
    return records.withColumn("_r", F.from_json("record", schema)).select(*[c for c in records.columns if c != "record"], "_r.*")


def _refused(rows: DataFrame, rules: list[tuple[str, str, Column]], entity: str) -> tuple[DataFrame, DataFrame]:
    """Rows that no rule refuses, and (code, severity, entity, id) of the others with the first rule that does."""
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, bad in rules])
    judged = rows.withColumn("_why", first)
    return judged.where("_why is null").drop("_why"), judged.where("_why is not null").select("_why.code", "_why.severity", F.lit(entity).alias("entity"), F.col("id").cast("string").alias("id"))


def comp_seasons(leagues: DataFrame, countries: tuple[str, ...], names: tuple[str, ...], first_year: int = C.FIRST_SEASON) -> DataFrame:
    """(comp_season_id, season, country, name) of the wanted leagues from a season on; years are written 2021 or 20212022."""
    one = parsed(leagues, LEAGUE).where(F.col("country").isin(*countries) & F.col("name").isin(*names)).select("country", "name", F.explode("season").alias("s"))
    year = F.substring(F.col("s.year").cast("string"), 1, 4).cast("long")
    return one.select(F.col("s.id").alias("comp_season_id"), year.alias("season"), "country", "name").where((F.col("season") >= first_year) & F.col("comp_season_id").isNotNull()).dropDuplicates(["comp_season_id"])


def teams(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Teams by their first record, and (team_id, competition_id) of every record."""
    rows = parsed(records, TEAM).where("id is not null")
    fields = ["name", "cleanName", "english_name", "full_name", "shortHand", "country"]
    first = rows.groupBy(F.col("id").alias("team_id")).agg(F.min_by(F.struct(*fields), "ord").alias("t"))
    return first.select("team_id", *[F.col(f"t.{f}").alias(n) for f, n in zip(fields, ("name", "clean_name", "english_name", "full_name", "shorthand_name", "country"), strict=True)]), rows.select(F.col("id").alias("team_id"), "competition_id").distinct()


def players(records: DataFrame, team_seasons: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Players, rosters (team_id, competition_id, player_id), and refused records."""
    rows = parsed(records, PLAYER)
    for n, column in (("1", "club_team_id"), ("2", "club_team_2_id")):
        known = team_seasons.select(F.col("team_id").alias(column), "competition_id", F.lit(True).alias(f"known_{n}")).distinct()
        rows = rows.join(known, [column, "competition_id"], "left")
    second = F.coalesce(F.col("club_team_2_id") != -1, F.lit(True))
    rules = [
        ("player_without_id", "critical", F.col("id").isNull()), ("player_without_birthday", "warning", ~F.coalesce(F.col("birthday") > 0, F.lit(False))), ("player_of_unknown_team", "warning", F.col("known_1").isNull()),
        ("player_of_unknown_second_team", "warning", second & F.col("known_2").isNull()),
    ]
    kept, refused = _refused(rows, rules, "player")
    fields = ["full_name", "first_name", "last_name", "shorthand", "known_as", "position", "nationality"]
    born = F.date_trunc("day", F.timestamp_seconds("birthday")).cast("date")
    first = kept.groupBy("id").agg(F.min("ord").alias("first_ord"), F.min_by(F.struct(*fields, born.alias("birthday")), "ord").alias("p"))
    tried = rows.where("id is not null and birthday > 0 and known_1").join(first.select("id", "first_ord"), "id", "left").where("first_ord is null or ord <= first_ord")
    clubs = F.array_compact(F.array(F.col("club_team_id"), F.when(second & F.col("known_2"), F.col("club_team_2_id"))))
    rosters = tried.select(F.explode(clubs).alias("team_id"), "competition_id", F.col("id").alias("player_id")).distinct()
    return first.select(F.col("id").alias("player_id"), *[F.col(f"p.{f}").alias(f) for f in (*fields, "birthday")]), rosters, refused


def lineups(records: DataFrame, known_players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(match_id, side, slot, player_id) of known players in their order, and refused matches. A record is an object or a list, of which the first with line-ups counts; sides that are no lists are empty."""
    listed = F.from_json("record", f"array<struct<{LINEUP.replace(' struct', ': struct', 1)}>>")
    one, empty = F.from_json("record", LINEUP), F.from_json(F.lit('{"lineups": {}}'), LINEUP)["lineups"]
    found = F.when(F.substring(F.ltrim("record"), 1, 1) == "[", F.get(F.filter(listed, lambda x: x["lineups"].isNotNull()), F.lit(0))["lineups"]).otherwise(F.when(one.isNotNull(), F.coalesce(one["lineups"], empty)))
    rows = records.select(F.col("match_id").alias("id"), found.alias("l"))
    rows = rows.groupBy("id").agg(F.first("l", ignorenulls=True).alias("l"))
    sides = [F.coalesce(F.col(f"l.team_{s}"), F.array()) for s in SIDES.values()]
    odd = [F.exists(s, lambda p: p["player_id"].isNull()) for s in sides]
    kept, refused = _refused(rows, [("match_without_lineups", "warning", F.col("l").isNull()), ("lineup_with_odd_ids", "warning", odd[0] | odd[1])], "match")
    slots = reduce(DataFrame.union, [kept.select("id", F.lit(i).alias("side"), F.posexplode(s).alias("place", "p")) for i, s in enumerate(sides)])
    known = slots.select("id", "side", "place", F.col("p.player_id").alias("player_id")).join(known_players.select("player_id").distinct(), "player_id", "left_semi")
    slot = F.row_number().over(Window.partitionBy("id", "side").orderBy("place")) - 1
    return known.select(F.col("id").alias("match_id"), "side", slot.cast("long").alias("slot"), "player_id"), refused


def matches(records: DataFrame, seasons: DataFrame, known_teams: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New matches, membership (comp_season_id, match_id) of new and stored ones, and refused records (asked for by their column season_id)."""
    rows = parsed(records.withColumnRenamed("season_id", "asked"), MATCH)
    own = seasons.select(F.col("comp_season_id").alias("asked"), F.col("season").alias("cs_season"), F.col("name").alias("competition"), F.col("country").alias("cs_country"))
    rows = rows.join(own, "asked", "left").withColumn("year", F.expr("try_cast(split(season, '/')[0] as bigint)"))
    for side in SIDES:
        rows = rows.join(known_teams.select(F.col("team_id").alias(f"{side}ID"), F.lit(True).alias(f"known_{side}")).distinct(), f"{side}ID", "left")
    old = (stored.select(F.col("match_id").alias("id")).distinct() if stored is not None else rows.select("id").limit(0)).withColumn("old", F.lit(True))
    rows = rows.join(old, "id", "left")
    rules = [
        ("match_without_id", "critical", F.col("id").isNull()), ("match_of_another_comp_season", "critical", F.col("competition_id") != F.col("asked")), ("match_not_complete", "warning", F.col("status") != "complete"),
        ("match_of_unknown_home_team", "warning", F.col("old").isNull() & F.col("known_home").isNull()), ("match_of_unknown_away_team", "warning", F.col("old").isNull() & F.col("known_away").isNull()),
        ("match_of_another_season", "critical", F.when(F.col("old").isNull(), F.col("year") != F.col("cs_season")).otherwise(False)),
        ("match_without_goals", "critical", F.when(F.col("old").isNull(), (F.col("homeGoalCount") < 0) | (F.col("awayGoalCount") < 0)).otherwise(False)),
    ]
    kept, refused = _refused(rows, rules, "match")
    membership = kept.select(F.col("asked").alias("comp_season_id"), F.col("id").alias("match_id")).distinct()
    nth = F.row_number().over(Window.partitionBy("id").orderBy("ord", "asked"))
    new = kept.where("old is null").withColumn("nth", nth).where("nth = 1")
    time = F.timestamp_seconds("date_unix")
    points = lambda a, b: F.when(F.col(a) > F.col(b), 3).when(F.col(a) == F.col(b), 1).otherwise(0).cast("long")
    made = new.select(
        F.col("id").alias("match_id"), F.col("asked").alias("comp_season_id"), "competition", F.col("cs_country").alias("country"), F.col("year").alias("season"), F.col("roundID").alias("round_id"), "game_week",
        F.date_trunc("day", time).alias("dt"), F.hour(time).cast("long").alias("hour_utc"), F.hour(F.from_utc_timestamp(time, "Europe/Brussels")).cast("long").alias("hour_local"), F.month(time).cast("long").alias("month"),
        F.col("homeID").alias("home_id"), F.col("awayID").alias("away_id"), F.col("homeGoalCount").alias("home_goals"), F.col("awayGoalCount").alias("away_goals"),
        points("homeGoalCount", "awayGoalCount").alias("home_points"), points("awayGoalCount", "homeGoalCount").alias("away_points"),
        F.col("refereeID").alias("referee_id"), F.col("coach_a_ID").alias("home_coach_id"), F.col("coach_b_ID").alias("away_coach_id"),
        *[F.col(f"team_{s}_{theirs}").alias(f"{side}_{ours}") for ours, theirs in STATS.items() for side, s in SIDES.items()], *[F.col(theirs).alias(f"odds_{ours}") for ours, theirs in ODDS.items()],
    )
    return made, membership, refused


def ingest(raw: dict[str, DataFrame], countries: tuple[str, ...], names: tuple[str, ...], first_year: int = C.FIRST_SEASON, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables from raw leagues(record), teams, players, matches(season_id, ord, record) and lineups(match_id, record), with `refused`.

    Only records of the wanted comp-seasons count; a match whose line-ups are refused is refused, and leaves its comp-season.
    """
    seasons = comp_seasons(raw["leagues"], countries, names, first_year)
    wanted = {k: raw[k].join(seasons.select(F.col("comp_season_id").alias("season_id")), "season_id", "left_semi") for k in ("teams", "players", "matches")}
    team_rows, team_seasons = teams(wanted["teams"])
    player_rows, rosters, refused_players = players(wanted["players"], team_seasons)
    match_rows, membership, refused_matches = matches(wanted["matches"], seasons, team_rows, stored)
    asked = match_rows.select("match_id").join(raw["lineups"], "match_id", "left")
    sides, refused_lineups = lineups(asked, player_rows)
    gone = refused_lineups.select(F.col("id").cast("long").alias("match_id"))
    return {
        "comp_seasons": seasons, "teams": team_rows, "team_seasons": team_seasons, "players": player_rows, "rosters": rosters, "matches": match_rows.join(gone, "match_id", "left_anti"),
        "membership": membership.join(gone, "match_id", "left_anti"), "lineups": sides, "refused": refused_players.union(refused_matches).union(refused_lineups),
    }
