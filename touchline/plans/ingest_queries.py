"""Queries on the ingest of JSON records, which Spark makes from the driver's tables, each with its SQL over those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.scalars import iso_day
from touchline.plans.fixtures import by_match, tables
from touchline.sources import ingest

COUNTRIES, NAMES, FIRST = ("C0", "C1", "C2"), ("L0", "L1", "L2", "L3"), 1994


def raw(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Records of the service's shape: some matches are not complete, without goals or of another season, some teams and players are unknown, some line-ups have odd ids."""
    m = tables(spark, d, "fx_matches").withColumn("cs", F.col("league") * 10000 + F.col("season")).withColumn("country", F.concat(F.lit("C"), F.col("league").cast("string")))
    seasons = m.select("competition", "country", "cs", "season").distinct().groupBy("competition", "country")
    year = F.when(F.col("season") % 2 == 0, F.col("season")).otherwise(F.col("season") * 10001 + 1)
    leagues = seasons.agg(F.collect_list(F.struct(F.col("cs").alias("id"), year.alias("year"))).alias("season")).select(F.to_json(F.struct(F.col("competition").alias("name"), "country", "season")).alias("record"))
    t = m.select("cs", F.explode(F.array("home_id", "away_id")).alias("id")).distinct().where("id % 17 <> 6")
    team = F.struct("id", F.concat(F.lit("Team "), F.col("id").cast("string")).alias("name"), F.col("cs").alias("competition_id"))
    teams = t.select(F.col("cs").alias("season_id"), F.col("cs").alias("ord"), F.to_json(team).alias("record"))
    c = tables(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.explode(F.expr("if(c_custkey % 11 = 2, array(0, 1), array(0))")).alias("again"))
    c = c.withColumn("club_team_id", (F.col("id") + 4 * F.col("again")) % 40).withColumn("club_team_2_id", F.when(F.col("id") % 7 == 3, F.col("id") * 4 % 48 + F.col("club_team_id") % 4).otherwise(-1))
    c = c.withColumn("competition_id", F.col("club_team_id") % 4 * 10000 + 1994 + F.col("id") % 4).withColumn("birthday", F.when(F.col("id") % 13 == 5, 0).otherwise(F.col("id") * 864000 + 3600))
    players = c.select(F.col("competition_id").alias("season_id"), (2 * F.col("id") + F.col("again")).alias("ord"), F.to_json(F.struct("id", "full_name", "club_team_id", "club_team_2_id", "competition_id", "birthday")).alias("record"))
    goals = F.when(F.col("match_id") % 59 == 4, -1).otherwise(F.col("home_goals"))
    record = F.struct(
        F.col("match_id").alias("id"), F.col("cs").alias("competition_id"), F.when(F.col("match_id") % 29 == 3, "suspended").otherwise("complete").alias("status"), F.col("home_id").alias("homeID"), F.col("away_id").alias("awayID"),
        F.concat_ws("/", (F.col("season") + (F.col("match_id") % 71 == 9).cast("int")).cast("string"), (F.col("season") + 1).cast("string")).alias("season"), F.col("round_id").alias("roundID"),
        (F.unix_timestamp(F.col("dt").cast("timestamp")) + 3600 * F.col("hour_utc")).alias("date_unix"), goals.alias("homeGoalCount"), F.col("away_goals").alias("awayGoalCount"),
    )
    matches = m.select(F.col("cs").alias("season_id"), F.col("match_id").alias("ord"), F.to_json(record).alias("record"))
    odd = (F.col("match_id") % 53 == 1) & (F.col("slot") == 3)
    listed = tables(spark, d, "fx_lineups", fx_matches=by_match(spark, d)).withColumn("p", F.when(odd, '{"player_id": "none"}').otherwise(F.concat(F.lit('{"player_id": '), F.col("player_id").cast("string"), F.lit("}"))))
    one = lambda side: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("side", "slot", "p")), lambda x: x.side == side)), lambda x: x.p), ", ")
    lineups = listed.groupBy("match_id").agg(F.concat(F.lit('[{"note": 1}, {"lineups": {"team_a": ['), one(0), F.lit('], "team_b": ['), one(1), F.lit("]}}]")).alias("record"))
    return {"leagues": leagues, "teams": teams, "players": players, "matches": matches, "lineups": lineups}


def ingested(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return ingest.ingest(raw(spark, d), COUNTRIES, NAMES, FIRST)


def ingested_matches(spark: SparkSession, d: str) -> DataFrame:
    return ingested(spark, d)["matches"].select("match_id", "comp_season_id", "competition", "country", "season", "round_id", F.date_format("dt", "yyyy-MM-dd").alias("day"), "hour_utc", "month", "home_id", "away_id", "home_goals", "home_points", "away_points")


def ingested_players(spark: SparkSession, d: str) -> DataFrame:
    out = ingested(spark, d)
    clubs = out["rosters"].groupBy("player_id").agg(F.count("*").alias("rosters"), F.min("team_id").alias("least_team"))
    return out["players"].join(clubs, "player_id").select("player_id", "full_name", iso_day(F.col("birthday")).alias("birthday"), "rosters", "least_team")


def ingested_lineups(spark: SparkSession, d: str) -> DataFrame:
    return ingested(spark, d)["lineups"].groupBy("match_id", "side").agg(F.count("*").alias("listed"), F.sum(F.col("slot") * F.col("player_id")).alias("weighted"))


def ingest_refusals(spark: SparkSession, d: str) -> DataFrame:
    return ingested(spark, d)["refused"].groupBy("code", "severity", "entity").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (ingested_matches, ingested_players, ingested_lineups, ingest_refusals)}

_INGEST = f"""m AS (SELECT *, league * 10000 + season AS cs, concat('C', league) AS country FROM {{fx_matches}}),
wanted AS (SELECT DISTINCT cs, season, country, competition FROM m WHERE country IN {COUNTRIES} AND season >= {FIRST}),
t AS (SELECT DISTINCT cs, id FROM (SELECT cs, unnest([home_id, away_id]) AS id FROM m) WHERE id % 17 <> 6 AND cs IN (SELECT cs FROM wanted)),
c0 AS (SELECT c_custkey AS id, c_name AS full_name, unnest(CASE WHEN c_custkey % 11 = 2 THEN [0, 1] ELSE [0] END) AS again FROM customer),
c1 AS (SELECT *, (id + 4 * again) % 40 AS club FROM c0),
c AS (SELECT *, CASE WHEN id % 7 = 3 THEN id * 4 % 48 + club % 4 ELSE -1 END AS second, club % 4 * 10000 + 1994 + id % 4 AS comp, CASE WHEN id % 13 = 5 THEN 0 ELSE id * 864000 + 3600 END AS born FROM c1),
judged AS (
  SELECT c.*, CASE WHEN born <= 0 THEN 'player_without_birthday' WHEN a.id IS NULL THEN 'player_of_unknown_team' WHEN second <> -1 AND b.id IS NULL THEN 'player_of_unknown_second_team' END AS why, a.id IS NOT NULL AS known1, b.id IS NOT NULL AS known2
  FROM c LEFT JOIN t a ON a.id = club AND a.cs = comp LEFT JOIN t b ON b.id = second AND b.cs = comp WHERE comp IN (SELECT cs FROM wanted)),
players AS (SELECT id, full_name, born, again AS first_again FROM judged WHERE why IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY again) = 1),
tried AS (SELECT j.* FROM judged j LEFT JOIN players p USING (id) WHERE j.born > 0 AND known1 AND (first_again IS NULL OR again <= first_again)),
rosters AS (SELECT DISTINCT club AS team_id, comp, id AS player_id FROM tried UNION SELECT second, comp, id FROM tried WHERE second <> -1 AND known2),
home AS (SELECT DISTINCT id FROM t),
seen AS (
  SELECT m.*, CASE WHEN match_id % 29 = 3 THEN 'match_not_complete' WHEN home_id NOT IN (SELECT id FROM home) THEN 'match_of_unknown_home_team' WHEN away_id NOT IN (SELECT id FROM home) THEN 'match_of_unknown_away_team'
    WHEN match_id % 71 = 9 THEN 'match_of_another_season' WHEN match_id % 59 = 4 THEN 'match_without_goals' END AS why FROM m WHERE cs IN (SELECT cs FROM wanted)),
asked AS (SELECT s.*, EXISTS (SELECT 1 FROM {{fx_lineups}} l WHERE l.match_id = s.match_id AND l.slot = 3) AND match_id % 53 = 1 AS odd, match_id IN (SELECT match_id FROM {{fx_lineups}}) AS listed FROM seen s WHERE why IS NULL),
kept AS (SELECT * FROM asked WHERE listed AND NOT odd)"""

SQL = {
    "ingested_matches": f"""WITH {_INGEST} SELECT match_id, cs AS comp_season_id, competition, country, season, round_id, strftime(dt + hour_utc * INTERVAL 1 HOUR, '%Y-%m-%d') AS day, hour(dt + hour_utc * INTERVAL 1 HOUR) AS hour_utc, month(dt + hour_utc * INTERVAL 1 HOUR) AS month, home_id, away_id, home_goals,
  CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS home_points, CASE WHEN home_goals < away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS away_points FROM kept""",
    "ingested_players": f"WITH {_INGEST} SELECT p.id AS player_id, full_name, strftime(to_timestamp(born) AT TIME ZONE 'UTC', '%Y-%m-%d') AS birthday, count(*) AS rosters, min(team_id) AS least_team FROM players p JOIN rosters r ON r.player_id = p.id GROUP BY ALL",
    "ingested_lineups": f"""WITH {_INGEST}, placed AS (SELECT l.match_id, side, player_id, row_number() OVER (PARTITION BY l.match_id, side ORDER BY slot) - 1 AS slot FROM {{fx_lineups}} l JOIN kept USING (match_id) WHERE player_id IN (SELECT id FROM players))
SELECT match_id, CAST(side AS INT) AS side, count(*) AS listed, CAST(sum(slot * player_id) AS BIGINT) AS weighted FROM placed GROUP BY ALL""",
    "ingest_refusals": f"""WITH {_INGEST}, whys AS (SELECT why AS code, 'player' AS entity FROM judged WHERE why IS NOT NULL UNION ALL SELECT why, 'match' FROM seen WHERE why IS NOT NULL
  UNION ALL SELECT CASE WHEN NOT listed THEN 'match_without_lineups' ELSE 'lineup_with_odd_ids' END, 'match' FROM asked WHERE odd OR NOT listed)
SELECT code, CASE WHEN code IN ('match_of_another_season', 'match_without_goals') THEN 'critical' ELSE 'warning' END AS severity, entity, count(*) AS n FROM whys GROUP BY ALL""",
}
