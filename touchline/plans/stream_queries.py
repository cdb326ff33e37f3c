"""Queries that run as streams over whole tables, with SQL over the same rows at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.lineage import shared_folder
from touchline.plans.fixtures import tables
from touchline.plans.form_queries import RUNNING_ELO
from touchline.streaming import live


def streamed(rows: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What made(stream) appends for rows that are written to the shared folder and read as a stream until all are there."""
    spark = rows.sparkSession
    path = shared_folder(spark, "stream")
    rows.write.parquet(f"{path}/in")
    stream = made(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def streamed_form(spark: SparkSession, d: str) -> DataFrame:
    """Means of each team's last five matches, from keyed state."""
    rows = tables(spark, d, "fx_team_matches").select("team_id", "match_id", "dt", "hour_utc", "gf", "ga")
    got = streamed(rows, lambda s: live.running_form(s, 5))
    return got.select("team_id", "match_id", *[F.round(c, 9).alias(c) for c in ("goals", "conceded", "points")])


def streamed_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings before each match, from one state for each competition."""
    rows = tables(spark, d, "fx_matches").select("competition", "match_id", "season", "dt", "hour_utc", "home_id", "away_id", "home_goals", "away_goals")
    return streamed(rows, live.rated).select("competition", "match_id", F.round("home_elo", 6).alias("home_elo"), F.round("away_elo", 6).alias("away_elo"))


QUERIES = {f.__name__: f for f in (streamed_form, streamed_ratings)}

_LAST = "OVER (PARTITION BY team_id ORDER BY dt, hour_utc, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"

SQL = {
    "streamed_form": f"SELECT team_id, match_id, round(avg(gf) {_LAST}, 9) AS goals, round(avg(ga) {_LAST}, 9) AS conceded, round(avg(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) {_LAST}, 9) AS points FROM {{fx_team_matches}}",
    "streamed_ratings": f"{RUNNING_ELO} SELECT competition, match_id, round(rh, 6) AS home_elo, round(ra, 6) AS away_elo FROM r WHERE match_id IS NOT NULL",
}
