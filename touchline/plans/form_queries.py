"""Queries on form, tables, seasons, selection and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions import scalars as S
from touchline.operators import features, form, league, sequential
from touchline.plans.fixtures import tables

CLIP = "CASE WHEN {x} <= 0 THEN 1e-6 WHEN {x} >= 1 THEN 1 - 1e-6 ELSE {x} END"
BEFORE = "(PARTITION BY {by} ORDER BY dt, hour_utc, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def sql_mean(value: str, by: str, n: int, most: float) -> str:
    mean = f"avg({value}) OVER {BEFORE.format(by=by, n=n)}"
    return f"round(CASE WHEN {mean} IS NULL THEN 1e-6 ELSE {CLIP.format(x=f'({mean} / {most})')} END, 9)"


def r9(column):
    return F.round(column, 9)


def teams(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "fx_team_matches")


def with_shots(spark: SparkSession, d: str) -> DataFrame:
    matches = tables(spark, d, "fx_matches").join(tables(spark, d, "fx_stats"), "match_id")
    return form.team_matches(matches, {"shots": "home_shots"}, {"shots": "away_shots"})


def last5_goals(spark: SparkSession, d: str) -> DataFrame:
    rows = teams(spark, d).withColumn("last5_goals", r9(form.goals_mean(5)))
    return rows.where("role = 'home'").select("match_id", "team_id", "last5_goals")


def last20_role_goals(spark: SparkSession, d: str) -> DataFrame:
    scored, conceded = form.role_goals(20)
    return teams(spark, d).select("match_id", "team_id", r9(scored).alias("scored"), r9(conceded).alias("conceded"))


def points_mean(spark: SparkSession, d: str) -> DataFrame:
    return teams(spark, d).select("match_id", "team_id", r9(form.points_mean(5)).alias("points5"))


def match_load(spark: SparkSession, d: str) -> DataFrame:
    return teams(spark, d).select("match_id", "team_id", r9(form.match_load(14)).alias("load14"), r9(form.match_load(14, C.SCALES["load"])).alias("load01"))


def stat_mean_missing(spark: SparkSession, d: str) -> DataFrame:
    return with_shots(spark, d).select("match_id", "team_id", r9(form.stat_mean("own_shots", 5, 290.0)).alias("shots5"))


def total_stat_mean(spark: SparkSession, d: str) -> DataFrame:
    return with_shots(spark, d).select("match_id", "team_id", r9(form.total_mean("own_shots", "opp_shots", 5, 580.0)).alias("total5"))


SHOTS = """WITH v AS (
  SELECT m.match_id, dt, hour_utc, home_id AS team_id, nullif(home_shots, -1) AS own, nullif(away_shots, -1) AS opp FROM {fx_matches} m JOIN {fx_stats} s USING (match_id)
  UNION ALL SELECT m.match_id, dt, hour_utc, away_id, nullif(away_shots, -1), nullif(home_shots, -1) FROM {fx_matches} m JOIN {fx_stats} s USING (match_id))
"""


def lag_previous_match(spark: SparkSession, d: str) -> DataFrame:
    rows = teams(spark, d).withColumn("p", form.previous_match("match_id", "gf", "ga"))
    return rows.select("match_id", "team_id", F.col("p.match_id").alias("prev_match"), F.col("p.gf").alias("prev_gf"), F.col("p.ga").alias("prev_ga"))


def last_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = teams(spark, d).withColumn("last", form.last_matches(3, "match_id"))
    return rows.select("match_id", "team_id", F.array_join(F.transform("last", lambda x: x["match_id"].cast("string")), ",").alias("last3"))


def sequence_features(spark: SparkSession, d: str) -> DataFrame:
    vector = F.array(F.col("gf").cast("double"), F.col("ga").cast("double"))
    rows = teams(spark, d).withColumn("seq", form.padded_sequence(vector, 4, 2))
    flat = F.array_join(F.transform(F.flatten("seq"), lambda x: x.cast("long").cast("string")), ",")
    return rows.select("match_id", "team_id", F.size("seq").alias("steps"), flat.alias("seq"))


def table_position(spark: SparkSession, d: str) -> DataFrame:
    return league.pre_match_places(teams(spark, d)).select("match_id", "team_id", r9(F.col("place01")).alias("place01"))


def season_table(spark: SparkSession, d: str) -> DataFrame:
    return league.season_table(teams(spark, d)).withColumn("mean_points", r9(F.col("mean_points")))


def season_flag(spark: SparkSession, d: str) -> DataFrame:
    return league.regular_season(tables(spark, d, "fx_matches")).select("match_id", "initial_round", "regular")


def season_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return league.season_breakdown(tables(spark, d, "fx_matches"))


def season_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = league.season_dates(tables(spark, d, "fx_matches"))
    end = league.projected_end(F.col("last_dt").cast("date"), F.col("season") + 1, 7)
    return rows.select("season", "competition", "first_dt", "last_dt", end.alias("next_end"))


def season_position(spark: SparkSession, d: str) -> DataFrame:
    matches = tables(spark, d, "fx_matches")
    return matches.join(league.season_dates(matches), ["season", "competition"]).select("match_id", r9(league.season_position()).alias("position01"))


SELECTION = C.Selection(("L0", "L1", "L2"), 1995, 1998, (("L1", 1996),), {(c, s): (1, 2) for c in ("L0", "L1", "L2") for s in (1995, 1997)} | {("L0", 1996): (3,), ("L2", 1996): (1,)})


def select_league(spark: SparkSession, d: str) -> DataFrame:
    return league.select_matches(tables(spark, d, "fx_matches"), SELECTION).select("match_id", "competition", "season", "round_id")


def excluded_anti(spark: SparkSession, d: str) -> DataFrame:
    matches = tables(spark, d, "fx_matches")
    present = league.select_matches(matches, SELECTION, with_rounds=False).select("competition", "season", "round_id").distinct()
    return present.join(F.broadcast(league.round_table(spark, SELECTION)), ["competition", "season", "round_id"], "left_anti")


LISTED = " UNION ALL ".join(f"SELECT '{c}' AS competition, {s} AS season, {r} AS round_id" for (c, s), rs in SELECTION.rounds.items() for r in rs)
SELECTED = "competition IN ('L0', 'L1', 'L2') AND season >= 1995 AND season < 1998 AND NOT (competition = 'L1' AND season = 1996)"


def infer_round(spark: SparkSession, d: str) -> DataFrame:
    return league.first_rounds(tables(spark, d, "fx_matches"), league.round_table(spark, SELECTION))


def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return league.dense_ids(teams(spark, d), "team_id")


def membership(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("comp_season_id"), (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_suppkey")).alias("ord"))


def link_membership(spark: SparkSession, d: str) -> DataFrame:
    return league.link_competitions(tables(spark, d, "fx_matches"), membership(spark, d)).select("match_id", "comp_season_id")


def membership_faults(spark: SparkSession, d: str) -> DataFrame:
    return league.membership_faults(tables(spark, d, "fx_matches"), membership(spark, d))


def most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return league.most_frequent(tables(spark, d, "events"), ["user_id"], "event_type", "event_id")


def target_modes(spark: SparkSession, d: str) -> DataFrame:
    home, away = F.col("home_goals"), F.col("away_goals")
    return tables(spark, d, "fx_matches").select("match_id", S.target(home, away).alias("under"), S.target(home, away, "goals_dist", 5).alias("goal_class"), S.target(home, away, "goals_reg").alias("goals"))


def cyclic_time(spark: SparkSession, d: str) -> DataFrame:
    hs, hc = S.cyclic(F.col("hour_utc"), 24)
    ms, mc = S.cyclic(F.month("dt"), 12, 1)
    return tables(spark, d, "fx_matches").select("match_id", *[r9(c).alias(n) for n, c in (("hour_sin", hs), ("hour_cos", hc), ("month_sin", ms), ("month_cos", mc))])


def scalers(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "fx_matches").select(
        "match_id", r9(S.scaled_stat(F.col("home_goals").cast("double"), "goals")).alias("goals01"), r9(S.season01(F.col("season") + 27)).alias("season01"),
        r9(S.elo01(F.lit(1300.0) + F.col("match_id") % 500)).alias("elo01"), r9(S.logit(S.clip_probability((F.col("match_id") % 11) / 10.0))).alias("logit"),
    )


def name_key(spark: SparkSession, d: str) -> DataFrame:
    plain = S.plain_name(F.col("c_name"))
    return tables(spark, d, "customer").select("c_custkey", plain.alias("plain"), S.name_key(plain).alias("name_key"))


def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat((1 + F.col("p_size") / 10.0).cast("string"), F.lit(" » "), (1 + F.floor(F.col("p_retailprice") / 10) / 100.0).cast("string"))
    start, end = S.quoted_move(title)
    return tables(spark, d, "part").select(
        "p_partkey", start.alias("odds_start"), end.alias("odds_end"), S.number_in(F.concat(F.col("p_size").cast("string"), F.lit(" %"))).alias("share"),
        S.first_text(F.lit(" "), F.col("p_brand")).alias("first_text"), S.is_number(F.col("p_name")).alias("name_is_number"),
    )


def running_elo(spark: SparkSession, d: str) -> DataFrame:
    rated = sequential.elo_ratings(tables(spark, d, "fx_matches"))
    return rated.select("match_id", *[F.round(c, 6).alias(c) for c in ("home_elo", "away_elo", "home_elo_after", "away_elo_after")], r9(S.elo01(F.col("home_elo"))).alias("home01"))


def rounds(spark: SparkSession, d: str) -> DataFrame:
    return sequential.greedy_rounds(tables(spark, d, "fx_matches"))


def round_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sequential.round_sizes(rounds(spark, d))


def repeated_teams(spark: SparkSession, d: str) -> DataFrame:
    return sequential.repeated_teams(uniform_rounds(spark, d), teams(spark, d))


def uniform_rounds(spark: SparkSession, d: str) -> DataFrame:
    return sequential.uniform_rounds(sequential.order_rank(tables(spark, d, "fx_matches"))).select("match_id", "round_index")


def folds(spark: SparkSession, d: str) -> DataFrame:
    made = sequential.rolling_folds(uniform_rounds(spark, d), 25)
    return made.groupBy("fold", "part").agg(F.count("*").alias("matches"), F.min("match_id").alias("least"), F.max("match_id").alias("most"))


def match_features(spark: SparkSession, d: str) -> DataFrame:
    return features.match_features(tables(spark, d, "fx_full_stats"), None, ("L0", "L1", "L2"), digits=6).withColumn("comp_id", F.col("comp_id").cast("long"))


UNIFORM = """WITH r AS (SELECT match_id, row_number() OVER (ORDER BY dt, hour_utc, match_id) AS rn, count(*) OVER () AS n FROM {fx_matches}),
u AS (SELECT match_id, CAST(floor((rn - 1) / 51) AS BIGINT) - CASE WHEN floor((rn - 1) / 51) = floor((n - 1) / 51) AND floor((n - 1) / 51) > 0 AND n % 51 > 0 AND n % 51 < 25 THEN 1 ELSE 0 END AS round_index
      FROM r WHERE (rn - 1) % 51 <> 50)
"""

PLACES = """WITH s AS (SELECT DISTINCT season, competition, dt, hour_utc FROM {fx_team_matches}), t AS (SELECT DISTINCT season, competition, team_id FROM {fx_team_matches}),
g AS (SELECT season, competition, dt, hour_utc, team_id, count(*) AS p, sum(gf) AS gf, sum(ga) AS ga, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS pts FROM {fx_team_matches} GROUP BY ALL),
b AS (SELECT s.*, t.team_id, coalesce(sum(p) OVER w, 0) AS p, coalesce(sum(gf) OVER w, 0) AS gf, coalesce(sum(ga) OVER w, 0) AS ga, coalesce(sum(pts) OVER w, 0) AS pts
      FROM s JOIN t USING (season, competition) LEFT JOIN g USING (season, competition, dt, hour_utc, team_id)
      WINDOW w AS (PARTITION BY season, competition, team_id ORDER BY dt, hour_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY season, competition, dt, hour_utc ORDER BY CASE WHEN p = 0 THEN 0.0 ELSE pts / p END DESC, gf - ga DESC, gf DESC, team_id) AS rk,
      count(*) OVER (PARTITION BY season, competition, dt, hour_utc) AS n FROM b)
SELECT m.match_id, team_id, round(CASE WHEN n > 1 THEN 1 - (rk - 1) / (n - 1) ELSE 1.0 END, 9) AS place01 FROM {fx_team_matches} m JOIN k USING (season, competition, dt, hour_utc, team_id)"""

ROUNDS = """WITH RECURSIVE m AS MATERIALIZED (SELECT match_id, home_id, away_id, row_number() OVER (ORDER BY dt, coalesce(hour_utc, -1), match_id) AS rn FROM {fx_matches}),
again AS (SELECT rn, min(nx) AS nx FROM (SELECT rn, lead(rn) OVER (PARTITION BY team ORDER BY rn) AS nx FROM (SELECT rn, unnest([home_id, away_id]) AS team FROM m)) GROUP BY rn),
links AS MATERIALIZED (SELECT rn, min(nx) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING) AS nb FROM again),
chain AS (SELECT CAST(1 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS k UNION ALL SELECT nb, k + 1 FROM chain JOIN links USING (rn) WHERE nb IS NOT NULL),
r AS (SELECT match_id, max(k) OVER (ORDER BY m.rn) AS round_index FROM m LEFT JOIN chain USING (rn))"""


def elo_sql(state: str, new: tuple[str, str], step: str, out: str, start: float) -> str:
    """A competition's matches one after another, with a list of its ten teams' state."""
    return f"""WITH RECURSIVE m AS MATERIALIZED (SELECT match_id, competition, season, CAST((home_id - league) / 4 AS INT) + 1 AS h, CAST((away_id - league) / 4 AS INT) + 1 AS a,
  (CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END)::DOUBLE AS got, row_number() OVER (PARTITION BY competition ORDER BY dt, coalesce(hour_utc, -1), match_id) AS i FROM {{fx_matches}}),
r AS (SELECT DISTINCT competition, CAST(0 AS BIGINT) AS i, [{start}::DOUBLE for j in range(10)] AS e, [{state} for j in range(10)] AS s, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS DOUBLE) AS rh, CAST(NULL AS DOUBLE) AS ra, CAST(NULL AS DOUBLE) AS nh, CAST(NULL AS DOUBLE) AS na FROM m
UNION ALL SELECT competition, i, list_transform(range(1, 11), lambda j: CASE WHEN j = h THEN nh WHEN j = a THEN na ELSE e[j] END), list_transform(range(1, 11), lambda j: CASE WHEN j = h THEN {new[0]} WHEN j = a THEN {new[1]} ELSE s[j] END), match_id, rh, ra, nh, na
FROM (SELECT *, {step} FROM (SELECT *, 1 / (1 + pow(10, (ra - rh) / 400)) AS ex FROM ({out}))))"""


RATING = " ".join([f"CASE WHEN coalesce(r.s[m.{x}], m.season) = m.season THEN r.e[m.{x}] ELSE {C.INIT_ELO} + {C.ELO_SEASON_REGRESSION} * (r.e[m.{x}] - {C.INIT_ELO}) END AS r{x}," for x in "ha"])
RUNNING_ELO = elo_sql(
    "CAST(NULL AS BIGINT)", ("season", "season"), f"rh + {C.ELO_K} * (got - ex) AS nh, ra - {C.ELO_K} * (got - ex) AS na",
    f"SELECT m.competition, m.i, m.match_id, m.season, m.h, m.a, m.got, {RATING} r.e, r.s FROM r JOIN m ON m.competition = r.competition AND m.i = r.i + 1", C.INIT_ELO,
)

def features_sql() -> str:
    """Every feature by its own window over a view with two rows a match; ratings and places by the texts above."""
    names = list(features.SIDE_STATS)
    sides = " UNION ALL ".join(
        f"SELECT match_id, dt, hour_utc, {own}_id AS team_id, '{own}' AS role, {own}_goals AS gf, {opp}_goals AS ga, " + ", ".join(f"nullif({own}_{x}, -1) AS own_{x}, nullif({opp}_{x}, -1) AS opp_{x}" for x in names) + " FROM {fx_full_stats}"
        for own, opp in (("home", "away"), ("away", "home"))
    )
    mean = lambda value, n, scale, by="team_id": sql_mean(value, by, n, C.SCALES[scale]).replace(", 9)", ", 6)")
    points = "CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END"
    rolling = {}
    for n in features.LAST:
        rolling |= {f"{x}_last_{n}": mean(f"own_{x}", n, scale) for x, scale in features.SIDE_STATS.items()}
        rolling |= {f"total_{x}_last_{n}": mean(f"own_{x} + opp_{x}", n, scale) for x, scale in features.TOTAL_STATS.items()}
        rolling |= {f"points_last_{n}": mean(points, n, "points"), f"goals_last_{n}": mean("gf", n, "goals")}
        rolling |= {f"role_{k}_last_{n}": mean(c, n, "goals", "team_id, role") for k, c in (("scored", "gf"), ("conceded", "ga"))}
    load = ", ".join(f"round({CLIP.format(x=f'(count(*) FILTER (WHERE days <= {n}) / {n}.0 / 0.24)')}, 6) AS load_{n}" for n in features.LOAD_DAYS)
    clip = lambda x: f"round({CLIP.format(x=f'({x})')}, 6)"
    shown = [x for x in features.side_features() if x not in ("elo",)]
    both = ", ".join(f"max({x}) FILTER (WHERE role = '{side}') AS {side}_{x}" for side in ("home", "away") for x in shown)
    ctes, places = PLACES.rsplit("\nSELECT ", 1)
    return f"""{RUNNING_ELO}, {ctes.removeprefix("WITH ").replace("s AS (SELECT DISTINCT", "ps AS (SELECT DISTINCT").replace("SELECT s.*", "SELECT ps.*").replace("FROM s JOIN", "FROM ps JOIN")},
places AS (SELECT {places}),
v AS ({sides}),
roll AS (SELECT match_id, team_id, role, {", ".join(f"{v} AS {k}" for k, v in rolling.items())} FROM v),
near AS (SELECT a.match_id, a.team_id, date_diff('day', b.dt, a.dt) AS days FROM v a LEFT JOIN v b ON a.team_id = b.team_id AND (b.dt, b.hour_utc, b.match_id) < (a.dt, a.hour_utc, a.match_id) AND date_diff('day', b.dt, a.dt) <= 25),
load AS (SELECT match_id, team_id, {load} FROM near GROUP BY ALL),
sided AS (SELECT match_id, {both} FROM (SELECT roll.*, round(place01, 6) AS place, load.* EXCLUDE (match_id, team_id) FROM roll JOIN load USING (match_id, team_id) JOIN places USING (match_id, team_id)) GROUP BY match_id),
ends AS (SELECT season, competition, min(dt) AS first_dt, max(dt) AS last_dt FROM {{fx_matches}} GROUP BY ALL)
SELECT match_id, CASE competition WHEN 'L0' THEN 0 WHEN 'L1' THEN 1 WHEN 'L2' THEN 2 ELSE -1 END::BIGINT AS comp_id, home_id, away_id, {clip("(season - 2021) / 3.0")} AS season,
  round((sin(2 * pi() * hour_utc / 24.0) + 1) / 2, 6) AS hour_sin, round((cos(2 * pi() * hour_utc / 24.0) + 1) / 2, 6) AS hour_cos,
  round((sin(2 * pi() * (month(dt) - 1) / 12.0) + 1) / 2, 6) AS month_sin, round((cos(2 * pi() * (month(dt) - 1) / 12.0) + 1) / 2, 6) AS month_cos,
  {clip("coalesce((epoch(dt) - epoch(first_dt) + hour_utc * 3600) / 86400.0 / nullif((epoch(last_dt) - epoch(first_dt)) / 86400.0, 0), 0.0)")} AS position_in_season,
  sided.* EXCLUDE (match_id), {clip(f"(rh - {C.ELO_MIN}) / ({C.ELO_MAX} - {C.ELO_MIN})")} AS home_elo, {clip(f"(ra - {C.ELO_MIN}) / ({C.ELO_MAX} - {C.ELO_MIN})")} AS away_elo
FROM {{fx_matches}} JOIN sided USING (match_id) JOIN ends USING (season, competition) JOIN (SELECT match_id, rh, ra FROM r WHERE match_id IS NOT NULL) USING (match_id)"""


SQL = {
    "match_features": features_sql(),
    "rounds": f"{ROUNDS} SELECT match_id, round_index FROM r",
    "round_sizes": f"{ROUNDS}, z AS (SELECT round_index, count(*) AS n FROM r GROUP BY ALL) SELECT count(*) AS rounds, min(n) AS least, max(n) AS most, avg(n) AS mean, median(n) AS median FROM z",
    "running_elo": f"{RUNNING_ELO} SELECT match_id, round(rh, 6) AS home_elo, round(ra, 6) AS away_elo, round(nh, 6) AS home_elo_after, round(na, 6) AS away_elo_after, round(greatest(1e-6, least(1 - 1e-6, (rh - {C.ELO_MIN}) / ({C.ELO_MAX} - {C.ELO_MIN}))), 9) AS home01 FROM r WHERE match_id IS NOT NULL",
    "last5_goals": f"SELECT match_id, team_id, last5_goals FROM (SELECT match_id, team_id, role, {sql_mean('gf', 'team_id', 5, 5.0)} AS last5_goals FROM {{fx_team_matches}}) WHERE role = 'home'",
    "last20_role_goals": f"SELECT match_id, team_id, {sql_mean('gf', 'team_id, role', 20, 5.0)} AS scored, {sql_mean('ga', 'team_id, role', 20, 5.0)} AS conceded FROM {{fx_team_matches}}",
    "points_mean": f"SELECT match_id, team_id, {sql_mean('CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END', 'team_id', 5, 3.0)} AS points5 FROM {{fx_team_matches}}",
    "match_load": f"""SELECT match_id, team_id, round(x / 14.0, 9) AS load14, round({CLIP.format(x="((x / 14.0) / 0.24)")}, 9) AS load01 FROM (
      SELECT a.match_id, a.team_id, count(b.match_id) AS x FROM {{fx_team_matches}} a LEFT JOIN {{fx_team_matches}} b
        ON a.team_id = b.team_id AND (b.dt, b.hour_utc, b.match_id) < (a.dt, a.hour_utc, a.match_id) AND date_diff('day', b.dt, a.dt) <= 14 GROUP BY ALL)""",
    "stat_mean_missing": f"{SHOTS} SELECT match_id, team_id, {sql_mean('own', 'team_id', 5, 290.0)} AS shots5 FROM v",
    "total_stat_mean": f"{SHOTS} SELECT match_id, team_id, {sql_mean('own + opp', 'team_id', 5, 580.0)} AS total5 FROM v",
    "lag_previous_match": "SELECT match_id, team_id, lag(match_id) OVER w AS prev_match, lag(gf) OVER w AS prev_gf, lag(ga) OVER w AS prev_ga FROM {fx_team_matches} WINDOW w AS (PARTITION BY team_id ORDER BY dt, hour_utc, match_id)",
    "last_matches": "SELECT match_id, team_id, coalesce(string_agg(CAST(match_id AS VARCHAR), ',') OVER (PARTITION BY team_id ORDER BY dt, hour_utc, match_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS last3 FROM {fx_team_matches}",
    "sequence_features": """SELECT match_id, team_id, 4 AS steps, repeat('0,0,', CAST(4 - n AS BIGINT)) || s AS seq FROM (
      SELECT match_id, team_id, count(*) OVER w AS n, coalesce(string_agg(gf || ',' || ga, ',') OVER w, '') AS s FROM {fx_team_matches}
      WINDOW w AS (PARTITION BY team_id ORDER BY dt, hour_utc, match_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE n > 0
      UNION ALL SELECT match_id, team_id, 4, '0,0,0,0,0,0,0,0' FROM (SELECT match_id, team_id, row_number() OVER (PARTITION BY team_id ORDER BY dt, hour_utc, match_id) AS rn FROM {fx_team_matches}) WHERE rn = 1""",
    "table_position": PLACES,
    "season_table": """SELECT *, row_number() OVER (PARTITION BY season, competition ORDER BY points / played DESC, gf - ga DESC, gf DESC, team_id) AS place, round(points / played, 9) AS mean_points FROM (
      SELECT season, competition, team_id, count(*) AS played, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS points FROM {fx_team_matches} GROUP BY ALL)""",
    "season_flag": """SELECT match_id, initial_round, max(CAST(round_id <> initial_round AS INT)) OVER (PARTITION BY season, competition ORDER BY dt, hour_utc, match_id) = 0 AS regular FROM (
      SELECT *, first_value(round_id) OVER (PARTITION BY season, competition ORDER BY dt, hour_utc, match_id) AS initial_round FROM {fx_matches})""",
    "season_breakdown": """WITH a AS (SELECT *, first_value(round_id) OVER (PARTITION BY season, competition ORDER BY dt, hour_utc, match_id) AS i FROM {fx_matches}),
      b AS (SELECT *, max(CAST(round_id <> i AS INT)) OVER (PARTITION BY season, competition ORDER BY dt, hour_utc, match_id) = 0 AS regular FROM a)
      SELECT season, competition, count(*) AS matches, count(*) FILTER (WHERE regular) AS regular_matches, count(*) FILTER (WHERE NOT regular) AS other_matches, count(DISTINCT round_id) AS rounds, min(dt) AS first_dt, max(dt) AS last_dt FROM b GROUP BY ALL""",
    "season_dates": """SELECT season, competition, min(dt) AS first_dt, max(dt) AS last_dt,
      CAST(least(make_date(CAST(season + 1 + CAST(month(max(dt)) < 7 AS INT) AS BIGINT), month(max(dt)), 1) + CAST(day(max(dt)) - 1 AS INT), last_day(make_date(CAST(season + 1 + CAST(month(max(dt)) < 7 AS INT) AS BIGINT), month(max(dt)), 1))) AS DATE) AS next_end
      FROM {fx_matches} GROUP BY season, competition""",
    "season_position": f"""SELECT match_id, round({CLIP.format(x="p")}, 9) AS position01 FROM (
      SELECT match_id, coalesce((epoch(dt) - epoch(a) + hour_utc * 3600) / 86400.0 / nullif((epoch(b) - epoch(a)) / 86400.0, 0), 0.0) AS p FROM {{fx_matches}} JOIN
      (SELECT season, competition, min(dt) AS a, max(dt) AS b FROM {{fx_matches}} GROUP BY ALL) USING (season, competition))""",
    "select_league": f"SELECT match_id, competition, season, round_id FROM {{fx_matches}} WHERE {SELECTED} AND (competition, season, round_id) IN (SELECT (competition, season, round_id) FROM ({LISTED}))",
    "excluded_anti": f"SELECT DISTINCT competition, season, round_id FROM {{fx_matches}} WHERE {SELECTED} EXCEPT SELECT competition, season, round_id FROM ({LISTED})",
    "infer_round": f"SELECT competition, season, arg_min(round_id, (dt, hour_utc, match_id)) AS round_id FROM {{fx_matches}} WHERE (competition, season) NOT IN (SELECT (competition, season) FROM ({LISTED})) GROUP BY ALL",
    "dense_ids": "SELECT value, row_number() OVER (ORDER BY value) - 1 AS dense_id FROM (SELECT DISTINCT team_id AS value FROM {fx_team_matches})",
    "link_membership": "SELECT match_id, comp_season_id FROM {fx_matches} LEFT JOIN (SELECT l_orderkey, arg_max(l_suppkey, CAST(l_linenumber AS BIGINT) * 1000000 + l_suppkey) AS comp_season_id FROM {lineitem} GROUP BY ALL) ON l_orderkey = match_id",
    "membership_faults": "SELECT match_id, coalesce(n, 0) AS n FROM {fx_matches} LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM {lineitem} GROUP BY ALL) ON l_orderkey = match_id WHERE coalesce(n, 0) <> 1",
    "most_frequent": "SELECT user_id, arg_max(event_type, (n, -f)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM {events} GROUP BY ALL) GROUP BY user_id",
    "target_modes": "SELECT match_id, CAST(home_goals + away_goals <= 2 AS DOUBLE) AS under, CAST(least(home_goals + away_goals, 5) AS INT) AS goal_class, CAST(home_goals + away_goals AS DOUBLE) AS goals FROM {fx_matches}",
    "cyclic_time": """SELECT match_id, round((sin(2 * pi() * hour_utc / 24.0) + 1) / 2, 9) AS hour_sin, round((cos(2 * pi() * hour_utc / 24.0) + 1) / 2, 9) AS hour_cos,
      round((sin(2 * pi() * (month(dt) - 1) / 12.0) + 1) / 2, 9) AS month_sin, round((cos(2 * pi() * (month(dt) - 1) / 12.0) + 1) / 2, 9) AS month_cos FROM {fx_matches}""",
    "scalers": f"""SELECT match_id, round({CLIP.format(x="(home_goals / 5.0)")}, 9) AS goals01, round({CLIP.format(x="((season + 27 - 2021) / 3.0)")}, 9) AS season01,
      round({CLIP.format(x="((1300.0 + match_id % 500 - 1352.5387) / (1734.8060 - 1352.5387))")}, 9) AS elo01, round(ln(p / (1 - p)), 9) AS logit
      FROM (SELECT *, greatest(least(CAST((match_id % 11) / 10.0 AS DOUBLE), 1 - 1e-6), 1e-6) AS p FROM {{fx_matches}})""",
    "name_key": """SELECT c_custkey, plain, CASE WHEN len(s) >= 2 AND length(s[-1]) >= 2 THEN s[-1] || '|' || substr(plain, 1, 1) END AS name_key FROM (
      SELECT c_custkey, plain, string_split(plain, ' ') AS s FROM (SELECT c_custkey, trim(regexp_replace(translate(lower(c_name), '.,''"()-_', '        '), '\\s+', ' ', 'g')) AS plain FROM {customer}))""",
    "text_helpers": """SELECT p_partkey, CASE WHEN a > 1 THEN a END AS odds_start, CASE WHEN b > 1 THEN b END AS odds_end, p_size / CAST(100.0 AS DOUBLE) AS share, p_brand AS first_text, try_cast(p_name AS DOUBLE) IS NOT NULL AS name_is_number
      FROM (SELECT *, 1 + p_size / CAST(10.0 AS DOUBLE) AS a, 1 + floor(p_retailprice / 10) / CAST(100.0 AS DOUBLE) AS b FROM {part})""",
    "uniform_rounds": f"{UNIFORM} SELECT match_id, round_index FROM u",
    "folds": f"""{UNIFORM} SELECT f.fold, CASE WHEN u.round_index = f.fold THEN 'validation' ELSE 'training' END AS part, count(*) AS matches, min(match_id) AS least, max(match_id) AS most
      FROM (SELECT DISTINCT round_index AS fold FROM u WHERE round_index >= 25) f JOIN u ON u.round_index BETWEEN f.fold - 25 AND f.fold GROUP BY ALL""",
    "repeated_teams": f"{UNIFORM} SELECT round_index, team_id, count(*) AS n FROM u JOIN {{fx_team_matches}} USING (match_id) GROUP BY ALL HAVING count(*) > 1",
}

QUERIES = {f.__name__: f for f in (
    match_features,
    last5_goals, last20_role_goals, points_mean, match_load, stat_mean_missing, total_stat_mean, lag_previous_match, last_matches, sequence_features, table_position, season_table, season_flag, season_breakdown,
    season_dates, season_position, select_league, excluded_anti, infer_round, dense_ids, link_membership, membership_faults, most_frequent, target_modes, cyclic_time, scalers, name_key, text_helpers,
    running_elo, rounds, round_sizes, repeated_teams, uniform_rounds, folds,
)}
