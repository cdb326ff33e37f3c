"""Match data made from the driver's tables, by the same SQL in Spark and (as CTEs) in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Made statistics: name, multiplier of the match id, modulus and divisor.
STAT_RULES = (
    ("xg", 17, 300, 100), ("pre_match_xg", 13, 250, 100), ("shots_on_target", 7, 13, 1), ("shots_off_target", 11, 19, 1), ("shots", 5, 30, 1), ("corners", 3, 14, 1),
    ("possession", 23, 101, 1), ("fouls", 29, 23, 1), ("attacks", 37, 170, 1), ("dangerous_attacks", 41, 110, 1),
)

VIEWS = {
    "fx_matches": """
        select b.*, cast('L' || cast(league as string) as string) as competition,
               ((cast((home_id - league) / 4 as bigint) + 1 + match_id % 9) % 10) * 4 + league as away_id
        from (select o_orderkey as match_id, o_orderdate as dt, cast(o_orderkey % 24 as bigint) as hour_utc,
                     cast(year(o_orderdate) as bigint) as season, o_custkey % 40 as home_id, (o_custkey % 40) % 4 as league,
                     cast(floor(o_totalprice) as bigint) % 5 as home_goals, (o_orderkey * 7 + 3) % 4 as away_goals, 1 + o_orderkey % 3 as round_id
              from {orders}) b""",
    "fx_stats": """
        select m.match_id, coalesce(l.q, -1.0) as home_shots, coalesce(l.d, -1.0) as away_shots
        from {fx_matches} m left join (select l_orderkey, sum(l_quantity) as q, cast(count(*) as double) as d from {lineitem} group by l_orderkey) l
          on l.l_orderkey = m.match_id""",
    "fx_full_stats": "select m.*, " + ", ".join(
        f"case when (match_id + {k + 7 * (side == 'away')}) % 19 = 0 then cast(-1 as double) else cast((match_id * {prime} + {31 * (side == 'away')}) % {most} as double) / {parts} end as {side}_{name}"
        for side in ("home", "away") for k, (name, prime, most, parts) in enumerate(STAT_RULES)
    ) + " from {fx_matches} m",
    "fx_team_matches": """
        select match_id, dt, hour_utc, season, competition, home_id as team_id, 'home' as role, home_goals as gf, away_goals as ga from {fx_matches}
        union all
        select match_id, dt, hour_utc, season, competition, away_id, 'away', away_goals, home_goals from {fx_matches}""",
    "fx_snapshots": """
        select user_id as player_id, cast(ts as date) as snap_date, event_id, case when event_type = 'error' then -1.0 else value end as skill from {events}""",
    "fx_predictions": """
        select match_id, season, competition, dt, cast(home_goals + away_goals <= 2 as int) as y_true,
               cast(0.05 as double) + cast(0.9 as double) * ((match_id * 37) % 1000) / cast(1000 as double) as p_under,
               cast(1.2 as double) + ((match_id * 13) % 250) / cast(100 as double) as under_odds,
               cast(1.2 as double) + ((match_id * 29) % 250) / cast(100 as double) as over_odds
        from {fx_matches}""",
    "fx_slots": """
        select a.event_id % 2 as side, cast(floor(a.event_id / 2) as bigint) as slot from {events} a where a.event_id < 22""",
    "fx_lineups": """
        select m.match_id, s.side, s.slot, (m.match_id * 7 + s.slot * 13 + s.side * 5) % 150 as player_id
        from {fx_matches} m cross join {fx_slots} s where not (m.match_id % 50 = 0 and s.slot = 10)""",
    "fx_comp_seasons": """
        select distinct league * 10000 + season as comp_season_id, competition as name, season, concat('C', cast(league as string)) as country
        from {fx_matches} where (league * 10000 + season) % 11 <> 3""",
    "fx_linked": """
        select match_id, dt, hour_utc, season, competition, round_id, league, case when match_id % 61 = 1 then null when match_id % 47 = 2 then home_id else away_id end as away_id, home_id, away_goals,
               case when match_id % 59 = 4 then -1 when match_id % 53 = 6 then null else home_goals end as home_goals,
               case when match_id % 101 = 5 then null else league * 10000 + season + case when match_id % 89 = 7 then 1 else 0 end end as comp_season_id,
               case when match_id % 83 = 3 then 'X' else concat('C', cast(league as string)) end as country
        from {fx_matches}""",
    "fx_membership": """
        select comp_season_id, match_id from {fx_linked} where comp_season_id is not null and match_id % 67 <> 2
        union all select comp_season_id + 1, match_id from {fx_linked} where comp_season_id is not null and match_id % 71 = 4
        union all select comp_season_id, match_id + 1000000000 from {fx_linked} where comp_season_id is not null and match_id % 73 = 6
        union all select comp_season_id, match_id from {fx_linked} where comp_season_id is not null and match_id % 79 = 8""",
    "fx_rated": """
        select distinct player_id, case when player_id % 5 = 0 then -1 else player_id + 5000 end as rated_id from {fx_lineups} where player_id % 7 <> 3""",
    "fx_clubs": """
        select distinct home_id as team_id, case when home_id % 9 = 4 then -1 else home_id + 100 end as club_id from {fx_matches} where home_id % 11 <> 3""",
    "fx_listed": """
        select match_id, side, slot, case when (match_id + slot) % 97 = 11 then 0 else player_id end as player_id,
               case when slot = 0 and match_id % 13 <> 5 then 'Goalkeeper' when slot < 5 then 'Defender' else 'Forward' end as position
        from {fx_lineups} where not (match_id % 41 = 9 and side = 1)""",
    "fx_cells": """
        select l.match_id, l.side, l.slot, k.skill_no,
               case when (l.player_id * 3 + k.skill_no * 5 + l.match_id) % 23 < 2 or l.player_id % 29 = 7 or l.match_id % 37 = 3 then cast(-1 as double) else cast((l.player_id * 7 + k.skill_no * 13) % 100 as double) end as value
        from {fx_lineups} l cross join (select event_id as skill_no from {events} where event_id < 4) k where not (l.match_id % 31 = 8 and l.side = 0)""",
}

#: Sides of a view's cross join that a bound on event_id keeps small, whatever the size of events.
SMALL = {"fx_lineups": "fx_slots", "fx_cells": "events"}


def needs(sql: str) -> list[str]:
    """Views that a text uses, those that others use first."""
    out: list[str] = []
    for name in re.findall(r"\{(fx_\w+)\}", sql):
        for x in [*needs(VIEWS[name]), name]:
            if x not in out:
                out.append(x)
    return out


def tables(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A base table or a view over them; given: what stands for some of them."""
    if name in given:
        return given[name]
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {x: tables(spark, sf_dir, x, **given) for x in set(re.findall(r"\{(\w+)\}", sql))}
    if name in SMALL:
        used[SMALL[name]] = F.broadcast(used[SMALL[name]])
    return spark.sql(sql, **used)


def by_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_matches dealt out by match_id, so that what views make of a match is grouped by it without a shuffle."""
    return tables(spark, sf_dir, "fx_matches").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "match_id")


def oracle(sql: str) -> str:
    """A text that uses views as one statement over base tables."""
    names = {x: x for x in (*BASE, *VIEWS)}
    ctes = [f"{name} AS ({VIEWS[name].format(**names)})" for name in needs(sql)]
    body = sql.format(**names).strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
