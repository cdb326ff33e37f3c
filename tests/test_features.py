"""The full feature table against plain loops, and with odd rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from touchline import config as C
from touchline.operators import features, form
from touchline.plans.fixtures import tables


def clip(x):
    return C.ALMOST_ZERO if x <= 0 else C.ALMOST_ONE if x >= 1 else x


def test_features_against_plain_loops(spark):
    rows = tables(spark, "/root/testdata/sf0.001", "fx_full_stats").where("match_id < 1200")
    got = {r.match_id: r for r in features.match_features(rows, None, ("L1",)).collect()}
    plain = rows.orderBy(*form.in_order()).collect()
    assert got.keys() == {r.match_id for r in plain} and len(features.feature_names()) == 78
    history = {}
    for r in plain:
        g = got[r.match_id]
        assert g.comp_id == (0 if r.competition == "L1" else -1)
        for side, team in (("home", r.home_id), ("away", r.away_id)):
            seen = history.get(team, [])
            for n in features.LAST:
                fouls = [m[f"{s}_fouls"] for s, m in seen[-n:] if m[f"{s}_fouls"] != -1]
                assert g[f"{side}_fouls_last_{n}"] == pytest.approx(clip(sum(fouls) / len(fouls) / C.SCALES["fouls"]) if fouls else C.ALMOST_ZERO)
                totals = [m.home_xg + m.away_xg for _, m in seen[-n:] if m.home_xg != -1 and m.away_xg != -1]
                assert g[f"{side}_total_xg_last_{n}"] == pytest.approx(clip(sum(totals) / len(totals) / C.SCALES["total_xg"]) if totals else C.ALMOST_ZERO)
                conceded = [m.away_goals if s == "home" else m.home_goals for s, m in seen if s == side][-n:]
                assert g[f"{side}_role_conceded_last_{n}"] == pytest.approx(clip(sum(conceded) / len(conceded) / 5) if conceded else C.ALMOST_ZERO)
            for days in features.LOAD_DAYS:
                near = sum((r.dt - m.dt).days <= days for _, m in seen)
                assert g[f"{side}_load_{days}"] == pytest.approx(clip(near / days / C.SCALES["load"]))
        for side, team in (("home", r.home_id), ("away", r.away_id)):
            history.setdefault(team, []).append((side, r))


def test_features_of_odd_rows(spark):
    stats = {f"{side}_{x}": None for side in ("home", "away") for x in features.SIDE_STATS}
    day = datetime.datetime(2022, 5, 1)
    rows = [(1, day, None, 2022, "X", 1, 2, 1, 0), (2, None, 5, 2022, "X", 2, 1, 0, 0), (3, day, 7, None, None, 1, None, 0, 0), (4, day, 7, 2022, "X", 3, 4, None, None)]
    table = spark.createDataFrame(rows, "match_id long, dt timestamp, hour_utc long, season long, competition string, home_id long, away_id long, home_goals long, away_goals long")
    table = table.select("*", *[F.lit(v).cast("double").alias(k) for k, v in stats.items()]).withColumn("side", F.lit("clash"))
    matrix = spark.createDataFrame([(1, 0, [[1.0]])], "match_id long, side int, matrix array<array<double>>")
    got = {r.match_id: r for r in features.match_features(table, strengths=matrix).collect()}
    assert set(got) == {1, 2, 4} and got[1].home_strength == [[1.0]] and got[1].away_strength is None
    assert all(r[x] is not None for r in got.values() for x in features.feature_names())
    assert got[1].home_xg_last_5 == C.ALMOST_ZERO and got[1].position_in_season == C.ALMOST_ZERO
    assert features.match_features(table.limit(0)).count() == 0
