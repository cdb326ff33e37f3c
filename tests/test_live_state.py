"""Streams with keyed state against plain loops over the same rows."""

import random
import time
from datetime import datetime, timedelta

import pytest

from touchline.streaming import live

DAY = datetime(2024, 1, 1)


def streamed(spark, tmp_path, parts, schema, made):
    """The rows that made(stream) appends, the parts coming one after another."""
    source = tmp_path / "in"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(1.1)  # the file source takes older files first
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"t{abs(hash(str(tmp_path)))}"
    query = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_running_form(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(1, 3), i, DAY + timedelta(days=i // 3), rng.choice([None, 12, 20]) if i % 5 else 1, rng.choice([None, 0, 1, 2, 3]), rng.randint(0, 3)) for i in range(60)]
    rows.sort(key=lambda r: (r[2], -1 if r[3] is None else r[3], r[1]))
    schema = "team_id long, match_id long, dt timestamp, hour_utc long, gf long, ga long"
    got = {r.match_id: tuple(r)[2:] for r in streamed(spark, tmp_path, [rows[:24], rows[24:48], rows[48:]], schema, lambda s: live.running_form(s, 4))}
    past, want = {}, {}
    for team, match, _, _, gf, ga in rows:
        last = past.setdefault(team, [])[-4:]
        want[match] = tuple(sum(x[k] for x in last) / len(last) for k in range(3)) if last else (None,) * 3
        if gf is not None:
            past[team].append((gf, ga, 3 if gf > ga else int(gf == ga)))
    assert got == want


def test_stand_in_lineups(spark, tmp_path):
    team = lambda k: list(range(k, k + 11))
    at = lambda h: DAY + timedelta(hours=h)
    first = [(1, "A", 1, at(1), True, team(0), False), (1, "A", 2, at(2), False, team(50), False), (1, "B", 3, at(1), True, [], True), (2, "A", 4, at(1), True, team(20) * 2, False)]
    then = [(1, "A", 5, at(9), True, None, True), (1, "A", 6, at(10), True, [], False), (2, "A", 7, at(9), True, [], True), (1, "A", 8, at(8), True, team(70), True)]
    schema = "team_id long, competition string, match_id long, kickoff timestamp, regular boolean, lineup array<long>, use_previous_lineup boolean"
    got = {r.match_id: (r.lineup, r.estimated) for r in streamed(spark, tmp_path, [first, then], schema, live.stand_in_lineups)}
    assert got == {1: (team(0), False), 2: (team(50), False), 3: ([], False), 4: (team(20), False), 5: (team(70), True), 6: ([], False), 7: (team(20), True), 8: (team(70), False)}


def test_running_places_closes_a_time_when_the_watermark_has_passed(spark, tmp_path):
    rows = [(2024, "A", i, DAY + timedelta(hours=i // 2 * 6), 1 + i % 3, 4 + i % 2, i % 4, (i + 1) % 3) for i in range(16)]
    schema = "season long, competition string, match_id long, ts timestamp, home_id long, away_id long, home_goals long, away_goals long"
    # the parts cut through pairs of matches that are played at one time
    got = {(r.match_id, r.team_id): (r.played, r.points, r.gf, r.ga) for r in streamed(spark, tmp_path, [rows[:5], rows[5:9], rows[9:]], schema, lambda s: live.running_places(s, "6 hours"))}
    newest = max(r[3] for r in rows) - timedelta(hours=6)
    totals, want = {}, {}
    for when in sorted({r[3] for r in rows}):
        now = [r for r in rows if r[3] == when]
        for r in now:
            for t in (r[4], r[5]):
                want[r[2], t] = totals.get(t, (0, 0, 0, 0))
        for r in now:
            for t, gf, ga in ((r[4], r[6], r[7]), (r[5], r[7], r[6])):
                p, pts, a, b = totals.get(t, (0, 0, 0, 0))
                totals[t] = (p + 1, pts + (3 if gf > ga else int(gf == ga)), a + gf, b + ga)
    # what is newer than the watermark waits; the engine may not have run another batch for the last one
    assert got.items() <= want.items()
    assert {k for k in want if next(r[3] for r in rows if r[2] == k[0]) < newest - timedelta(hours=12)} <= got.keys()


def test_no_rows(spark, tmp_path):
    schema = "team_id long, match_id long, dt timestamp, hour_utc long, gf long, ga long"
    assert streamed(spark, tmp_path, [[]], schema, live.running_form) == []


@pytest.mark.parametrize("size", [5, 13])
def test_a_lineup_of_another_size_is_an_error(spark, tmp_path, size):
    schema = "team_id long, competition string, match_id long, kickoff timestamp, regular boolean, lineup array<long>, use_previous_lineup boolean"
    with pytest.raises(Exception, match="neither"):
        streamed(spark, tmp_path, [[(1, "A", 1, DAY, True, list(range(size)), False)]], schema, live.stand_in_lineups)
