"""The live loop as Structured Streaming: fixtures in, a board of predictions out, ratings as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline import config as C
from touchline.operators.sequential import EloTable

INTERVAL = "420 seconds"
LINEUP_SECONDS = 1800
STATE = "teams array<long>, ratings array<double>, seasons array<long>"
RATED = "competition string, match_id long, home_elo double, away_elo double"


def upcoming(fixtures: DataFrame, now: Column) -> DataFrame:
    """Fixtures not started within a day on either side, and whether the last known line-up may stand in (kick-off within half an hour)."""
    wait = F.unix_timestamp("kickoff") - F.unix_timestamp(now)
    near = fixtures.where("status = 'NS'").where((wait >= -86400) & (wait <= 86400))
    return near.withColumn("use_previous_lineup", (wait > 0) & (wait <= LINEUP_SECONDS) & (F.size("lineup") == 0))


def repaired_lineup(lineup: Column) -> Column:
    """A line-up that lists everyone twice (22) is cut to 11; other sizes than 11 and 0 are an error."""
    size = F.size(lineup)
    return F.when(size == 2 * C.PLAYERS, F.slice(lineup, 1, C.PLAYERS)).when(size.isin(0, C.PLAYERS), lineup).otherwise(F.raise_error(F.lit("a line-up is neither 11 nor 22")))


def packed(frames: Iterator[pd.DataFrame], columns: list[str]) -> dict[str, np.ndarray]:
    """Columns of all frames as arrays of the least whole numbers (dates: microseconds) that hold them; of each frame nothing else is kept."""
    held = {c: [] for c in columns}
    for frame in frames:
        for c in columns:
            x = frame[c]
            held[c].append(x.to_numpy().astype("datetime64[us]") if x.dtype.kind not in "iufb" else pd.to_numeric(x, downcast="integer").to_numpy())
    return {c: np.concatenate(held.pop(c)) for c in columns}


def rated(stream: DataFrame, batch: int = 65536) -> DataFrame:
    """Ratings before each match of a stream of results, by competition; the state holds each team's last rating and season.

    A competition's matches of a micro-batch are ordered as packed numbers (some 30 bytes each), and rated `batch` at a time.
    """
    fields = ["season", "home_id", "away_id", "home_goals", "away_goals"]

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        table = EloTable()
        if state.exists:
            table.state = {t: (r, s) for t, r, s in zip(*state.get, strict=True)}
        held = packed(frames, ["dt", "hour_utc", "match_id", *fields])
        order = np.lexsort((held["match_id"], np.nan_to_num(held["hour_utc"], nan=-1), held["dt"]))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            made = [(key[0], m, *table.play(*x)[:2]) for m, *x in zip(*[held[c][part].tolist() for c in ("match_id", *fields)], strict=True)]
            yield pd.DataFrame(made, columns=["competition", "match_id", "home_elo", "away_elo"])
        state.update((list(table.state), [r for r, _ in table.state.values()], [s for _, s in table.state.values()]))

    return stream.groupBy("competition").applyInPandasWithState(run, RATED, STATE, "append", GroupStateTimeout.NoTimeout)


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(hour_utc=rows.hour_utc.fillna(-1)).sort_values(["dt", "hour_utc", "match_id"])


def running_form(stream: DataFrame, n: int = 5) -> DataFrame:
    """Means of goals scored, conceded and points over a team's last n matches before each row of a stream of team rows (team_id, match_id, dt, hour_utc, gf, ga); null for none.

    The state of a team is its last n results. Rows of a micro-batch go in chronological order; a team's batches are taken as they come. Rows without goals give means and enter no state.
    """

    def run(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for r in _in_order(pd.concat(list(frames))).itertuples():
            mean = lambda i, held=held: sum(x[i] for x in held) / len(held) if held else None
            out.append((key[0], r.match_id, mean(0), mean(1), mean(2)))
            if not (pd.isna(r.gf) or pd.isna(r.ga)):
                held.append((int(r.gf), int(r.ga), 3 if r.gf > r.ga else int(r.gf == r.ga)))
                del held[:-n]
        state.update(tuple(list(x) for x in zip(*held, strict=True)) if held else ([], [], []))
        yield pd.DataFrame(out, columns=["team_id", "match_id", "goals", "conceded", "points"])

    kinds = "team_id long, match_id long, goals double, conceded double, points double"
    return stream.groupBy("team_id").applyInPandasWithState(run, kinds, "gf array<long>, ga array<long>, points array<long>", "append", GroupStateTimeout.NoTimeout)


def stand_in_lineups(stream: DataFrame) -> DataFrame:
    """(team_id, competition, match_id, lineup, estimated) of a stream of sides (team_id, competition, match_id, kickoff, regular, lineup, use_previous_lineup).

    The state of a team in a competition is the line-up of its last regular match that had one. A side without a line-up takes it if `upcoming` lets it;
    otherwise its line-up stays empty. Null line-ups are empty; those of 22 are cut.
    """

    def run(key: tuple[int, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else ([],)
        out = []
        for r in pd.concat(list(frames)).sort_values(["kickoff", "match_id"]).itertuples():
            own = [] if r.lineup is None else [int(p) for p in r.lineup]
            if len(own) == 2 * C.PLAYERS:
                own = own[: C.PLAYERS]
            if len(own) not in (0, C.PLAYERS):
                raise ValueError(f"match {r.match_id}: a line-up is neither {C.PLAYERS} nor {2 * C.PLAYERS}")
            estimated = not own and bool(r.use_previous_lineup) and len(last) > 0
            out.append((*key, r.match_id, list(last) if estimated else own, estimated))
            if own and r.regular:
                last = own
        state.update((list(last),))
        yield pd.DataFrame(out, columns=["team_id", "competition", "match_id", "lineup", "estimated"])

    kinds = "team_id long, competition string, match_id long, lineup array<long>, estimated boolean"
    return stream.groupBy("team_id", "competition").applyInPandasWithState(run, kinds, "lineup array<long>", "append", GroupStateTimeout.NoTimeout)


def running_places(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(season, competition, match_id, team_id, played, points, gf, ga) before each match of a stream of results (season, competition, match_id, ts, home_id, away_id, home_goals, away_goals).

    Matches of one time do not count for each other, so a time is closed only when the watermark (`late` behind the newest ts) has passed it: until then its rows wait in
    the state, beside each team's totals. Rows later than the watermark are dropped by it.
    """
    fields = ("match_id", "ts", "home_id", "away_id", "home_goals", "away_goals")

    def run(key: tuple[int, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        teams, totals, waiting = {}, [], []
        if state.exists:
            ids, sums, rows = state.get
            teams = {t: list(x) for t, x in zip(ids, sums, strict=True)}
            waiting = [tuple(r) for r in rows]
        for frame in frames:
            waiting += [(int(m), int(ts.timestamp() * 1000), *map(int, x)) for m, ts, *x in frame[list(fields)].itertuples(index=False, name=None)]
        mark = state.getCurrentWatermarkMs()
        ready, waiting = sorted((r for r in waiting if r[1] <= mark), key=lambda r: (r[1], r[0])), [r for r in waiting if r[1] > mark]
        for i, r in enumerate(ready):
            if not i or r[1] != ready[i - 1][1]:
                for m, _, home, away, hg, ag in [x for x in ready[i:] if x[1] == r[1]]:
                    totals += [(*key, m, t, *teams.get(t, (0, 0, 0, 0))) for t in (home, away)]
                for _, _, home, away, hg, ag in [x for x in ready[i:] if x[1] == r[1]]:
                    for t, gf, ga in ((home, hg, ag), (away, ag, hg)):
                        played, points, scored, conceded = teams.get(t, (0, 0, 0, 0))
                        teams[t] = [played + 1, points + (3 if gf > ga else int(gf == ga)), scored + gf, conceded + ga]
        state.update((list(teams), [list(x) for x in teams.values()], [list(r) for r in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(min(r[1] for r in waiting), mark + 1))
        yield pd.DataFrame(totals, columns=["season", "competition", "match_id", "team_id", "played", "points", "gf", "ga"])

    kinds = "season long, competition string, match_id long, team_id long, played long, points long, gf long, ga long"
    held = "teams array<long>, totals array<array<long>>, waiting array<array<long>>"
    return stream.withWatermark("ts", late).groupBy("season", "competition").applyInPandasWithState(run, kinds, held, "append", GroupStateTimeout.EventTimeTimeout)


def board_writer(path: str):
    """foreachBatch function that replaces the board."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def start_board(stream: DataFrame, path: str, checkpoint: str, interval: str = INTERVAL):
    return stream.writeStream.foreachBatch(board_writer(path)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user in a stream (or table) of events(ts, user_id, value)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    sessions = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sessions.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
