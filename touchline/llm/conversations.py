"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

A conversation's rows, by turn, and the four states of the grammar (nothing yet, after system, user, assistant) span a lattice whose nodes are
(rows passed, state). Edits are its edges: Keep (K, 0), Rerole to user or assistant (R, 3), Delete (D, 4, the only way past a blank or duplicate
row) and Insert an empty user or assistant turn (I, 3); a truncated row that stays adds 3. Dijkstra's search makes nodes as it goes; its
key is (cost, audit), the audit being the initials of the edits so far, and it stops at the first accepting end node that it takes from the queue. A
node has one role that Rerole and Insert can give, so an audit says what becomes of each row; of two audits of equal cost at a node neither begins
the other, so that the smaller stays smaller when both grow.

Long conversations: a stretch of rows is itself an edge from each state to each other, found by the same search, so that rows are searched in stretches of
SEGMENT, and edges of stretches by the same search, FAN at a time. Conversations of over LONG_ROWS rows or LONG_BYTES of text are spread over
tasks: equal rows are first counted together, duplicates found by a join with the first turn of each role and text, and stretches cut from rows that are dealt out
and sorted by range. Their edges, one byte or so a row and pair of states, meet in a task for each conversation, as its audit must.

Defined results: null roles and texts are one space; a role that begins with none of s, u, a can't be kept; null turns come first and count for no gap; rows of equal turn go by role
and text; rows with a null conv_id are a conversation; repeated rows are duplicates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, crc32_sql, deleted, named, stored

COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
#: State after a kept role's initial; the role that Rerole and Insert give in a state, and the state after it.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ACCEPTING = (0, 3)
LEGAL = {"su", "ua", "au"}
SEGMENT = 512
FAN = 4
LONG_ROWS = 20_000
LONG_BYTES = 32 << 20
PIECE_BYTES = 4 << 20
BLANK = re.compile(r"[^\x20\x09-\x0D]")
WHITE = " \t\n\v\f\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
Edge = tuple[int, str, int]  # cost, letters, state reached


def search(n: int, edges: Callable[[int, int], Iterator[tuple[int, str, int, int]]], start: int, accepting: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """Dijkstra's search from (0, start) over nodes (i, state), i up to n; edges give cost, letters and the next node.

    With accepting states: the first end node popped that accepts. Without: the least (cost, audit) of each end node.
    """
    queue, done, ends = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if accepting is None:
                ends[state] = cost, audit
            elif state in accepting:
                return {state: (cost, audit)}
        for more, letters, j, t in edges(i, state):
            if (j, t) not in done:
                heapq.heappush(queue, (cost + more, audit + letters, j, t))
    return ends


def row_edges(codes: str) -> Callable[[int, int], Iterator[tuple[int, str, int, int]]]:
    """Edges past rows of one code each: x (has to go) or the role's initial (- for others), in capitals if truncated."""

    def edges(i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        given = GIVEN[state][1]
        yield COSTS["I"], "I", i, given
        if i < len(codes):
            yield COSTS["D"], "D", i + 1, state
            if codes[i] != "x":
                initial = codes[i].lower()
                extra = TRUNCATED_COST * (initial != codes[i] or initial == "_")
                if (state, initial) in KEPT:
                    yield extra + COSTS["K"], "K", i + 1, KEPT[state, initial]
                yield extra + COSTS["R"], "R", i + 1, given

    return edges


def stretch(codes: str) -> dict[int, list[Edge]]:
    """The stretch of these rows as edges from each state."""
    edges = row_edges(codes)
    return {s: [(c, a, t) for t, (c, a) in search(len(codes), edges, s).items()] for s in GIVEN}


def solved(stretches: list[dict[int, list[Edge]]]) -> tuple[int, str]:
    """Cost and audit of the cheapest way through stretches in a row: FAN of them are made one until few are left."""

    def over(group: list[dict[int, list[Edge]]]) -> Callable[[int, int], Iterator[tuple[int, str, int, int]]]:
        return lambda i, s: ((c, a, i + 1, t) for c, a, t in group[i][s]) if i < len(group) else iter(())

    while len(stretches) > FAN:
        groups = [stretches[i : i + FAN] for i in range(0, len(stretches), FAN)]
        stretches = [{s: [(c, a, t) for t, (c, a) in search(len(g), over(g), s).items()] for s in GIVEN} for g in groups]
    return next(iter(search(len(stretches), over(stretches), 0, ACCEPTING).values()))


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation's rows."""
    if len(codes) <= SEGMENT:
        return next(iter(search(len(codes), row_edges(codes), 0, ACCEPTING).values()))
    return solved([stretch(codes[i : i + SEGMENT]) for i in range(0, len(codes), SEGMENT)])


def coded(role: str, text: str, seen: bool) -> tuple[str, str]:
    """The first fault of a row (b, d, t or none) and its code."""
    if not BLANK.search(text):
        return "b", "x"
    if seen:
        return "d", "x"
    initial = role[0] if role[:1] in ("s", "u", "a") else "-"
    if text.rstrip(WHITE)[-1] in ".!?":
        return "", initial
    return "t", initial.upper() if initial != "-" else "_"


def edited(audit: str, rows: list[tuple[str, str]], state: int = 0) -> tuple[list[str], list[str], int]:
    """Roles and texts of the rows after the edits of an audit, and the state reached."""
    roles, texts, at = [], [], 0
    for letter in audit:
        given, after = GIVEN[state]
        if letter == "K":
            given, after = rows[at][0], KEPT[state, rows[at][0][0]]
        if letter != "D":
            roles.append(given)
            texts.append("" if letter == "I" else rows[at][1])
            state = after
        at += letter != "I"
    return roles, texts, state


def damage(turns: DataFrame) -> DataFrame:
    """Rows harmed by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 makes its role user. Nulls in the string, roles and texts are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    read = named(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), harm.alias("harm")).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return read.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _schema(df: DataFrame) -> str:
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, piece int, pieces int, {counts}, edits string, turns array<struct<role: string, text: string>>"


def _batch(kind: pa.DataType, rows: list[tuple], turns: list[tuple[list[str], list[str]]]) -> pa.RecordBatch:
    """Rows of (conv_id, piece, pieces, counts..., edits) with their turns."""
    offsets, roles, texts = [0], [], []
    for r, t in turns:
        roles += r
        texts += t
        offsets.append(len(roles))
    inner = pa.StructArray.from_arrays([pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["role", "text"])
    kinds = [kind, pa.int32(), pa.int32(), *[pa.int64()] * len(COUNTS), pa.string()]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], ["conv_id", "piece", "pieces", *COUNTS, "edits", "turns"])


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def _initial(role: str) -> str:
    return role[:1] or "-"


def repair_whole(turns: DataFrame) -> DataFrame:
    """`repair` for conversations that a task can hold: one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        turns_: list[tuple[list[str], list[str]]] = []
        group: list[tuple] = []
        size, kind = 0, None

        def close() -> None:
            seen: set[tuple[str, str]] = set()
            faults, codes = [], []
            for _, _, role, text in group:
                fault, code = coded(role, text, (role, text) in seen)
                seen.add((role, text))
                faults.append(fault)
                codes.append(code)
            cost, audit = cheapest("".join(codes))
            stamps = {t for _, t, _, _ in group if t is not None}
            gaps = max(stamps) - min(stamps) + 1 - len(stamps) if stamps else 0
            rows.append((group[0][0], 0, 1, gaps, *map(faults.count, "bdt"), _illegal("".join([_initial(x[2]) for x in group])), cost, audit))
            turns_.append(edited(audit, [x[2:] for x in group])[:2])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    close()
                    group = []
                    if size > PIECE_BYTES:
                        yield _batch(kind, rows, turns_)
                        rows, turns_, size = [], [], 0
                group.append(row)
                size += len(row[3]) + 64
        if group:
            close()
            yield _batch(kind, rows, turns_)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return bounded_batches(ordered).mapInArrow(run, _schema(turns))


def segments(turns: DataFrame) -> DataFrame:
    """Stretches of long conversations in order of (part, seq): counts, codes, ends, edges and the rows."""
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("digest", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    rows = rows.select("conv_id", "turn", "role", "text", "copies", F.col("turn").eqNullSafe(F.col("first")).alias("fresh"))
    order = ("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    edge = "array<struct<s: int, cost: long, letters: string, t: int>>"
    schema = f"conv_id {kind}, part int, seq int, low long, high long, stamps long, blank long, duplicate long, truncated long, illegal long, first string, last string, codes string, edges {edge}, roles array<string>, texts array<string>, copies array<long>"
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", re.sub(r"struct<[^>]*>", "struct", schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, group, size, count = TaskContext.get().partitionId(), 0, [], 0, 0

        def close(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            faults, codes = [], []
            for _, _, role, text, copies, fresh in group:
                fault, code = coded(role, text, not fresh)
                again, code_again = coded(role, text, True)
                faults += [fault, *[again] * (copies - 1)]
                codes.append(code + code_again * (copies - 1))
            initials = "".join([_initial(r[2]) * r[4] for r in group])
            stamps = [r[1] for r in group if r[1] is not None]
            edges = [{"s": s, "cost": c, "letters": a, "t": t} for s, some in _stretched("".join(codes)).items() for c, a, t in some]
            low, high = (stamps[0], stamps[-1]) if stamps else (None, None)
            values = [group[0][0], part, seq, low, high, len(set(stamps)), *map(faults.count, "bdt"), _illegal(initials), initials[0], initials[-1], "".join(codes), edges]
            values += [[r[2] for r in group], [r[3] for r in group], [r[4] for r in group]]
            long, text = pa.int64(), pa.string()
            kinds = [kind, pa.int32(), pa.int32(), *[long] * 7, text, text, text, pa.list_(pa.struct([("s", pa.int32()), ("cost", long), ("letters", text), ("t", pa.int32())])), pa.list_(text), pa.list_(text), pa.list_(long)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (row[0] != group[0][0] or size > PIECE_BYTES or count > 8 * SEGMENT):
                    yield close(kind)
                    group, size, count = [], 0, 0
                group.append(row)
                size += len(row[3])
                count += row[4]
        if group:
            yield close(kind)

    return bounded_batches(rows.repartitionByRange(*order).sortWithinPartitions(*order)).mapInArrow(run, schema)


def _stretched(codes: str) -> dict[int, list[Edge]]:
    """The edges of a stretch of any length."""
    parts = [stretch(codes[i : i + SEGMENT]) for i in range(0, len(codes), SEGMENT)]
    while len(parts) > 1:
        group, parts = parts[:FAN], parts[FAN:]
        over = lambda i, s, g=group: ((c, a, i + 1, t) for c, a, t in g[i][s]) if i < len(g) else iter(())
        parts.insert(0, {s: [(c, a, t) for t, (c, a) in search(len(group), over, s).items()] for s in GIVEN})
    return parts[0]


def repair_long(turns: DataFrame) -> DataFrame:
    """`repair` for conversations of any length, in pieces."""
    cut = stored(segments(turns), "segments")
    conv = turns.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    fields = ("conv_id", "part", "seq", "low", "high", "stamps", "blank", "duplicate", "truncated", "illegal", "first", "last", "codes", "edges")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []

        def close(kind: pa.DataType) -> pa.RecordBatch:
            cost, audit = solved([_by_state(x["edges"]) for x in group])
            known = [x for x in group if x["low"] is not None]
            shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
            gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(x["stamps"] for x in known) + shared if known else 0
            illegal = sum(x["illegal"] for x in group) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(group, group[1:], strict=False))
            total = (gaps, *(sum(x[c] for x in group) for c in ("blank", "duplicate", "truncated")), illegal, cost)
            rows, at, state = [], 0, 0
            for piece, x in enumerate(group):
                begun, left = at, len(x["codes"])
                while at < len(audit) and (left or piece == len(group) - 1):
                    left -= audit[at] != "I"
                    at += 1
                rows.append((group[0]["conv_id"], x["part"], x["seq"], piece, len(group), *total, audit[begun:at], state))
                state = _state_after(audit[begun:at], x["codes"], state)
            kinds = (kind, *[pa.int32()] * 4, *[pa.int64()] * len(COUNTS), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "part", "seq", "piece", "pieces", *COUNTS, "edits", "state"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if group and row["conv_id"] != group[0]["conv_id"]:
                    yield close(kind)
                    group = []
                group.append(row)
        if group:
            yield close(kind)

    ordered = cut.select(*fields).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    decided = bounded_batches(ordered).mapInArrow(decide, f"conv_id {conv}, part int, seq int, piece int, pieces int, {counts}, edits string, state int")

    def carry_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for x in batch.to_pylist():
                rows = [(role, text) for role, text, n in zip(x["roles"], x["texts"], x["copies"], strict=True) for _ in range(n)]
                row = (x["conv_id"], x["piece"], x["pieces"], *(x[c] for c in COUNTS), x["edits"])
                yield _batch(kind, [row], [edited(x["edits"], rows, x["state"])[:2]])

    return decided.join(cut.select("part", "seq", "roles", "texts", "copies"), ["part", "seq"]).mapInArrow(carry_out, _schema(turns))


def _by_state(edges: list[dict]) -> dict[int, list[Edge]]:
    out: dict[int, list[Edge]] = {s: [] for s in GIVEN}
    for e in edges:
        out[e["s"]].append((e["cost"], e["letters"], e["t"]))
    return out


def _state_after(audit: str, codes: str, state: int) -> int:
    at = 0
    for letter in audit:
        if letter == "K":
            state = KEPT[state, codes[at].lower()]
        elif letter != "D":
            state = GIVEN[state][1]
        at += letter != "I"
    return state


def _parts(turns: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """`repair` of the conversations that a task can hold, and of the long ones, if there are any."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    turns = named(turns, "conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("long").alias("turn"), *filled)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long = stored(sizes.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select(F.col("conv_id").alias("c")), "long-conversations")
    if long.isEmpty():
        deleted(turns.sparkSession, long)
        return repair_whole(turns), None
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return repair_whole(turns.join(long, same, "left_anti")), repair_long(turns.join(long, same, "left_semi"))


def repair(turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Per conversation of turns(conv_id, turn, role, text): its faults, the cost and the audit (`edits`) of its cheapest repair, and the repaired turns.

    A long conversation comes in `pieces`, each with its own part of the audit and of the turns and the counts of the whole.
    """
    whole, long = _parts(turns, long_rows, long_bytes)
    return whole.union(long) if long else whole


def reports(original: DataFrame, turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """For every conv_id of original: the counts of `repair` of turns, audit and repaired_sha256 (repaired `role:text` by newlines); pieces are hashed one after the other."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    whole, long = _parts(turns, long_rows, long_bytes)
    found = whole.select("conv_id", *COUNTS, F.col("edits").alias("audit"), F.sha2(lines, 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, edits, any_ = hashlib.sha256(), [], False
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for x in batch.to_pylist():
                if x["some"]:
                    hashed.update((b"\n" if any_ else b"") + x["lines"].encode())
                    any_ = True
                edits.append(x["edits"])
                if x["piece"] == x["pieces"] - 1:
                    row = [x["conv_id"], *(x[c] for c in COUNTS), "".join(edits), hashed.hexdigest()]
                    kinds = (kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])
                    hashed, edits, any_ = hashlib.sha256(), [], False

    if long:
        several = long.select("conv_id", "piece", "pieces", *COUNTS, "edits", (F.size("turns") > 0).alias("some"), lines.alias("lines"))
        ordered = several.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
        found = found.union(bounded_batches(ordered).mapInArrow(run, found.schema))
    found = found.withColumnRenamed("conv_id", "c")
    ids = named(original, "conv_id").select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )


def oracle_sql() -> str:
    """DuckDB SQL for the reports of the damaged conversations: a recursion over rows that holds the best label (cost and audit as one string, and the lines made) of each state."""

    def label(old: str, cost: str, letter: str, line: str | None) -> str:
        key = f"lpad(CAST(CAST(substr({old}.k, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({old}.k, 10) || '{letter}'"
        return f"CASE WHEN {old} IS NOT NULL THEN struct_pack(k := {key}, m := {f'list_append({old}.m, {line})' if line else f'{old}.m'}) END"

    def best(options: list[str]) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"

    def past_row(state: int) -> str:
        own = "CASE WHEN r.gone THEN NULL ELSE {} END".format
        options = [label(f"p.s{state}", "4", "D", None)]
        for (before, initial), after in KEPT.items():
            if after == state:
                options.append(own(f"CASE WHEN r.role[1] = '{initial}' THEN {label(f'p.s{before}', 'r.extra', 'K', chr(39) * 2 + ' || r.line')} END"))
        for before, (role, after) in GIVEN.items():
            if after == state:
                options.append(own(label(f"p.s{before}", "(3 + r.extra)", "R", f"'{role}:' || r.text")))
        return f"{best(options)} AS s{state}"

    white = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    given = lambda s: label(f"s{s}", "3", "I", f"'{GIVEN[s][0]}:'")
    first = best(["s2", *(given(s) for s in (0, 1, 3))])
    grown = f"SELECT conv_id, i, s0, s1, s2, {best(['s3', given(2)])} AS s3 FROM (SELECT conv_id, i, s0, s1, {first} AS s2, s3 FROM ({{}}))"
    kind = "STRUCT(k VARCHAR, m VARCHAR[])"
    start = f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'k': '000000000', 'm': []}} AS {kind}) AS s0, CAST(NULL AS {kind}) AS s1, CAST(NULL AS {kind}) AS s2, CAST(NULL AS {kind}) AS s3 FROM placed"
    step_rows = f"SELECT p.conv_id, r.i, {', '.join(past_row(s) for s in GIVEN)} FROM path p JOIN placed r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1"
    return f"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS named FROM conversations),
harmed AS (SELECT *, {crc32_sql("named")} % 20 AS harm FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS again FROM harmed WHERE harm <> 0),
numbered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen, rtrim(text, {white}) AS body FROM damaged),
placed AS (
  SELECT conv_id, turn, role, text, i, concat(role, ':', text) AS line, body = '' OR seen AS gone, body = '' AS blank, body <> '' AND seen AS duplicate,
    body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, CASE WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE {TRUNCATED_COST} END AS extra,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM numbered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND concat(earlier[1], role[1]) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM placed GROUP BY conv_id),
path AS ({grown.format(start)} UNION ALL {grown.format(step_rows)}),
ended AS (SELECT p.conv_id, {best(['s0', 's3'])} AS s FROM path p JOIN counted c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(s.k, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(s.k, 10), '') AS audit, sha256(coalesce(array_to_string(s.m, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""
