"""Approximate nearest neighbours by NN-descent.

Vectors that are equal are one node. A first graph links each node to the best of its neighbours along a few random
projections (range-partitioned, cut into blocks of fixed size, so that no group of near-equal vectors makes a block larger). Rounds then join
neighbours with neighbours: every node gathers its neighbours and a bounded sample of the nodes that list it, scores them
against each other where at least one is new, and sends each the best of what beats its worst neighbour. Queries start at their own
node and search the graph greedily: the best unexpanded nodes of a beam are expanded until none is left in it. Rounds of joins end when
at most DELTA of the edges are new.

Nearness is the largest inner product. The graph is built on vectors of 8-bit components with a scale each; scores that are returned are of
the original vectors, in double precision.

Defined results: rows whose vector is null, empty, all zero or holds a null or non-finite component, or
whose vec_id is null, take no part; a vector shorter than the longest counts as followed by zeros; repeated vec_ids count once (the first of their vectors in order); ties go to the smaller vec_id; with fewer candidates than k, all are
returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, deleted, dropped, stored

K = 20
DEGREE = 32
BLOCK = 1024
PROJECTIONS = 8
DELTA = 0.001
OFFERS = 10
BEAM, BEAM_STEP = 192, 12
EXPAND = 96


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, -0.0 as 0.0 so that equal vectors are the same bytes) of the rows that take part, each vec_id once.

    Vectors shorter than the longest are followed by zeros, which changes no inner product.
    """
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    wide = rows.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("embedding"))
    good = (
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    wide = wide.where(F.coalesce(good, F.lit(False)))
    longest = wide.agg(F.max(F.size("embedding"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("embedding"))
    return wide.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("embedding", F.concat("embedding", zeros))


def quantised(vectors: np.ndarray) -> list[bytes]:
    """Each vector as a 32-bit scale and 8-bit components."""
    scale = (np.abs(vectors).max(axis=1) / 127).astype("<f4")
    scale[scale == 0] = np.finfo(np.float32).tiny
    small = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, small, strict=True)]


def restored(column: pa.Array) -> np.ndarray:
    """Vectors of a binary column of quantised(), as 32-bit floats."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return raw[:, 4:].view(np.int8) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def wide(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def node_table(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """Nodes: id (smallest vec_id of a vector), members (its k + 1 smallest vec_ids), full and q (binary) and PROJECTIONS projections."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.withColumn("rn", rank).where(F.col("rn") <= k + 1)
    nodes = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype("<f8")
            axes = np.random.default_rng(seed).standard_normal((v.shape[1], PROJECTIONS))
            p = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ axes
            members = batch.column("members")
            ids = [x[0].as_py() for x in members]
            columns = [pa.array(ids, pa.int64()), members, pa.array([x.tobytes() for x in v], pa.binary()), pa.array(quantised(v), pa.binary()), *(pa.array(np.ascontiguousarray(x)) for x in p.T)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "members", "full", "q", *(f"p{i}" for i in range(PROJECTIONS))])

    kinds = "id long, members array<long>, full binary, q binary" + "".join(f", p{i} double" for i in range(PROJECTIONS))
    return bounded_batches(nodes).mapInArrow(run, kinds)


def top_pairs(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of scores the n best columns that are over -inf: (row id, column id, score)."""
    n = min(n, scores.shape[1])
    best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    got = np.take_along_axis(scores, best, axis=1)
    row, column = np.nonzero(got > -np.inf)
    return ids[row], ids[best[row, column]], got[row, column]


def _edges(a: list[np.ndarray], b: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(s).astype(np.float32))], ["a", "b", "s"])


def _blocks(degree: int, block: int):
    """Best pairs within runs of at most block rows of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = np.zeros(0, np.int64), None

        def joined(ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            scores = q @ q.T
            np.fill_diagonal(scores, -np.inf)
            a, b, s = top_pairs(ids, scores, degree)
            return _edges([a], [b], [s])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            more = restored(batch.column("q"))
            q = more if q is None else np.concatenate([q, more])
            while len(ids) >= 2 * block:
                yield joined(ids[:block], q[:block])
                ids, q = ids[block:], q[block:]
        if len(ids):
            yield joined(ids, q)

    return run


def _local_join(offers: int):
    """Scores of each node's gathered neighbours against each other; each is offered the best of those that beat its worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s = [], [], []
            pools = batch.column("pool")
            offsets, flat = pools.offsets.to_numpy(), pools.values
            if not len(flat):
                continue
            ids, new, worst = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("m", "new", "worst"))
            q = restored(flat.field("q"))
            for x, y in zip(offsets, offsets[1:], strict=False):
                if y - x < 2 or not new[x:y].any():
                    continue
                scores = q[x:y] @ q[x:y].T
                fresh = new[x:y].astype(bool)
                scores[~(fresh[:, None] | fresh[None, :]) | (scores <= worst[x:y, None]) | (ids[x:y, None] == ids[None, x:y])] = -np.inf
                for out, got in zip((a, b, s), top_pairs(ids[x:y], scores, offers), strict=True):
                    out.append(got)
            if a:
                yield _edges(a, b, s)

    return run


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The degree best neighbours of each node of edges(a, b, s, new); an edge that is there twice stays the older one."""
    once = edges.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return once.withColumn("rn", rank).where(F.col("rn") <= degree).drop("rn")


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int | None = None, block: int = BLOCK, offers: int = OFFERS) -> DataFrame:
    """(a, b, s): each node's best neighbours found; rounds, if given, are the most that are run."""
    first = None
    for i in range(PROJECTIONS):
        ordered = nodes.select("id", "q", f"p{i}").repartitionByRange(f"p{i}").sortWithinPartitions(f"p{i}").drop(f"p{i}")
        some = ordered.mapInArrow(_blocks(degree, block), "a long, b long, s float")
        first = some if first is None else first.union(some)
    graph = stored(_best(first.withColumn("new", F.lit(True)), degree), "graph")
    for i in itertools.count() if rounds is None else range(rounds):
        worst = graph.groupBy("a").agg(F.when(F.count("*") >= degree, F.min("s")).alias("worst"))
        known = nodes.select("id", "q").join(worst, F.col("id") == F.col("a"), "left").select(F.col("id").alias("m"), "q", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        back = graph.select(F.col("b").alias("c"), F.col("a").alias("m"), "new")
        turn = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("new"), F.xxhash64(F.lit(i), "m"), "m"))
        back = back.withColumn("rn", turn).where(F.col("rn") <= degree).drop("rn")
        members = graph.select(F.col("a").alias("c"), F.col("b").alias("m"), "new").union(back).groupBy("c", "m").agg(F.max("new").alias("new"))
        pools = members.join(known, "m").groupBy("c").agg(F.collect_list(F.struct("m", "new", "worst", "q")).alias("pool")).select("pool")
        found = bounded_batches(pools).mapInArrow(_local_join(offers), "a long, b long, s float")
        done = stored(_best(graph.withColumn("new", F.lit(False)).union(found.withColumn("new", F.lit(True))), degree), "graph")
        dropped(graph.sparkSession, graph)
        graph = done
        fresh, edges = graph.agg(F.count_if("new"), F.count("*")).first()
        if fresh <= DELTA * edges:
            break
    return graph.select("a", "b", "s")


def adjacency(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(a, near): each node's neighbours with their vectors."""
    near = graph.join(nodes.select(F.col("id").alias("b"), "q"), "b")
    return near.groupBy("a").agg(F.collect_list(F.struct("b", "q")).alias("near"))


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the expanded nodes' neighbours that beat a query's worst."""
    for batch in batches:
        if not batch.num_rows:
            continue
        near = batch.column("near")
        row = np.repeat(np.arange(len(near)), np.diff(near.offsets.to_numpy()))
        flat = near.flatten()
        s = np.einsum("ij,ij->i", restored(batch.column("qq"))[row], restored(flat.field("q")))
        good = s > batch.column("worst").to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("query_id").to_numpy()[row][good]), pa.array(flat.field("b").to_numpy()[good]), pa.array(s[good].astype(np.float32))], ["query_id", "node", "s"])


def search(near: DataFrame, queries: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(query_id, node, s): the beam of each query(query_id, start, qq) after a greedy search from node start; s by 8-bit components."""
    spark = near.sparkSession
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "node"))
    ahead = F.row_number().over(Window.partitionBy("query_id", "expanded").orderBy(F.desc("s"), "node"))
    state = stored(queries.select("query_id", F.col("start").alias("node"), F.lit(float("inf")).cast("float").alias("s"), F.lit(False).alias("expanded")), "beam")
    while True:
        turned = state.withColumn("turn", ahead).withColumn("now", ~F.col("expanded") & (F.col("turn") <= expand)).drop("turn")
        worst = state.groupBy("query_id").agg(F.when(F.count("*") >= beam, F.min("s")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        asked = queries.select("query_id", "qq").join(worst, "query_id")
        front = turned.where("now").select("query_id", F.col("node").alias("a")).join(asked, "query_id").join(near, "a")
        fresh = bounded_batches(front.select("query_id", "qq", "worst", "near")).mapInArrow(_expanded, "query_id long, node long, s float")
        every = turned.select("query_id", "node", "s", (F.col("expanded") | F.col("now")).alias("expanded")).union(fresh.withColumn("expanded", F.lit(False)))
        once = every.repartition("query_id").groupBy("query_id", "node").agg(F.max("s").alias("s"), F.max("expanded").alias("expanded"))
        done = stored(once.withColumn("rn", best).where(F.col("rn") <= beam).drop("rn"), "beam")
        dropped(spark, state)
        state = done
        if not state.where("not expanded").limit(1).count():
            break
    return state.select("query_id", "node", "s")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s = np.einsum("ij,ij->i", wide(batch.column("query")), wide(batch.column("full")))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("members"), pa.array(s)], ["query_id", "members", "s"])


def nearest(rows: DataFrame, is_query: Column, k: int = K, degree: int = DEGREE, rounds: int | None = None, beam: int | None = None, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which is_query holds, among all others.

    beam: BEAM, or BEAM_STEP for each doubling of the nodes where that is more.
    """
    vectors = valid_vectors(rows)
    nodes = stored(node_table(vectors, k, seed), "nodes")
    beam = beam or max(BEAM, BEAM_STEP * nodes.count().bit_length())
    graph = neighbour_graph(nodes, degree, rounds)
    asked = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    whole = nodes.select(F.col("id").alias("start"), "full", "q")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype("<f8") if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([x.tobytes() for x in v], pa.binary())], ["query_id", "full"])

    queries = stored(asked.mapInArrow(packed, "query_id long, full binary").join(whole, "full").select("query_id", "start", F.col("full").alias("query"), F.col("q").alias("qq")), "queries")
    near_nodes = stored(adjacency(nodes, graph), "adjacency")
    deleted(rows.sparkSession, graph)
    found = search(near_nodes, queries, beam)
    deleted(rows.sparkSession, near_nodes)
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "node"))
    few = found.withColumn("rn", near).where(F.col("rn") <= 2 * k + 8).select("query_id", "node")
    exact = few.join(queries.select("query_id", "query"), "query_id").join(nodes.select(F.col("id").alias("node"), "full", "members"), "node")
    scored = bounded_batches(exact.select("query_id", "query", "full", "members")).mapInArrow(_scored, "query_id long, members array<long>, s double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    listed = scored.select("query_id", "s", F.explode("members").alias("vec_id")).where("query_id <> vec_id")
    top = listed.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("s").alias("score"))
