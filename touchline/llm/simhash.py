"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of equal texts are equal, so links are searched between distinct fingerprints. Four differing bits over
three segments leave one segment with at most one of them: each fingerprint is indexed under every segment with every one of its
bits as a wildcard (64 keys), equal keys meet in a sorted shuffle, and pairs are verified. A key with more than ``small_key``
fingerprints is not paired: its members are marked, and marked fingerprints meet under every value within two bits of
them instead. Two of them share such a value exactly if they differ by four bits at most, so that a star to the
smallest of each value gives all their components without pairs, however many there are.

Defined results: null and blank text have fingerprint zero, linked like any other; fewer words than a shingle: one shingle of
the whole sequence; repeated rows and equal doc_ids share a component; a null doc_id never names a component with other members;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, fresh, named, small_batches, stored

WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SMALL_KEY = 4096


def shingle_hashes(text: str | None, n: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of a text's ASCII-lower-cased words."""
    words = (text or "").encode().lower().split()
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words])
    starts = [0, *ends[:-n].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if over half the shingles have it."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text)
        if len(hashes):
            votes = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 1 << 16):
                votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs with fp, the fingerprint's 64 bits as a long."""
    kept = bounded_batches(named(docs, "text").drop("fp"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            fp = fingerprints(batch.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, "fp"])

    return kept.mapInArrow(run, f"{kinds}, fp long")


def segment_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 64) keys: the segment of each bit with that bit left out, and the bit's number above it."""
    keys = np.empty((len(fp), 64), np.int32)
    for start, width in SEGMENTS:
        part = (fp >> np.uint64(start)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            keys[:, start + bit] = (part & ~np.uint64(1 << bit)).astype(np.int32) | ((start + bit) << 22)
    return keys


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(segment_keys(fp.view(np.uint64)).ravel()), pa.array(np.repeat(fp, 64))], ["key", "fp"])


def forest(fp: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between the fingerprints of one key."""
    left, a, b = fp.copy(), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                found = left[near]
                a += [int(one)] * len(found)
                b += found.tolist()
                frontier += list(found)
                left = left[~near]
    return a, b


def links_of_keys(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within runs of equal keys: all of short runs, a spanning forest of longer ones."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(edge, len(key)))
    a, b = [], []
    short = np.repeat(size <= 8, size)
    for lag in range(1, 8):
        at = np.flatnonzero(short[:-lag] & (key[:-lag] == key[lag:])) if len(key) > lag else np.zeros(0, int)
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= distance]
        a.append(fp[at])
        b.append(fp[at + lag])
    for start, n in zip(edge[size > 8], size[size > 8], strict=True):
        x, y = forest(fp[start : start + n], distance)
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _paired(distance: int, small_key: int):
    """Rows sorted by key in; links out, and members of larger keys marked by a null b. Holds one small key and one batch."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        if b is not None:
            ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(ab[0].view(np.int64)), pa.array(ab[1].view(np.int64))], ["a", "b"])
        a = np.unique(a)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot = np.zeros(0, np.int32), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if hot is not None and len(key):
                n = int(np.searchsorted(key, hot, "right"))
                if n:
                    yield out(fp[:n], None)
                key, fp = key[n:], fp[n:]
                hot = None if len(key) else hot
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            yield from settled(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            if len(key) > small_key:
                yield out(fp, None)
                hot, key, fp = key[0], key[:0], fp[:0]
        yield from settled(key, fp)

    def settled(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        large = np.repeat(size > small_key, size)
        if large.any():
            yield out(fp[large], None)
            key, fp = key[~large], fp[~large]
        yield out(*links_of_keys(key, fp, distance))

    return run


def _ball(radius: int):
    """Every value within radius bits of a fingerprint."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << i) for m in masks for i in range(64)}
    flips = np.array(sorted(masks), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fp), 64):
                some = fp[at : at + 64]
                near = (some[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], ["near", "fp"])

    return run


def fingerprint_links(fps: DataFrame, small_key: int = SMALL_KEY, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fps(fp) that connect exactly those of each component of links.

    distance: four, or less (the segments are made for four); even, as marked fingerprints meet within half of it.
    """
    if distance not in (0, 2, 4):
        raise ValueError("distance must be 0, 2 or 4")
    keys = fps.select("fp").mapInArrow(_variants, "key int, fp long")
    found = stored(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_paired(distance, small_key), "a long, b long"), "links")
    links = found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    marked = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    near = marked.mapInArrow(_ball(distance // 2), "near long, fp long")
    least = near.groupBy("near").agg(F.min("fp").alias("m"))
    stars = near.join(least, "near").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v"))
    return links.union(stars)


def near_duplicates(docs: DataFrame, small_key: int = SMALL_KEY, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of each row of docs; component_id is the smallest doc_id reachable."""
    from touchline.llm.components import components

    marks = stored(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "fingerprints")
    fps = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(fingerprint_links(fps, small_key, distance))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(names, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of the smallest doc_id, and of its rows the one with the smallest text."""
    from pyspark.sql import Window

    kept, nth = fresh(docs, "_kept", "_nth")
    chosen = near_duplicates(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias(kept)).distinct()
    first = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).orderBy("text"))
    return docs.join(chosen, docs["doc_id"].eqNullSafe(F.col(kept)), "left_semi").withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
