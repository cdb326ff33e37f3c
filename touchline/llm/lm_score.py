"""LM scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background (all other documents), share one vocabulary: every word of all documents. p(w | v)
mixes the bigram share with the add-one unigram share in the same way in both. A document's score is the mean over its tokens of the target loss
less the background loss: lower is nearer to the target. A document is scored by counts without its own (leave one out), so that it does not
look likely to the model just because it was counted.

Documents are packed into chunks of CHUNK_BYTES, each with words numbered for itself. A chunk sends its distinct words and bigrams, as 64-bit hashes with
counts; a shuffle by hash sums them and sends the sums back to the chunks that asked, where documents are scored. So what is shuffled is each chunk's distinct
words and bigrams, not every token; no table of the corpus's or the vocabulary's size is
broadcast or comes to the driver; a frequent bigram occurs as often as there are chunks, and a task holds one chunk. Hashes travel in buckets of equal leading
bits, as many as make RUN hashes a bucket, sorted and packed as differences in byte planes: some six bytes each. Back go only the sums, in the same order.

Defined results: null and blank text has no tokens and null losses; documents that repeat are scored each, and counted each; a doc_id that is null is never a target; without a
target (or background) document its model is the uniform one; other columns are not read; an empty table gives no rows; a text longer than a chunk is a chunk.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, small_batches, stored

MIX = 0.6
CHUNK_BYTES = 8 << 20
WORDS, PAIRS = 0, 1
START = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line feed
CHUNK = "chunk long, doc_ids array<long>, targets array<boolean>, sizes array<int>, ids binary, words binary"
COUNTS = "bucket long, chunk long, packed binary"
SUMS = "chunk long, packed binary"
RUN, TOGETHER = 1 << 18, 1 << 21
SMALL_TARGETS = 250_000


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of 64-bit whole numbers as one string: their lengths, then all in byte planes, compressed."""
    planes = [np.asarray(x).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns]
    return np.array([len(x) for x in columns], "<u4").tobytes() + zstandard.compress(b"".join(planes), 1)


def unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    """The n arrays of packed()."""
    sizes = np.frombuffer(raw, "<u4", n)
    body, ends = zstandard.decompress(raw[4 * n :]), 8 * np.cumsum(sizes.astype(np.int64))
    return [np.array(np.frombuffer(body[e - 8 * int(m) : e], np.uint8).reshape(8, -1).T, order="C").view("<u8").ravel() for e, m in zip(ends.tolist(), sizes, strict=True)]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def bucketed(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of sorted hashes, and where each begins and how many hashes it has."""
    bucket = (codes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(codes), np.int64)
    found, first, sizes = np.unique(bucket, return_index=True, return_counts=True)
    return found, first, sizes


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _packed(size: int):
    """Documents (doc_id, target, text) in, chunks out: local ids of the words of each and the hashes of the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        rows, held, seq = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal numbers, rows, held, seq
            doc_ids, targets, ids = zip(*rows, strict=True)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            columns = [[seq], [doc_ids], [targets], [[len(x) for x in ids]], [zstandard.compress(np.concatenate(ids).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)], [hashes.tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            numbers, rows, held, seq = defaultdict(count().__next__), [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["chunk", "doc_ids", "targets", "sizes", "ids", "words"])

        for batch in small_batches(batches, "text", 2 << 20):
            for doc_id, target, text in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "target", "text")), strict=True):
                own = words_of(text)
                if rows and held + len(text or "") > size:
                    yield out()
                rows.append((doc_id, target, np.fromiter(map(numbers.__getitem__, own), "<i4", len(own))))
                held += len(text or "") + 64
        if rows:
            yield out()

    return run


def packed_chunks(docs: DataFrame, targets: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of docs(doc_id, text), stored; a document whose doc_id is in targets is a target."""
    wanted = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    if wanted.count() <= SMALL_TARGETS:  # some 30 MB as a hash table; more are joined by a shuffle of both sides
        wanted = F.broadcast(wanted)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left")
    marked = marked.select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    return stored(bounded_batches(marked).mapInArrow(_packed(size), CHUNK), "chunks")


class Chunk:
    """A chunk as arrays. Tokens: w, the word; v, the word before it (len(words) at a start); pair, the number of (v, w); doc, the document."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.targets, sizes = row["doc_ids"], np.array(row["targets"], bool), np.array(row["sizes"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.w = np.array(np.frombuffer(zstandard.decompress(row["ids"]), np.uint8).reshape(4, -1).T, order="C").view("<i4").ravel().astype(np.int64)
        self.sizes, n = sizes, len(self.words)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.v = np.concatenate([[n], self.w[:-1]]) if len(self.w) else self.w
        self.v[(np.cumsum(sizes) - sizes)[sizes > 0]] = n
        self.pairs, self.pair = np.unique(self.v * (n + 1) + self.w, return_inverse=True)
        hashes = np.append(self.words, START)
        self.codes = mixed(hashes[self.pairs // (n + 1)], hashes[self.pairs % (n + 1)])

    def counted(self, at: np.ndarray, n: int) -> np.ndarray:
        """(2, n): how often each number occurs in target and in background documents."""
        target = self.targets[self.doc]
        return np.stack([np.bincount(at[target], minlength=n), np.bincount(at[~target], minlength=n)])

    def known(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct words, a start at last, or pairs, and their counts."""
        if kind == PAIRS:
            return self.codes, self.counted(self.pair, len(self.codes))
        starts = (self.sizes > 0) & np.stack([self.targets, ~self.targets])
        return np.append(self.words, START), np.concatenate([self.counted(self.w, len(self.words)), starts.sum(axis=1, keepdims=True)], axis=1)

    def own(self, at: np.ndarray, n: int) -> np.ndarray:
        """For each token, how often its number occurs in its document."""
        _, inverse, counts = np.unique(self.doc * n + at, return_inverse=True, return_counts=True)
        return counts[inverse]


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair of hashes."""
    with np.errstate(over="ignore"):
        x = v * np.uint64(0x9E3779B97F4A7C15) + w
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _counts(kind: int, bits: int):
    """Chunks in; (bucket, chunk, packed) of their distinct words, starts included, or pairs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, n = Chunk(row).known(kind)
                by = np.argsort(codes, kind="stable")
                codes, n = codes[by], n[:, by]
                bucket, first, sizes = bucketed(codes, bits)
                parts = [packed(np.diff(codes[a : a + m], prepend=np.uint64(0)), n[0, a : a + m], n[1, a : a + m]) for a, m in zip(first, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(np.full(len(parts), row["chunk"])), pa.array(parts, pa.binary())], ["bucket", "chunk", "packed"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket in; out for each chunk its buckets and the sums of their hashes in order, packed, and under chunk -1 the number of words and of
    their occurrences. Holds the rows of one bucket, or of several up to TOGETHER hashes."""

    def out(held: list[tuple[int, int, list[np.ndarray]]]) -> pa.RecordBatch:
        chunks, sizes = np.array([x[1] for x in held]), np.array([len(x[2][0]) for x in held])
        code, *n = (np.concatenate([x[2][k] for x in held]) for k in range(3))
        by = np.argsort(code, kind="stable")
        ordered = code[by]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        at, edge = np.empty(len(code), np.int64), np.flatnonzero(first)
        at[by] = np.cumsum(first) - 1
        sums = [np.add.reduceat(x[by].astype(np.int64), edge) for x in n]
        word = ordered[edge] != START
        total = " ".join(str(x) for x in (word.sum(), sums[0][word].sum(), sums[1][word].sum())).encode()
        starts = np.cumsum(sizes) - sizes
        own = np.argsort(chunks, kind="stable")
        names, begin = np.unique(chunks[own], return_index=True)
        parts = []
        for rows in np.split(own, begin[1:]):
            back = at[runs(starts[rows], sizes[rows])]
            parts.append(packed(np.array([held[i][0] for i in rows]), sums[0][back], sums[1][back]))
        return pa.RecordBatch.from_arrays([pa.array([*names.tolist(), -1], pa.int64()), pa.array([*parts, total], pa.binary())], ["chunk", "packed"])

    held, size, last = [], 0, None
    for batch in batches:
        for bucket, chunk, raw in zip(*(batch.column(x).to_pylist() for x in ("bucket", "chunk", "packed")), strict=True):
            if bucket != last and size > TOGETHER:
                yield out(held)
                held, size = [], 0
            steps, nt, nb = unpacked(raw, 3)
            held.append((bucket, chunk, [np.cumsum(steps, dtype=np.uint64), nt, nb]))
            size, last = size + len(nt), bucket
    if held:
        yield out(held)


def summed(chunks: DataFrame, kind: int, bits: int) -> DataFrame:
    """(chunk, packed) sums of the words or pairs of each chunk, and totals under chunk -1; bits: leading bits of a bucket."""
    rows = bounded_batches(chunks).mapInArrow(_counts(kind, bits), COUNTS)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed, SUMS)


def totals(words: DataFrame) -> tuple[int, int, int]:
    """Distinct words, and words in all of the target and of the background; one row for each run of buckets is added up here."""
    number = lambda i: F.split(F.col("packed").cast("string"), " ")[i].cast("long")
    row = words.where("chunk = -1").agg(*[F.sum(number(i)) for i in range(3)]).first()
    return tuple(x or 0 for x in row)


def losses(pair: np.ndarray, history: np.ndarray, word: np.ndarray, total: np.ndarray, vocabulary: int, mix: float) -> np.ndarray:
    """-ln p(w | v) by these counts of (v, w), v and w in a corpus of total words."""
    plain = (word + 1) / (total + vocabulary)
    return -np.log(np.where(history > 0, mix * pair / np.maximum(history, 1) + (1 - mix) * plain, plain))


def _corrected(codes: np.ndarray, own: np.ndarray, replies: list[bytes], bits: int) -> np.ndarray:
    """(2, n) sums of codes that came back for each of their buckets, in order."""
    out, by = own.copy(), np.argsort(codes, kind="stable")
    found, first, sizes = bucketed(codes[by], bits)
    for raw in replies:
        buckets, nt, nb = unpacked(raw, 3)
        at = np.searchsorted(found, buckets.astype(np.int64))
        out[:, by[runs(first[at], sizes[at])]] = nt, nb
    return out


def _score_chunk(sizes: tuple[int, int, int], bits: int, mix: float):
    vocabulary, *everything = sizes

    def run(chunks: pa.Table, model: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_tokens": [], "target_loss": [], "background_loss": []}
        for row in chunks.to_pylist():
            chunk = Chunk(row)
            replies = list(zip(model.column("kind").to_pylist(), model.column("packed").to_pylist(), strict=True))
            words, pairs = (_corrected(*chunk.known(kind), [x for k, x in replies if k == kind], bits) for kind in (WORDS, PAIRS))
            n = len(chunk.words) + 1
            own_pair, own_word = chunk.own(chunk.pair, len(chunk.codes)), chunk.own(chunk.w, n)
            first = np.concatenate([[0], own_word[:-1]]) if len(own_word) else own_word
            # what the document itself adds to its history's count: that word's count in it, or one start
            own_history = np.where(chunk.v == n - 1, 1, first)
            target, length = chunk.targets[chunk.doc], chunk.sizes[chunk.doc]
            out["doc_id"] += chunk.doc_ids
            out["n_tokens"] += chunk.sizes.tolist()
            for k, (column, mine) in enumerate((("target_loss", target), ("background_loss", ~target))):
                less = mine.astype(np.int64)
                loss = losses(pairs[k][chunk.pair] - less * own_pair, words[k][chunk.v] - less * own_history, words[k][chunk.w] - less * own_word, everything[k] - less * length, vocabulary, mix)
                sums = np.bincount(chunk.doc, weights=loss, minlength=len(chunk.sizes))
                out[column] += [s / m if m else None for s, m in zip(sums.tolist(), chunk.sizes.tolist(), strict=True)]
        return pa.table({k: pa.array(x, pa.float64() if "loss" in k else pa.int64()) for k, x in out.items()})

    return run


def score(docs: DataFrame, targets: DataFrame, mix: float = MIX, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of each of docs(doc_id, text); targets(doc_id): the target corpus."""
    chunks = packed_chunks(docs, targets, chunk_bytes)
    tokens = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = min(40, max(0, (tokens // RUN).bit_length()))
    words = stored(summed(chunks, WORDS, bits), "word-sums")
    model = words.withColumn("kind", F.lit(WORDS)).union(summed(chunks, PAIRS, bits).withColumn("kind", F.lit(PAIRS))).where("chunk >= 0")
    kinds = "doc_id long, n_tokens long, target_loss double, background_loss double"
    rows = chunks.groupBy("chunk").cogroup(model.groupBy("chunk")).applyInArrow(_score_chunk(totals(words), bits, mix), kinds)
    return rows.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _loss_sql(side: str, flag: str) -> str:
    """-ln p(w | v) on one side, without the document's own counts where it is of that side."""
    pair, history, word, total = (f"({x}{side} - CASE WHEN {flag} THEN {own} ELSE 0 END)" for x, own in (("n", "own"), ("h", "own_h"), ("u", "own_w"), ("e", "own_e")))
    plain = f"({word} + 1) / CAST({total} + voc AS DOUBLE)"
    return f"-ln(CASE WHEN {history} > 0 THEN {MIX} * {pair} / CAST({history} AS DOUBLE) + {1 - MIX} * {plain} ELSE {plain} END)"


ORACLE_SQL = f"""WITH tokens AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
own AS (SELECT doc_id, t, v, w, count(*) AS own FROM (
    SELECT doc_id, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), chr(10)) AS v, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS t FROM tokens) GROUP BY ALL),
own_w AS (SELECT doc_id, t, w, sum(own) AS own_w FROM own GROUP BY ALL),
own_e AS (SELECT doc_id, t, sum(own_w) AS own_e FROM own_w GROUP BY ALL),
bi AS (SELECT v, w, sum(own) FILTER (WHERE t) AS nt, sum(own) FILTER (WHERE NOT t) AS nb FROM own GROUP BY ALL),
uni AS (SELECT w, sum(own_w) FILTER (WHERE t) AS ut, sum(own_w) FILTER (WHERE NOT t) AS ub FROM own_w GROUP BY w),
hist AS (SELECT w AS v, ut AS ht, ub AS hb FROM uni UNION ALL SELECT chr(10), count(*) FILTER (WHERE t), count(*) FILTER (WHERE NOT t) FROM own_e),
every AS (SELECT coalesce(sum(ut), 0) AS et, coalesce(sum(ub), 0) AS eb, count(*) AS voc FROM uni),
priced AS (
  SELECT own.doc_id, own.t, own, coalesce(nt, 0) AS nt, coalesce(nb, 0) AS nb, coalesce(ut, 0) AS ut, coalesce(ub, 0) AS ub, coalesce(ht, 0) AS ht, coalesce(hb, 0) AS hb, et, eb, voc,
    own_w.own_w, own_e.own_e, coalesce(before.own_w, 1) AS own_h
  FROM own JOIN bi USING (v, w) JOIN uni USING (w) JOIN hist ON hist.v = own.v JOIN own_w ON own_w.doc_id = own.doc_id AND own_w.w = own.w JOIN own_e ON own_e.doc_id = own.doc_id
    LEFT JOIN own_w AS before ON before.doc_id = own.doc_id AND before.w = own.v, every),
means AS (SELECT doc_id, CAST(sum(own) AS BIGINT) AS n, sum(own * {_loss_sql("t", "t")}) / sum(own) AS lt, sum(own * {_loss_sql("b", "NOT t")}) / sum(own) AS lb FROM priced GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_tokens, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(lt - lb, 6) AS score FROM documents d LEFT JOIN means USING (doc_id)"""
