"""Token-ID files: fixed-size id blocks transposed into bit or byte planes, each plane compressed with zstandard.

A shard is one self-contained byte string: header, document table, chunk index (offset and length of each plane of
each block) and planes. Shards are rows of a Parquet dataset (shard columns and a binary payload), so that Spark's commit
protocol makes the write safe to repeat and any store that Spark reads will do.

Defined results: null and empty text give the end id alone; repeated doc_ids are all kept, next to each other, ordered
by text; an empty table gives no rows; columns other than doc_id and text are not read. A text longer than a shard gets a shard of its own.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, shared_dir, small_batches
from touchline.llm.memo import MemoEncoder, as_bytes, one_thread, space_starts, spaced_words

MAGIC = b"TLPLANE1"
BLOCK = 1 << 16
SHARD_IDS = 1 << 19
HEAD = struct.Struct("<8sBIQIQ")  # magic, plane kind, block size, ids, documents, bytes of the document table
KINDS = {"byte": 0, "bit": 1}
SHARD_SCHEMA = "part int, seq int, earlier long, n_ids long, payload binary"  # earlier: ids of the partition before this shard


def planes(block: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, least significant first."""
    flat = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [x.tobytes() for x in flat.T]
    return [x.tobytes() for x in np.packbits(np.unpackbits(flat, axis=1, bitorder="little").T, axis=1, bitorder="little")]


def unplanes(parts: list[bytes], n: int, kind: str) -> np.ndarray:
    got = np.stack([np.frombuffer(x, np.uint8) for x in parts])
    if kind == "bit":
        got = np.packbits(np.unpackbits(got, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(got.T).view("<u4").ravel()


def pack_shard(doc_ids: list[int | None], streams: list[bytes], kind: str = "byte", block: int = BLOCK, level: int = 1) -> bytes:
    """One shard of whole documents; streams: little-endian 32-bit ids of each."""
    ids = np.frombuffer(b"".join(streams), "<u4")
    zstd = zstandard.ZstdCompressor(level=level)
    index, body, at = [], [], 0
    for start in range(0, len(ids), block):
        for plane in planes(ids[start : start + block], kind):
            body.append(zstd.compress(plane))
            index.append((at, len(body[-1])))
            at += len(body[-1])
    rows = np.zeros(len(doc_ids), [("null", "?"), ("doc_id", "<i8"), ("n", "<u8")])
    rows["null"] = [x is None for x in doc_ids]
    rows["doc_id"] = [x or 0 for x in doc_ids]
    rows["n"] = [len(x) // 4 for x in streams]
    docs = zstd.compress(rows.tobytes())
    head = HEAD.pack(MAGIC, KINDS[kind], block, len(ids), len(doc_ids), len(docs))
    return b"".join([head, docs, np.array(index, "<u8").tobytes(), *body])


def unpack_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document table (null, doc_id, n) and ids of a shard."""
    magic, kind, block, n, n_docs, size = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    kind = {v: k for k, v in KINDS.items()}[kind]
    zstd, per = zstandard.ZstdDecompressor(), 4 if kind == "byte" else 32
    rows = np.frombuffer(zstd.decompress(payload[HEAD.size : HEAD.size + size]), [("null", "?"), ("doc_id", "<i8"), ("n", "<u8")])
    blocks = -(-n // block)
    index = np.frombuffer(payload, "<u8", blocks * per * 2, HEAD.size + size).reshape(blocks, per, 2)
    base = HEAD.size + size + blocks * per * 16
    out = np.empty(n, "<u4")
    for b in range(blocks):
        some = min(block, n - b * block)
        parts = [zstd.decompress(payload[base + int(o) : base + int(o) + int(k)]) for o, k in index[b]]
        out[b * block : b * block + some] = unplanes(parts, some, kind)
    assert len(rows) == n_docs
    return rows, out


@cache
def word_encoder(tokenizer_path: str) -> MemoEncoder:
    """A byte-level tokenizer's ids of whole texts, without special tokens added; one for each worker process and file, whatever its tasks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    starts = space_starts(tokenizer)

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return MemoEncoder(lambda words: (spaced_words(words, starts, encode), [0] * len(words)), lambda words: ([as_bytes(x) for x in encode(words)], [0] * len(words)))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, kind: str = "byte", block: int = BLOCK, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs(doc_id, text) with a tokenizers file in ascending doc_id order and write shards of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        encoder = word_encoder(tokenizer_path)
        part, seq, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        ids, streams, held, earlier = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, earlier
            seq, earlier = seq + 1, earlier + held
            row = [[part], [seq], [earlier - held], [held], [pack_shard(ids, streams, kind, block)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "seq", "earlier", "n_ids", "payload"])

        for batch in small_batches(batches, "text", 4 << 20):
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))[0].to_pylist(), strict=True):
                if held and held + len(got) // 4 + 1 > shard_ids:
                    yield shard()
                    ids, streams, held = [], [], 0
                ids.append(doc_id)
                streams.append(got + end)
                held += len(got) // 4 + 1
        if held:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    bounded_batches(ordered).mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files, read back: doc_id, start, n_tokens and ids_crc32.

    Starts: the ids of earlier partitions, one row for each task that wrote (which bounds the broadcast and the window over all of
    them), plus those of earlier shards of the partition.
    """
    shards = bounded_batches(spark.read.parquet(path))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    parts = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                rows, ids = unpack_shard(payload.as_py())
                n = rows["n"].astype(np.int64)
                ends = np.cumsum(n)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - n, ends, strict=True)]
                doc_ids = pa.array(rows["doc_id"].astype(np.int64), mask=rows["null"].copy())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(parts), "part").select((F.col("before") + F.col("earlier")).alias("start"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, kind: str = "byte") -> DataFrame:
    """Write docs to token files in the shared folder, then read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/touchline/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end_id, kind)
    return read_token_files(spark, path)
