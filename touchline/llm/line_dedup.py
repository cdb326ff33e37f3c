"""Line dedup over overlapping three-line windows.

Every run of three consecutive lines (each trimmed) is hashed to 128 bits; windows are counted globally with map-side
combining, and of a repeated window every occurrence but the first in (doc_id, text hash, line) order covers its three lines.
A text of fewer lines has one window of all of them. A line of over LONG_WORDS words, which holds more than three lines often do, also is a window of its own, so
that a long passage is found between any neighbours. Covered positions of a document are merged and dropped. The join of occurrences with repeated windows is a
plain equi-join of two shuffled sides, which the skew-join rule splits where one window fills a partition.

Defined results: null text stays null; windows of blank lines only
do not count; rows equal in doc_id and text are one document and change alike; rows that share a doc_id but not the text are told
apart; a null doc_id comes before all others; an empty table gives an empty result; columns other than text and n_chars pass through, whatever their names (n_lines and n_removed are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, fresh, small_batches

WINDOW = 3
WHITE = " \t\v\f\r"
LONG_WORDS = 50


def windows_of(text: str, window: int, long_words: int) -> list[tuple[int, int, str]]:
    """(first line, number of lines, body) of each window of a text."""
    own = [x.strip(WHITE) for x in text.split("\n")]
    n = len(own)
    found = [(i, window, "\n".join(own[i : i + window])) for i in range(n - window + 1)] if n > window else [(0, n, "\n".join(own))]
    found = [x for x in found if len(x[2]) >= x[1]]  # else its lines are blank
    if n > 1:
        found += [(i, 1, x) for i, x in enumerate(own) if len(x) > 2 * long_words and len(x.encode().split()) > long_words]
    return found


def line_windows(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, at, pos, lines, w1, w2): the hashes of each window and the number of its lines; at: the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            found = [windows_of(x, window, long_words) for x in batch.column("text").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            pos, lines = (pa.array([y[k] for x in found for y in x], pa.int32()) for k in (0, 1))
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(y[2].encode()) for x in found for y in x]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("at").take(row), pos, lines, *(pa.array(np.ascontiguousarray(x)) for x in digests.T)], ["doc_id", "at", "pos", "lines", "w1", "w2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("at"), F.col("text").alias("text"))
    return bounded_batches(texts).mapInArrow(run, f"doc_id {kind}, at long, pos int, lines int, w1 long, w2 long")


def later_windows(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, at, spans): first line and number of lines of the windows of each document that occurred before."""
    windows = line_windows(docs, window, long_words)
    place = F.struct("doc_id", "at", "pos")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "at").agg(F.collect_set(F.struct("pos", "lines")).alias("spans"))


def without(text: str | None, spans: list[dict] | None) -> tuple[str | None, int, int]:
    """A text without the lines that the windows cover; its lines and those removed."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    gone = {s["pos"] + k for s in spans or () for k in range(s["lines"])}
    return ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text), len(lines), len(gone)


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with text (and n_chars, if there) after removal, n_lines before it and n_removed."""
    docs = bounded_batches(docs).drop("n_lines", "n_removed")
    of, at, spans = fresh(docs, "_of", "_at", "_spans")
    later = later_windows(docs, window, long_words).select(F.col("doc_id").alias(of), F.col("at").alias(at), F.col("spans").alias(spans))
    marked = docs.join(later, docs["doc_id"].eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"]) == F.col(at)), "left").drop(of, at)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    body = next(x for x in docs.columns if x.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [without(x, s) for x, s in zip(batch.column(body).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            new = {body: pa.array([x[0] for x in got], pa.string()), "n_lines": pa.array([x[1] for x in got], pa.int64()), "n_removed": pa.array([x[2] for x in got], pa.int64())}
            columns = {k: batch.column(k) for k in batch.schema.names if k != spans} | new
            for k in columns:
                if k.lower() == "n_chars":
                    columns[k] = pa.array([None if x[0] is None else len(x[0]) for x in got], columns[k].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return marked.mapInArrow(run, f"{kinds}, n_lines long, n_removed long")


def cleaned_ctes(docs: str) -> str:
    """DuckDB CTEs after which dedup_result(doc_id, text, n_lines, n_removed) holds what dedup_lines returns for unique doc_ids of the relation docs."""
    return f"""
dedup_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM {docs} WHERE text IS NOT NULL),
dedup_trimmed AS (SELECT doc_id, pos, line, count(*) OVER (PARTITION BY doc_id) AS n, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM dedup_lines),
dedup_windows AS (
  SELECT doc_id, pos, 3 AS k, t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w AS body
  FROM dedup_trimmed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, 0, count(*), string_agg(t, chr(10) ORDER BY pos) FROM dedup_trimmed GROUP BY doc_id HAVING count(*) < 3
  UNION ALL SELECT doc_id, pos, 1, t FROM dedup_trimmed WHERE n > 1 AND length(t) > {2 * LONG_WORDS} AND len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) > {LONG_WORDS}),
dedup_ranked AS (
  SELECT doc_id, pos, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS rn
  FROM dedup_windows WHERE body IS NOT NULL AND length(replace(body, chr(10), '')) > 0),
dedup_covered AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM dedup_ranked, (VALUES (0), (1), (2)) AS t(o) WHERE rn > 1 AND o < k),
dedup_kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS text,
         count(*) AS n_lines, count(c.pos) AS n_removed
  FROM dedup_lines l LEFT JOIN dedup_covered c USING (doc_id, pos) GROUP BY l.doc_id),
dedup_result AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
         coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
  FROM {docs} d LEFT JOIN dedup_kept k USING (doc_id))"""


ORACLE_SQL = f"WITH {cleaned_ctes('documents')} SELECT doc_id, n_lines, n_removed, length(text) AS n_chars, md5(text) AS text_md5 FROM dedup_result"
