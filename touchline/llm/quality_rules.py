"""Quality rules with suffix-array repetition.

Per document: word statistics, then a suffix array over its words (prefix doubling, many documents of a
batch at once: a word's code includes its document, so that no match crosses documents). Neighbouring suffixes'
longest common prefixes give the maximal repeated substrings; the union of the spans of those of at least
``min_repeat`` words gives the covered fraction.

Defined results: null or blank text has no words and fails the base rules; columns beyond doc_id and text pass
through `apply_quality_rules` untouched (a column of docs that has the name of a result column is replaced);
repeated rows are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, named, small_batches

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100
BATCH_BYTES = 2 << 20

RESULT = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "covered_words": pa.int64(),
    "longest_repeat": pa.int64(),
}


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes (of each suffix with its predecessor; 0 for the first) of int codes.

    Prefix doubling that goes on only with suffixes whose rank is still shared.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(codes, kind="stable")
    first = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    shared = ~(first & np.concatenate([first[1:], [True]]))
    active, step = order[shared], 1
    while len(active):
        ahead = active + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        old = rank[active]
        by = np.argsort(old * (n + 1) + second)
        active, old, second = active[by], old[by], second[by]
        at = np.arange(len(active))
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old | np.concatenate([[True], second[1:] != second[:-1]])
        start_old = np.maximum.accumulate(np.where(new_old, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = old + start - start_old
        levels.append(rank.astype(np.int32))
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    a, b, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(levels) - 2, -1, -1):
        level = levels[k]
        same = (a < n) & (b < n)
        same &= level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)]
        hop = np.where(same, 1 << k, 0)
        lcp[1:] += hop
        a += hop
        b += hop
    return sa, lcp


def longest_repeats(codes: np.ndarray) -> np.ndarray:
    """Per position, the length of the longest substring starting there that occurs elsewhere too."""
    sa, lcp = suffix_array(codes)
    longest = np.zeros(len(codes), np.int64)
    longest[sa] = np.maximum(lcp, np.concatenate([lcp[1:], [0]])) if len(codes) else lcp
    return longest


def covered(lengths: np.ndarray) -> np.ndarray:
    """Positions inside the union of the spans [i, i + lengths[i])."""
    edge = np.zeros(len(lengths) + 1, np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths[at], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray]:
    """The measures of RESULT for each text."""
    out = {k: np.zeros(len(texts), np.int64) for k in RESULT}
    words: list[bytes] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        own = text.encode().split()
        words += own
        out["n_words"][i] = len(own)
        out["word_chars"][i] = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if not words:
        return out
    doc = np.repeat(np.arange(len(texts)), out["n_words"])
    held = np.empty(len(words), object)
    held[:] = words
    ids, distinct = pd.factorize(held)
    longest = longest_repeats(doc * len(distinct) + ids)
    put = lambda flags: np.bincount(doc, weights=flags, minlength=len(texts)).astype(np.int64)
    out["n_repeat_words"] = put(covered(np.where(longest >= 3, 3, 0)))
    out["covered_words"] = put(covered(np.where(longest >= min_repeat, longest, 0)))
    np.maximum.at(out["longest_repeat"], doc, longest)
    return out


def quality_measures(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """docs with the measures of RESULT (columns of those names replaced)."""
    kept = bounded_batches(named(docs, "doc_id", "text").drop(*RESULT))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            got = measure(batch.column("text").to_pylist(), min_repeat)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[k], RESULT[k]) for k in RESULT)], [*batch.schema.names, *RESULT])

    return kept.mapInArrow(run, kinds + "".join(f", {k} long" for k in RESULT))


def apply_quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """docs with their measures, base_failed and kept.

    Base rules: fewer than MIN_WORDS words, or over half of the words in repeated 3-word windows. The method rejects
    a text whose maximal repeats of ``min_repeat`` words or more cover over ``max_covered`` of its words, or that
    has a repeat of over ``max_longest`` words.
    """
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)
    repeats = (F.col("covered_words") > max_covered * n) | (F.col("longest_repeat") > max_longest)
    return quality_measures(docs, min_repeat).withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeats)


def oracle_sql(min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> str:
    """DuckDB SQL for the verdicts on documents with unique doc_ids.

    A word is covered if a repeated window of min_repeat words holds it (longer repeats are unions of such windows), and a repeat of over
    max_longest words is a repeated window of one word more.
    """
    word = r"[^\x20\x09-\x0D]+"
    frames = {"a": 3, "b": min_repeat, "c": max_longest + 1}
    hashes = ", ".join(f"CASE WHEN count(*) OVER w{k} = {n} THEN hash(string_agg(word, ' ') OVER w{k}) END AS {k}" for k, n in frames.items())
    windows = ", ".join(f"w{k} AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for k, n in frames.items())
    twice = ", ".join(f"{k} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, {k}) > 1 AS {k}" for k in frames)
    spans = ", ".join(f"max(CAST({k} AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {k}" for k, n in frames.items())
    return f"""WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{word}')) AS word, generate_subscripts(regexp_extract_all(text, '{word}'), 1) AS i FROM documents),
hashed AS (SELECT doc_id, i, length(word) AS chars, {hashes} FROM words WINDOW {windows}),
repeated AS (SELECT doc_id, i, chars, {twice} FROM hashed),
covered AS (SELECT doc_id, chars, {spans} FROM repeated),
counts AS (SELECT doc_id, count(*) AS n_words, CAST(sum(chars) AS BIGINT) AS word_chars, CAST(sum(a) AS BIGINT) AS n_repeat_words, CAST(sum(b) AS BIGINT) AS covered_words, max(c) AS long FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
every AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, coalesce(long, 0) AS long
  FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN dups USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM every)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered_words <= {max_covered} * n_words AND long = 0 AS kept, covered_words FROM judged"""
