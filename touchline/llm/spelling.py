"""Spelling variants: words one inserted, deleted or replaced character apart, found by hashed deletions.

Every word is keyed by a hash of itself and by those of itself without one character. Prefix and suffix sums of a polynomial hash give all of them at
once, as 64-bit integers, for a whole Arrow batch. A key's upper 16 bits deal the keys out (a radix partition), each
partition is sorted by key, and words that meet under a key are compared as strings. Two words that lack the same
character place and agree elsewhere differ by one replacement; a word that equals another without one character, by one insertion. So the words of a
key are near each other by what they are, and a word's links and its best neighbour follow from counts and the first two of a group, without listing pairs.

A run of equal characters gives one key, with the places that it stands for. The words of a key and place are as many as there are
characters at most; those that share a deletion are some as many for each place. Words of over ``longest`` characters
travel as digests, and their strings join only keys that meet, so that bytes grow with the length and not with its square.

Defined results: null words and counts, and null texts, give nothing; repeated words are summed; a null doc_id is written as nothing before the colon;
an empty table gives no rows; other columns are not read; equal counts go by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, crc32_sql, deleted, named, small_batches, stored

RUN = re.compile(rb"[a-z\xc0-\xff]+")
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
TRIAL = 199
HELD_WORDS = 400_000
LONGEST = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
KEYED = "key long, radix int, first int, last int, word string, n long"


def trial_deletions(head: int, counts: Counter, trial: int) -> Iterator[tuple[bytes, int]]:
    """Runs (Latin-1) with their counts; a run whose crc32, begun by head, is a multiple of trial has lost a character."""
    for run, n in counts.items():
        crc = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if crc % trial == 0:
            at = crc % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, trial: int | None = None) -> DataFrame:
    """(word, n): runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, of at least min_chars characters, and their occurrences.

    trial: damage the runs of each document as `trial_deletions` does, to have misspellings whose right forms are known. A task sums up to
    HELD_WORDS words before it sends them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)

        def sent() -> pa.RecordBatch:
            words = [x.decode("latin-1") for x in total]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in small_batches(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = Counter(x for x in RUN.findall((text or "").encode("latin-1", "replace").lower()) if len(x) >= min_chars)
                for word, n in trial_deletions(zlib.crc32(f"{doc_id or ''}:".encode()), counts, trial) if trial else counts.items():
                    if len(word) >= min_chars:
                        total[word] += n
                if len(total) > HELD_WORDS:
                    yield sent()
        if total:
            yield sent()

    read = bounded_batches(named(docs, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit integers for integers, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, key, first and last place of each word's own key (places -1) and of the word without each of its runs' characters.

    The hash of characters c[0..L) is the sum of mixed(c[j]) * BASE ** (L - 1 - j) modulo 2 ** 64: without c[i], those after i keep
    their weights (sums of suffixes) and those before lose one power (sums of prefixes).
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes))
    left = ends[owner] - 1 - at
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(sizes.max(initial=0), BASE)]), dtype=np.uint64)
    chars = mixed(codes + np.uint64(1))
    suffix = np.concatenate([[np.uint64(0)], np.cumsum(chars * powers[left], dtype=np.uint64)])
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(chars * np.where(left > 0, powers[left - 1], np.uint64(0)), dtype=np.uint64)])
    new = (at == starts[owner]) | np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(codes)]])[: len(first)] - 1
    of = owner[first]
    without = prefix[first] - prefix[starts[of]] + suffix[ends[of]] - suffix[first + 1]
    whole = suffix[ends] - suffix[starts]
    hashes = np.concatenate([whole + sizes.astype(np.uint64) * BASE, without + (sizes[of] - 1).astype(np.uint64) * BASE])
    none = np.full(len(words), -1)
    return np.concatenate([np.arange(len(words)), of]), mixed(hashes), np.concatenate([none, first - starts[of]]), np.concatenate([none, last - starts[of]])


def keyed(words: DataFrame, digests: bool = False) -> DataFrame:
    """The keys of words(word, n); digests: with SHA-256 digests of the words in place of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "word", 1 << 18):
            owner, key, first, last = deletion_keys(batch.column("word").to_pylist())
            own = pa.array(owner)
            kept = [pc.take(batch.column("digest" if digests else "word"), own), pc.take(batch.column("n"), own)]
            columns = [pa.array(key.view("<i8")), pa.array((key >> np.uint64(48)).astype("<i4")), pa.array(first.astype("<i4")), pa.array(last.astype("<i4")), *kept]
            yield pa.RecordBatch.from_arrays(columns, ["key", "radix", "first", "last", "word", "n"])

    extra = [F.sha2("word", 256).alias("digest")] if digests else []
    return bounded_batches(words.select("word", "n", *extra)).mapInArrow(run, KEYED)


def near_words(members: list[tuple[int, int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """For (first, last, word, n) under one key: word, number of its near words here, and n and word of the best of these."""
    alike: dict[str, list[tuple[int, int, str, int]]] = defaultdict(list)
    for m in members:
        alike[m[2] if m[0] < 0 else m[2][: m[0]] + m[2][m[0] + 1 :]].append(m)
    best = lambda m: (-m[3], m[2])
    for group in alike.values():
        longer = [m for m in group if m[0] >= 0]
        for _, _, word, n in (m for m in group if m[0] < 0 and longer):
            top = min(longer, key=best)
            yield word, len(longer), top[3], top[2]
            for m in longer:
                yield m[2], 1, n, word
        places: dict[int, list[tuple[int, int, str, int]]] = defaultdict(list)
        for m in longer if len(longer) > 1 else ():
            for place in range(m[0], m[1] + 1):
                places[place].append(m)
        for there in places.values():
            if len(there) > 1:
                top, second = sorted(there, key=best)[:2]
                for m in there:
                    other = second if m is top else top
                    yield m[2], len(there) - 1, other[3], other[2]


def met(keys: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each meeting of words under a key of keys: dealt out by the keys' upper bits, sorted, compared as strings."""

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        some = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(some):
            return
        taken = rows.take(pa.array(some))
        cuts = [*np.flatnonzero(new[some]).tolist(), len(some)]
        members = list(zip(*(taken.column(c).to_pylist() for c in ("first", "last", "word", "n")), strict=True))
        found = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in near_words(members[a:b])]
        if found:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            at = int(np.searchsorted(key, key[-1]))
            if held and (at or key[-1] != held[-1].column("key")[0].as_py()):
                yield from compared(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            elif at:
                yield from compared(pa.Table.from_batches([batch.slice(0, at)]))
            held.append(batch.slice(at))
        if held:
            yield from compared(pa.Table.from_batches(held))

    return keys.repartition("radix").sortWithinPartitions("key").mapInArrow(run, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms(word, form) lead to in the end. Each round doubles the steps; a form's count is a multiple of its word's, so chains are short."""
    spark = forms.sparkSession
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        done = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        deleted(spark, now)
        now = done.select("word", "root")
        if done.where("moved").isEmpty():
            return now


def variants(words: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, longest: int = LONGEST) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of words(word, n) that occur at least min_count times.

    form: the near word of largest n (ties: the smallest in code-point order) if that is at least ratio times the word's own; root: where
    forms lead to in the end. Tables of this size are written to the shared folder, so that lost executors cost a stage at most.
    """
    spark = words.sparkSession
    summed = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    words = stored(summed, "words")
    length = F.length("word")
    long = keyed(words.where(length >= longest), digests=True)
    shared = long.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    texts = words.where(length > longest).select(F.sha2("word", 256).alias("word"), F.col("word").alias("own"))
    long = long.join(shared, "key", "left_semi").join(texts, "word").select("key", "radix", "first", "last", F.col("own").alias("word"), "n")
    meetings = met(keyed(words.where(length <= longest)).union(long))
    near = meetings.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("form"))).alias("best"))
    bound = -F.col("best.n") >= ratio * F.col("n")
    linked = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(bound, F.col("best.form")).alias("form"), F.when(bound, -F.col("best.n")).alias("form_n")
    )
    linked = stored(linked, "variants")
    deleted(spark, words)
    found = linked.join(roots(linked.where("form is not null")), "word", "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: DuckDB SQL for the variants of the whole of documents, whose runs are damaged by TRIAL.
ORACLE_SQL = rf"""WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT run, count(*) AS c, concat(doc_id, ':', run) AS named FROM runs WHERE length(run) >= {MIN_CHARS} GROUP BY doc_id, run),
summed AS (SELECT run, c, {crc32_sql("named")} AS crc FROM counted),
damaged AS (SELECT c, CASE WHEN crc % {TRIAL} = 0 THEN concat(substr(run, 1, crc % length(run)), substr(run, crc % length(run) + 2)) ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
shorter AS (SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
grown AS (SELECT DISTINCT s.word AS a, s.n AS an, w.word AS b, w.n AS bn FROM shorter s JOIN words w ON s.rest = w.word),
links AS (
  SELECT a, bn, b FROM grown UNION ALL SELECT b, an, a FROM grown
  UNION ALL SELECT s.word, t.n, t.word FROM shorter s JOIN shorter t ON s.rest = t.rest AND s.i = t.i AND s.word <> t.word),
near AS (SELECT a AS word, count(*) AS n_near, max(bn) AS top FROM links GROUP BY a),
best AS (SELECT word, n_near, top, min(b) AS form FROM near JOIN links ON a = word AND bn = top GROUP BY word, n_near, top),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN form END AS form, CASE WHEN top >= {RATIO} * n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)),
led(word, goal) AS (SELECT word, word FROM formed UNION ALL SELECT l.word, f.form FROM led l JOIN formed f ON f.word = l.goal WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.goal AS root, f.n, f.n_near, f.form_n FROM formed f JOIN led l USING (word) JOIN formed e ON e.word = l.goal AND e.form IS NULL"""
