"""Edit-aware token counts.

A document is held as a segment tree over its pre-tokens: leaves are blocks of pre-tokens with their numbers of characters and tokens, inner
nodes their sums. An edit replaces characters [start, end) of the text as it stands by then. Only the pre-tokens that it touches, two
before them (what the pattern looks ahead over) and those after it until a boundary falls on an old one again are cut and encoded anew; then the sums above
the changed blocks are updated.

Defined results: null and blank text counts as empty and can be edited; null or empty edits leave the counts as they are; positions beyond the text
are its end, an end before the start is the start; edits of a document apply in array order; rows that repeat are counted each; other columns pass
through, those with the name of a result column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, named, small_batches
from touchline.llm.memo import LIMIT, LONGEST, one_thread, space_starts, spaced_words

BLOCK = 128
CONTEXT = 2
AHEAD = 6
EDIT = "struct<start:bigint,end:bigint,insert:string>"


class PieceCounter:
    """Tokens of pre-tokens. Of those of at most LONGEST characters, limit are remembered; others are encoded anew for each batch that is learnt."""

    def __init__(self, encode_batch: Callable[[list[str]], list[int]], limit: int = LIMIT) -> None:
        self.encode_batch, self.limit, self.memo, self.batch = encode_batch, limit, {}, {}

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.memo))
        got = dict(zip(new, self.encode_batch(new), strict=True))
        room = max(0, self.limit - len(self.memo))
        self.memo |= islice(((x, n) for x, n in got.items() if len(x) <= LONGEST), room)
        self.batch = {x: n for x, n in got.items() if x not in self.memo}

    def __call__(self, pieces: list[str]) -> list[int]:
        out = list(map(self.memo.get, pieces))
        if None in out:
            batch = self.batch
            out = [batch.get(x) if n is None else n for x, n in zip(pieces, out, strict=True)]
        if None in out:
            new = [x for x, n in zip(pieces, out, strict=True) if n is None]
            got = dict(zip(new, self.encode_batch(new), strict=True))
            out = [got[x] if n is None else n for x, n in zip(pieces, out, strict=True)]
        return out


@cache
def piece_counter(tokenizer_path: str) -> PieceCounter:
    """A counter of a byte-level tokenizer's pre-tokens; one for each worker process and file, whatever its tasks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    starts = space_starts(tokenizer)

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(pieces: list[str]) -> list[int]:
        spaced = [x[0] == " " and x[1:2].isalpha() for x in pieces]
        joined = iter(spaced_words([x[1:] for x, y in zip(pieces, spaced, strict=True) if y], starts, encode))
        plain = [x for x, y in zip(pieces, spaced, strict=True) if not y]
        others = iter(encode(plain) if plain else ())
        return [len(next(joined)) // 4 if y else len(next(others)) for y in spaced]

    return PieceCounter(encode_batch)


class PieceTree:
    """Blocks of pre-tokens under a segment tree of (characters, tokens)."""

    def __init__(self, pieces: list[str], cut: Callable[[str], list[str]], count: Callable[[list[str]], list[int]]) -> None:
        self.cut, self.count, self.reencoded = cut, count, 0
        counts = count(pieces)
        self.pieces = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.counts = [counts[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.build()

    def leaf(self, block: int) -> tuple[int, int]:
        return sum(map(len, self.pieces[block])), sum(self.counts[block])

    def build(self) -> None:
        n = len(self.pieces)
        self.size = 1 << (n - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.size)
        for i in range(n):
            self.sums[self.size + i] = self.leaf(i)
        for i in range(self.size - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = a + c, b + d

    def update(self, block: int) -> None:
        i = self.size + block
        self.sums[i] = self.leaf(block)
        while i > 1:
            i //= 2
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = a + c, b + d

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Block, piece in it and the piece's first character, of the piece that holds character at (of the last one for the end)."""
        i, left = 1, at
        while i < self.size:
            i *= 2
            if left >= self.sums[i][0] and self.sums[i + 1][0]:
                left -= self.sums[i][0]
                i += 1
        block, k = i - self.size, 0
        own = self.pieces[block]
        while k + 1 < len(own) and left >= len(own[k]):
            left -= len(own[k])
            k += 1
        return block, k, at - left

    def back(self, block: int, k: int, start: int, steps: int) -> tuple[int, int, int]:
        while steps and (k or block):
            if not k:
                block -= 1
                k = len(self.pieces[block])
                if not k:
                    continue
            k -= 1
            start -= len(self.pieces[block][k])
            steps -= 1
        return block, k, start

    def edit(self, start: int, end: int, insert: str) -> None:
        """Replace characters [start, end) with insert."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        b0, k0, first = self.back(*self.find(start), CONTEXT)
        shift, ahead = len(insert) - (end - start), AHEAD
        old, bounds, at, block, k, beyond = [], {}, first, b0, k0, 0
        while True:
            # take old pieces up to some past the edit, cut them anew, look for a boundary that was one before
            while block < len(self.pieces) and beyond < ahead:
                own = self.pieces[block]
                while k < len(own) and beyond < ahead:
                    old.append(own[k])
                    at += len(own[k])
                    k += 1
                    if at > end:
                        beyond += 1
                        bounds[at] = block, k
                if k == len(own):
                    block, k = block + 1, 0
            last = block == len(self.pieces)
            region = "".join(old)
            pieces = self.cut(region[: start - first] + insert + region[end - first :])
            x, kept = first - shift, None
            for i, p in enumerate(pieces):
                x += len(p)
                if x in bounds and (last or i + CONTEXT < len(pieces)):
                    kept = i + 1
                    break
            if kept or last:
                break
            ahead *= 2
        new = pieces[:kept] if kept else pieces
        self.reencoded += len(new)
        counts = self.count(new)
        b1, k1 = bounds[x] if kept else (len(self.pieces) - 1, len(self.pieces[-1]))
        whole = self.pieces[b0][:k0] + new + self.pieces[b1][k1:]
        whole_counts = self.counts[b0][:k0] + counts + self.counts[b1][k1:]
        size = BLOCK if len(whole) > 2 * BLOCK else max(1, len(whole))
        self.pieces[b0 : b1 + 1] = [whole[i : i + size] for i in range(0, len(whole), size)] or [[]]
        self.counts[b0 : b1 + 1] = [whole_counts[i : i + size] for i in range(0, len(whole), size)] or [[]]
        if b0 == b1 and len(whole) <= 2 * BLOCK:
            self.update(b0)
        else:
            self.build()

    def text(self) -> str:
        return "".join(p for block in self.pieces for p in block)


def count_edits(docs: DataFrame, tokenizer_path: str, pattern: str, column: str = "edits") -> DataFrame:
    """docs(doc_id, text, edits array of EDIT) with tokens_before, n_tokens, n_chars_after, n_pieces and n_reencoded; without text and edits."""
    docs = named(docs, "text", column)
    extra = ["tokens_before", "n_tokens", "n_chars_after", "n_pieces", "n_reencoded"]
    rest = [f for f in docs.schema if f.name.lower() not in (column.lower(), "text", *extra)]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        count = piece_counter(tokenizer_path)
        cut = regex.compile(pattern).findall
        one_thread()
        for batch in small_batches(batches, "text", 4 << 20):
            rows, cuts = [], [cut(x or "") for x in batch.column("text").to_pylist()]
            count.learn(set().union(*cuts))
            for pieces, edits in zip(cuts, batch.column(column).to_pylist(), strict=True):
                tree = PieceTree(pieces, cut, count)
                before = tree.tokens
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["insert"] or "")
                rows.append((before, tree.tokens, tree.chars, sum(map(len, tree.pieces)), tree.reencoded))
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *columns], [*(f.name for f in rest), *extra])

    return bounded_batches(docs.select("text", column, *(f.name for f in rest))).mapInArrow(run, kinds + ", ".join(f"{x} long" for x in extra))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the rows of edits(doc_id, seq, start, end, insert) as its array of edits, in seq order.

    A document's edits apply one after another, so they form one row however many there are; ties of seq go by start, end and insert.
    """
    rows = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "insert"))).alias("_e"))
    made = F.transform("_e", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["insert"].alias("insert")))
    return docs.drop("edits").join(rows.select("doc_id", made.alias("edits")), "doc_id", "left")


def trial_edits(docs: DataFrame) -> DataFrame:
    """docs with four edits each, made from doc_id: an insertion, a deletion, a replacement and an addition at the end."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    at = [F.pmod(F.xxhash64(F.lit(i), "doc_id"), n + 1) for i in range(3)]
    edits = [(at[0], at[0], " inserted words,"), (at[1], at[1] + 37, ""), (at[2], at[2] + 5, "Ünïcode's 42"), (n + 100, n + 100, "\n\nThe end.")]
    return docs.withColumn("edits", F.array(*[F.struct(a.alias("start"), b.alias("end"), F.lit(c).alias("insert")) for a, b, c in edits]))
