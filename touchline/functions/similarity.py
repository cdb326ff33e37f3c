"""Name similarity: 200 * longest common subsequence / (length of both), over Arrow batches; one name with another, or blocks of names with blocks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=1 << 16)
def indel_ratio(a: str, b: str) -> float:
    """0 to 100; two empty names are alike. Bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def best_ratio(name: pd.Series, full: pd.Series, other: pd.Series, other_full: pd.Series) -> pd.Series:
    rows = zip(name.fillna(""), full.fillna(""), other.fillna(""), other_full.fillna(""), strict=True)
    return pd.Series([max(indel_ratio(a, b) for a in {x, y} for b in {u, v}) for x, y, u, v in rows])


def similarity(name: Column, full: Column, other: Column, other_full: Column) -> Column:
    """The best ratio of either name with either other name, in one pass over the rows."""
    return best_ratio(name, full, other, other_full)


class Names:
    """Names as a tree of prefixes, so that what names begin with alike is compared once.

    A level holds the prefixes of one length: each one's parent in the level before, its last letter, and which names end there.
    """

    def __init__(self, names: list[str]) -> None:
        order = sorted(range(len(names)), key=names.__getitem__)
        self.lengths = np.array([len(x) for x in names], np.int64)
        lengths = self.lengths[order]
        most = int(lengths.max(initial=0))
        text = "".join(names[i].ljust(most, "\0") for i in order).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(text, np.uint32).reshape(len(names), most)
        letters, codes = np.unique(points, return_inverse=True)
        codes = codes.reshape(points.shape)
        self.letters = {chr(x): i for i, x in enumerate(letters.tolist())}
        shared = np.zeros(len(names), np.int64)  # letters that a name shares with the one before it
        if most and len(names) > 1:
            other = points[1:] != points[:-1]
            shared[1:] = np.where(other.any(1), other.argmax(1), most)
            shared[1:] = np.minimum(shared[1:], np.minimum(lengths[1:], lengths[:-1]))
        at, places = np.zeros(len(names), np.int64), np.array(order, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.empty = places[lengths == 0]
        for k in range(1, most + 1):
            long = np.nonzero(lengths >= k)[0]
            new = shared[long] < k
            new[0] = True
            node = np.cumsum(new) - 1
            ends = lengths[long] == k
            self.levels.append((at[long[new]], codes[long[new], k - 1], node[ends], places[long[ends]]))
            at[long] = node

    def ratios(self, others: list[str]) -> np.ndarray:
        """indel_ratio of each of these names (rows) with each of the others (columns)."""
        out = np.zeros((len(self.lengths), len(others)))
        sizes = np.array([len(x) for x in others], np.int64)
        bits = np.zeros((max(len(self.letters), 1), len(others)), np.uint64)
        for j, x in enumerate(others):
            for i, c in enumerate(x):
                if c in self.letters:
                    bits[self.letters[c], j] |= np.uint64(1 << i)
        full = np.array([(1 << n) - 1 for n in sizes.tolist()], np.uint64)
        row = full[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            for parent, code, node, name in self.levels:
                row = row[parent]
                hit = row & bits[code]
                row = (row + hit) | (row - hit)
                if len(node):
                    common = sizes - np.bitwise_count(row[node] & full)
                    out[name] = 200.0 * common / (sizes + self.lengths[name][:, None])
        out[self.empty] = np.where(sizes == 0, 100.0, 0.0)
        return out


def all_ratios(names: list[str], others: list[str]) -> np.ndarray:
    """indel_ratio of each of names (rows) with each of others (columns). Names of over 64 letters go one by one."""
    short, brief = [i for i, x in enumerate(names) if len(x) <= 256], [j for j, x in enumerate(others) if len(x) <= 64]
    out = np.empty((len(names), len(others)))
    if short and brief:
        out[np.ix_(short, brief)] = Names([names[i] for i in short]).ratios([others[j] for j in brief])
    fast, done = set(brief), set(short)
    for j, y in enumerate(others):
        for i in range(len(names)) if j not in fast else (i for i in range(len(names)) if i not in done):
            out[i, j] = indel_ratio(y, names[i])
    return out


def two_best(players: list[list[str]], rated: list[list[str]], ids: np.ndarray, copies: np.ndarray, at_once: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each player the best ratio of any of its names with any of a rated one's, the smallest id that has it, and the second best (-1: none).

    A rated one stands for `copies` with the same names, of which ids has the smallest.
    """
    texts = sorted({x for r in rated for x in r})
    place = {x: i for i, x in enumerate(texts)}
    wide = max(len(r) for r in rated)
    own = np.array([[place[r[min(i, len(r) - 1)]] for r in rated] for i in range(wide)])
    tree = Names(texts) if all(len(x) <= 256 for x in texts) else None
    best, least, second = np.empty(len(players)), np.empty(len(players), np.int64), np.empty(len(players))
    for a in range(0, len(players), at_once):
        part = players[a : a + at_once]
        asked = sorted({x for p in part for x in p})
        where = {x: i for i, x in enumerate(asked)}
        found = tree.ratios(asked) if tree and all(len(x) <= 64 for x in asked) else all_ratios(texts, asked)
        by_rated = found[own[0]]
        for o in own[1:]:
            by_rated = np.maximum(by_rated, found[o])
        score = by_rated[:, [where[p[0]] for p in part]]
        for i in range(1, max(len(p) for p in part)):
            score = np.maximum(score, by_rated[:, [where[p[min(i, len(p) - 1)]] for p in part]])
        top = score.max(0)
        same = score == top
        best[a : a + len(part)] = top
        least[a : a + len(part)] = np.where(same, ids[:, None], np.iinfo(np.int64).max).min(0)
        second[a : a + len(part)] = np.where((same * copies[:, None]).sum(0) > 1, top, np.where(same, -1.0, score).max(0))
    return best, least, second
