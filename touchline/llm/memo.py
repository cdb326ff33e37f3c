"""Encoding of whole texts word by word, each distinct word of a batch looked up once in a memory that a worker keeps between tasks.

A text is cut at single spaces between two non-white characters. Tokenizers whose pre-tokenizer (or whose pieces)
never joins what stands on both sides of such a space give the same ids for the words as for the whole text. Texts with
other spacing are cut by a slower rule with the same property.

Words are cut, numbered and put together again by Arrow; Python sees the distinct words of a batch only.

Defined results: null and empty text give no ids; a text without such a space is one word, which is not remembered if it is long; an empty
array gives an empty one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S) (?=\S)")
GROUP = 2048
#: Words that a worker remembers, and the most characters of one: at most some 150 MB of strings, ids and table.
LIMIT, LONGEST = 600_000, 48
#: What str.isspace() and Arrow's white space take for white, one or the other.
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def space_starts(tokenizer) -> np.ndarray:
    """By id, whether a byte-level tokenizer's token begins with a space (written as U+0120)."""
    starts = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tokenizer.get_vocab().items():
        starts[i] = token.startswith("Ġ")
    return starts


def one_thread() -> None:
    """Encode batches in the task's own thread: Spark runs a task on every core, and groups of words are too small to share."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def plain_list(column: pa.Array) -> list[str]:
    """The strings of an array (to_pylist makes a scalar of each first)."""
    return column.to_numpy(zero_copy_only=False).tolist()


def joined_batches(words: list[str], starts: np.ndarray, encode: Callable[[list[str]], list[list[int] | None]]) -> list[bytes | None]:
    """Ids (little-endian, 32 bits) of each word with a space before it, many words in one text and many texts in one call.

    encode: ids of each of several texts that begin with a space, or None for a text that is not to be used.
    starts: by id, whether the token begins with a space; of a word without inner spaces only the first token does. None for
    words with inner spaces and those of a text that does not fall apart so: they are to be encoded one by one.
    """
    out: list[bytes | None] = [None] * len(words)
    plain = [i for i, x in enumerate(words) if " " not in x]
    groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
    for group, ids in zip(groups, encode(["".join([f" {words[i]}" for i in g]) for g in groups]) if groups else (), strict=True):
        ids = np.asarray([] if ids is None else ids, "<u4")
        edge = np.flatnonzero(starts[ids])
        if len(edge) == len(group) and not edge[0]:
            raw, cuts = ids.tobytes(), [*(4 * edge).tolist(), 4 * len(ids)]
            for i, a, b in zip(group, cuts, cuts[1:], strict=False):
                out[i] = raw[a:b]
    return out


def spaced_words(words: list[str], starts: np.ndarray, encode: Callable[[list[str]], list[list[int]]]) -> list[bytes]:
    """Ids (little-endian, 32 bits) of each word with a space before it, by a byte-level tokenizer."""
    out = joined_batches(words, starts, encode)
    left = [i for i, x in enumerate(out) if x is None]
    for i, ids in zip(left, encode([f" {words[i]}" for i in left]) if left else (), strict=True):
        out[i] = as_bytes(ids)
    return out


class MemoEncoder:
    """words: ids of words that stand after a space, and what is wrong with them (0 if nothing); heads: the same of words that begin a text."""

    def __init__(
        self, words: Callable[[list[str]], tuple[list[bytes], list[int]]], heads: Callable[[list[str]], tuple[list[bytes], list[int]]] | None = None, limit: int = LIMIT, longest: int = LONGEST
    ) -> None:
        self.words, self.heads, self.limit, self.longest = words, heads, limit, longest
        self.memo: dict[str, bytes] = {}
        self.faults: dict[str, int] = {}

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids (little-endian, 32 bits) of each text, and the union of the faults of its words."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        odd = pc.not_equal(pc.utf8_trim(pc.utf8_trim_whitespace(coded.dictionary), characters=WHITE), coded.dictionary)
        odd = pc.or_(odd, pc.equal(coded.dictionary, "")).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encoded(lists, coded)
        hits = np.concatenate([[0], np.cumsum(odd[coded.indices.to_numpy()])])
        at = lists.offsets.to_numpy()
        slow = np.diff(hits[at - at[0]]) > 0
        parts, where = [], []
        for own in (np.flatnonzero(~slow), np.flatnonzero(slow)):
            if len(own):
                some = pc.take(lists, pa.array(own)) if not slow[own[0]] else pa.array([CUT.split(x) if x else [] for x in pc.take(texts, pa.array(own)).to_pylist()], pa.list_(pa.string()))
                parts.append(self._encoded(some, some.flatten().dictionary_encode()))
                where.append(own)
        back = np.argsort(np.concatenate(where))
        return pc.take(pa.concat_arrays([x[0] for x in parts]), pa.array(back)), np.concatenate([x[1] for x in parts])[back]

    def _encoded(self, lists: pa.ListArray, coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
        indices = coded.indices.to_numpy()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        first = np.zeros(0, np.int64)
        if self.heads:
            first = at[:-1][np.diff(at) > 0]
            used = np.ones(len(indices), bool)
            used[first] = False
            need = np.zeros(len(coded.dictionary), bool)
            need[indices[used]] = True
            values = [x if y else None for x, y in zip(plain_list(coded.dictionary), need.tolist(), strict=True)]
        else:
            values = plain_list(coded.dictionary)
        raw, faults = self._looked_up(values)
        if len(first):
            lead, wrong = self.heads(plain_list(pc.take(coded.dictionary, pa.array(indices[first]))))
            indices = indices.astype(np.int64)
            indices[first] = len(raw) + np.arange(len(first))
            raw, faults = raw + lead, np.concatenate([faults, np.asarray(wrong, np.uint8)])
        flat = pc.take(pa.array(raw, pa.large_binary()), pa.array(indices))
        edges = np.frombuffer(flat.buffers()[1], "<i8", len(flat) + 1, 8 * flat.offset)[at]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(edges)), flat.buffers()[2]])
        bad = np.zeros(len(lists), np.uint8)
        if faults.any() and len(indices):
            full = np.flatnonzero(np.diff(at) > 0)
            bad[full] = np.bitwise_or.reduceat(faults[indices], at[:-1][full])
        return out, bad

    def _looked_up(self, values: list[str | None]) -> tuple[list[bytes], np.ndarray]:
        """Ids and faults of distinct words; None: not asked for."""
        raw = [b"" if x is None else self.memo.get(x) for x in values]
        faults = np.fromiter((self.faults.get(x, 0) for x in values), np.uint8, len(values)) if self.faults else np.zeros(len(values), np.uint8)
        new = [i for i, x in enumerate(raw) if x is None]
        if new:
            got, wrong = self.words([values[i] for i in new])
            for i, x in zip(new, got, strict=True):
                raw[i] = x
            faults[new] = wrong
            for i, w in zip(new, wrong, strict=True):
                if len(self.memo) >= self.limit:
                    break
                if len(values[i]) <= self.longest:
                    self.memo[values[i]] = raw[i]
                    if w:
                        self.faults[values[i]] = w
        return raw, faults
