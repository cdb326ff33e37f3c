"""Byte-level BPE by a rank file: encoding and decoding of whole texts, with pre-tokens found by a scan over arrays.

The fixed pattern of the rank files (`PATTERN`) is the table of an automaton: a character's symbol (letter, number, other, white space,
apostrophe that may begin a contraction; all with a look at the next two characters) takes one of eight states to the next and says whether a
pre-token begins before it. Symbols are functions on states, and these compose; the compositions are few, so that a function is a number and composing
is a look-up in a small table. An associative scan over blocks of a slab of code points composes them for all positions at once, and boundaries are
read from a table. No regular expression is run. Slices between boundaries are numbered by Arrow; each distinct one is merged once by ranks and remembered.

The classes of characters are those of the installed tiktoken library, asked once on the driver, since Unicode's tables differ between libraries.

Encoding keeps, beside the ids, the byte at which each token ends. Decoding takes sizes from there, checks them, and can decode a part of a text.

Defined results: null and empty texts have no tokens; repeated rows are encoded each; an empty table gives no rows; columns of docs other than text stay unless they have
the name of a result; a text is one row however long and is scanned in slabs, and a pre-token of any length is merged with a heap; ids that the file lacks raise an error.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_batches, named, small_batches

#: Fixed value: the pattern whose pre-tokens the automaton finds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Classes of code points.
OTHER, LETTER, NUMBER, WHITE = range(4)
#: Symbols: a plain character of a class; an apostrophe before one or two letters of a contraction; a space or another white character before
#: something that is not white; white space before white space or the end.
SYMBOLS = OTHER_, LETTER_, NUMBER_, QUOTE_1, QUOTE_2, SPACE_, LONE_WHITE, WHITE_ = range(8)
#: States: what the token that ends here is. CLOSED: whatever follows begins a token; SPACED: a space that joins what follows; NEED_n: n letters of a contraction to come.
STATES = CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACED, IN_WHITE, NEED_1, NEED_2 = range(8)
SLAB = 1 << 20
WIDTH = 128
BATCH_BYTES = 4 << 20
LIMIT, LONGEST = 600_000, 48


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins with this symbol."""
    if symbol == LETTER_:
        if state in (NEED_1, NEED_2):
            return (CLOSED, False) if state == NEED_1 else (NEED_1, False)
        return IN_LETTERS, state not in (IN_LETTERS, SPACED)
    if symbol == NUMBER_:
        return IN_NUMBERS, state not in (IN_NUMBERS, SPACED)
    if symbol in (OTHER_, QUOTE_1, QUOTE_2):
        if state in (IN_OTHERS, SPACED):
            return IN_OTHERS, False
        return {OTHER_: IN_OTHERS, QUOTE_1: NEED_1, QUOTE_2: NEED_2}[symbol], True
    if symbol == WHITE_:
        return IN_WHITE, state != IN_WHITE
    return (SPACED if symbol == SPACE_ else CLOSED), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compositions: `after` (function, symbol code) and `joined` (function, function) give functions, `reach` (function, state) the state.

    A symbol's code is SYMBOLS, plus 8 where a text begins, which forgets the state. Functions 0 to 15 are those of the codes, 16 changes nothing.
    """
    states = tuple(STATES)
    codes = [tuple(step(s, x)[0] for s in states) for x in SYMBOLS] + [(step(CLOSED, x)[0],) * len(states) for x in SYMBOLS]
    number: dict[tuple[int, ...], int] = {}
    functions: list[tuple[int, ...]] = []
    of_code = []
    for f in [*codes, states]:
        if f not in number:
            number[f] = len(functions)
            functions.append(f)
        of_code.append(number[f])
    then = lambda f, g: tuple(g[x] for x in f)
    at = 0
    while at < len(functions):
        for g in list(codes):
            made = then(functions[at], g)
            if made not in number:
                number[made] = len(functions)
                functions.append(made)
        at += 1
    joined = np.array([[number[then(f, g)] for g in functions] for f in functions], np.uint8)
    return np.array(of_code, np.uint8), joined, np.array(functions, np.uint8)


@cache
def begins() -> np.ndarray:
    """By state and symbol code, whether a token begins."""
    return np.array([[step(s, x)[1] for x in SYMBOLS] + [True] * len(SYMBOLS) for s in STATES])


@cache
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Lengths and classes of runs of code points, as the tiktoken library has them."""
    import tiktoken

    bytes_ = {bytes([i]): i for i in range(256)}
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytes_, special_tokens={})
        found = bytes(own.encode_ordinary(text)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    edges = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1], [True]]))
    return np.diff(edges), classes[edges[:-1]]


def symbols(codes: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol codes of code points; first: where texts begin (one more: whether what follows the last is known to be another text or the end)."""
    kind = classes[codes]
    ends = first[1:]
    ahead = np.where(ends, WHITE, np.concatenate([kind[1:], [WHITE]]))  # after the end of a text as if white
    out = np.array([OTHER_, LETTER_, NUMBER_, WHITE_], np.uint8)[kind]
    out[(kind == WHITE) & (ahead != WHITE)] = LONE_WHITE
    out[(codes == 32) & (ahead != WHITE)] = SPACE_
    quotes = np.flatnonzero((codes == 39) & ~ends)
    if len(quotes):
        one = np.concatenate([codes, [0, 0]])[quotes + 1]
        two = np.where(np.concatenate([ends, [True]])[quotes + 1], 0, np.concatenate([codes, [0, 0]])[quotes + 2])
        out[quotes[np.isin(one, [ord(x) for x in "stmd"])]] = QUOTE_1
        out[quotes[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = QUOTE_2
    return out + np.uint8(len(SYMBOLS)) * first[:-1]


def scanned(symbol: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Where tokens begin, and the last state, of symbol codes after a state: an associative scan within blocks, then over the blocks' functions."""
    of_code, joined, reach = automaton()
    width = len(joined)
    flat = joined.ravel()
    n, blocks = len(symbol), -(-len(symbol) // WIDTH)
    padded = np.full(blocks * WIDTH, 16, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(of_code[padded].reshape(blocks, WIDTH).T).astype(np.intp)
    acc = np.empty((WIDTH, blocks), np.uint8)
    acc[0] = columns[0]
    for t in range(1, WIDTH):
        np.take(flat, acc[t - 1] * np.intp(width) + columns[t], out=acc[t])
    totals, hop = acc[-1].copy(), 1
    while hop < blocks:
        totals[hop:] = flat[totals[:-hop] * np.intp(width) + totals[hop:]]
        hop *= 2
    entry = np.concatenate([[state], reach[totals[:-1], state]]).astype(np.uint8)
    before = np.concatenate([entry[None], reach[acc[:-1], entry[None]]])
    begin = begins().ravel()[(before.T.ravel()[:n] * np.intp(2 * len(SYMBOLS))) + symbol]
    return begin, int(reach[totals[-1], state])


def token_starts(data: np.ndarray, starts: np.ndarray, classes: np.ndarray, slab: int = SLAB) -> np.ndarray:
    """Bytes at which pre-tokens begin in texts joined as UTF-8; starts: where (not empty) texts begin, in order."""
    found, state, a, end = [], CLOSED, 0, len(data)

    def whole(at: int) -> int:
        while at < end and data[at] & 0xC0 == 0x80:
            at += 1
        return min(at, end)

    while a < end:
        b = whole(min(a + slab, end))
        c = whole(min(b + 8, end))  # two characters more, to look ahead
        part = data[a:c]
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        codes = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), "<u4")
        first = np.zeros(len(lead) + 1, bool)
        here = starts[np.searchsorted(starts, a) : np.searchsorted(starts, c)]
        first[np.searchsorted(lead, here - a)] = True
        first[-1] = c == end
        own = int(np.searchsorted(lead, b - a))
        begin, state = scanned(symbols(codes, classes, first)[:own], state)
        found.append(lead[:own][begin] + a)
        a = b
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the neighbours of least rank are joined, the leftmost first, until none can be."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    queue = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        before[stop] = i
        for a, b in ((i, end[stop] if stop < n else 0), (before[i], stop)):
            if a >= 0 and b:
                rank = ranks.get(piece[a:b])
                if rank is not None:
                    heapq.heappush(queue, (rank, a, b))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """A rank file's codec. One for each worker process; it remembers up to LIMIT pre-tokens of at most LONGEST bytes."""

    def __init__(self, path: str, lengths: np.ndarray, kinds: np.ndarray) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.classes = np.repeat(kinds, lengths)
        words = sorted(self.ranks, key=self.ranks.get)
        self.tokens = pa.array(words, pa.large_binary())
        self.places = np.full(max(self.ranks.values(), default=-1) + 2, -1)
        self.places[[self.ranks[x] for x in words]] = np.arange(len(words))
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.memo: dict[bytes, bytes] = {}

    def _ids(self, piece: bytes) -> bytes:
        got = self.memo.get(piece)
        if got is None:
            got = np.array(merged(piece, self.ranks), "<u4").tobytes()
            if len(piece) <= LONGEST and len(self.memo) < LIMIT:
                self.memo[piece] = got
        return got

    def _rows(self, ids: np.ndarray) -> np.ndarray:
        """Places in `tokens` of ids."""
        at = self.places[np.minimum(ids, len(self.places) - 1)]
        if (at < 0).any():
            raise ValueError("ids that the rank file lacks")
        return at

    def encode(self, texts: pa.Array) -> tuple[pa.LargeBinaryArray, pa.LargeBinaryArray]:
        """Ids, and the byte at which each token ends, of each text: little-endian unsigned integers of 32 bits."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        edges = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        starts = token_starts(data, np.unique(edges[:-1][np.diff(edges) > 0]), self.classes)
        bounds = np.concatenate([starts, [len(data)]]).astype("<i8")
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        raw = pa.array([self._ids(x) for x in pieces.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary())
        flat = pc.take(raw, pieces.indices)
        cuts = np.frombuffer(flat.buffers()[1], "<i8", len(flat) + 1, 8 * flat.offset)[np.searchsorted(bounds, edges)]
        ids = np.frombuffer(flat.buffers()[2] or b"", "<u4", cuts[-1] // 4)
        grown = np.concatenate([[0], np.cumsum(self.sizes[self._rows(ids)])])
        base = np.repeat(grown[cuts[:-1] // 4], np.diff(cuts) // 4)
        ends = (grown[1:] - base).astype("<u4")
        offsets = pa.py_buffer(np.ascontiguousarray(cuts, "<i8"))
        made = lambda x: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))])
        return made(ids), made(ends)

    def decode(self, ids: pa.Array, ends: pa.Array) -> pa.LargeBinaryArray:
        """Bytes of each text from its ids and the ends of its tokens."""
        (flat, cuts), (stops, stop_cuts) = _integers(ids), _integers(ends)
        rows = self._rows(flat)
        grown = np.concatenate([[0], np.cumsum(self.sizes[rows])])
        edges = grown[cuts]
        said = np.where(np.diff(stop_cuts) > 0, stops[np.maximum(stop_cuts[1:] - 1, 0)], 0) if len(stops) else np.zeros(len(ids), np.int64)
        if (cuts != stop_cuts).any() or (np.diff(edges) != said).any():
            raise ValueError("the ends are not those of the ids' tokens")
        taken = pc.take(self.tokens, pa.array(rows)) if len(rows) else pa.array([], pa.large_binary())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(edges, "<i8")), taken.buffers()[2] or pa.py_buffer(b"")])

    def part(self, ids: bytes, ends: bytes, start: int, stop: int) -> bytes:
        """The bytes from start to before stop of one text, from the tokens that hold them."""
        stops = np.frombuffer(ends, "<u4")
        a, b = np.searchsorted(stops, start, "right"), np.searchsorted(stops, stop, "left") + 1
        some = self._rows(np.frombuffer(ids, "<u4")[a:b])
        base = int(stops[a - 1]) if a else 0
        return b"".join(self.tokens.take(pa.array(some)).to_pylist())[start - base : stop - base]


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The little-endian 32-bit integers of a binary column in a row, and where rows begin among them."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    edges = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, 8 * column.offset)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]].view("<u4") if edges[-1] > edges[0] else np.zeros(0, "<u4")
    return flat, (edges - edges[0]) // 4


_codecs: dict[str, Codec] = {}


def codec(path: str, runs: tuple[np.ndarray, np.ndarray]) -> Codec:
    """The worker's codec of a file."""
    if path not in _codecs:
        _codecs[path] = Codec(path, *runs)
    return _codecs[path]


def _kinds(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """docs with, in place of text, n_tokens, ids and ends (binary: little-endian unsigned integers of 32 bits)."""
    runs = class_runs()
    kept = named(docs, "text").drop("n_tokens", "ids", "ends")
    names = [c for c in kept.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, runs)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids, ends = own.encode(batch.column("text"))
            n = pa.array(np.diff(np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)) // 4)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], n, ids.cast(pa.binary()), ends.cast(pa.binary())], [*names, "n_tokens", "ids", "ends"])

    return bounded_batches(kept).mapInArrow(run, f"{_kinds(kept.drop('text'))}n_tokens long, ids binary, ends binary")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(ids, ends, ...) with decoded (binary: the bytes of the text) in place of ends."""
    runs = class_runs()
    kept = encoded.drop("decoded")
    names = [c for c in kept.columns if c != "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, runs)
        for batch in small_batches(batches, "ids", 2 * BATCH_BYTES):
            made = own.decode(batch.column("ids"), batch.column("ends"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made.cast(pa.binary())], [*names, "decoded"])

    return bounded_batches(kept).mapInArrow(run, f"{_kinds(kept.drop('ends'))}decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of ids and of decoded bytes, of docs(doc_id, text)."""
    coded = decode_texts(encode_texts(named(docs, "doc_id", "text").select("doc_id", "text"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
