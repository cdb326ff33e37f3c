"""SentencePiece models encoded and decoded by the tokenizers library.

The model protobuf is parsed here (pieces, scores, kinds, model type, normaliser) and rebuilt as a tokenizers pipeline: normaliser,
metaspace marker, unigram scores or BPE merges, byte fallback. Texts (or, where the model's pieces allow it, groups of distinct words) are
encoded in multithreaded batches. The ids are the tokenizers library's; each text or word is also encoded by sentencepiece and decoded again:
a document's ``parity`` is false if the libraries differ on any of it, ``decoded_ok`` if any of it does not decode to itself.

Defined results: null and empty text give no ids and decode to the empty text; columns of docs pass through, those with the name of a
result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from touchline.llm.common import bounded_batches, named, small_batches
from touchline.llm.memo import MemoEncoder, as_bytes, joined_batches

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, kind) and the settings that encoding needs."""
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "unk": 0, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            own = dict(fields(value))
            model |= {"type": own.get(3, UNIGRAM), "byte_fallback": bool(own.get(35, 0)), "unk": own.get(40, 0), "suffix": bool(own.get(24, 0))}
        elif number == 3:
            own = dict(fields(value))
            model |= {"charsmap": own.get(2, b""), "dummy_prefix": bool(own.get(3, 1)), "squeeze": bool(own.get(4, 1)), "escape": bool(own.get(5, 1))}
    if model["suffix"] or not model["escape"]:
        raise ValueError("models with white space as a suffix or unescaped are not supported")
    return model


def build_tokenizer(model: dict):
    """The tokenizers pipeline of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    if model["type"] == UNIGRAM:
        own = models.Unigram([(p, s) for p, s, _ in pieces], model["unk"], model["byte_fallback"])
    elif model["type"] == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        joined = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
        merges = [(-s, vocab[p[:i]], vocab[p[i:]], (p[:i], p[i:])) for p, s in joined.items() for i in range(1, len(p)) if p[:i] in joined and p[i:] in joined]
        own = models.BPE(vocab, [x[3] for x in sorted(merges)], unk_token=pieces[model["unk"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(own)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Prepend(SPACE)] if model["dummy_prefix"] else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    tail = [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, k in pieces if k == USER])
    return tokenizer


DIFFERS, LOSSY = 1, 2


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        self.model = parse_model(data)
        self.tokenizer = build_tokenizer(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        inner = any(SPACE in p.lstrip(SPACE) for p, _, k in self.model["pieces"] if k in (NORMAL, USER))
        self.whole = inner or not self.model["dummy_prefix"] or bool(self.model["charsmap"]) or self.model["squeeze"]
        self.starts = np.array([p.startswith(SPACE) for p, _, _ in self.model["pieces"]])
        self.memo = MemoEncoder(self.checked_words)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids from the tokenizers library, which shares a batch among its threads."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def checked(self, texts: list[str]) -> tuple[list[list[int]], list[int]]:
        """Ids of texts, and for each DIFFERS if sentencepiece gives others, LOSSY if they do not decode to the text."""
        got = self.encode_batch(texts)
        right, back = self.reference.encode(texts, num_threads=1), self.decode(got)
        return got, [DIFFERS * (x != y) | LOSSY * (a != b) for x, y, a, b in zip(got, right, texts, back, strict=True)]

    def checked_words(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids and faults of words that stand after a space or begin a text, which is the same to these models.

        Groups of words without a fault are taken at once, the words of others one by one.
        """

        def faultless(texts: list[str]) -> list[list[int] | None]:
            return [None if wrong else ids for ids, wrong in zip(*self.checked([x[1:] for x in texts]), strict=True)]

        out, faults = joined_batches(words, self.starts, faultless), [0] * len(words)
        left = [i for i, x in enumerate(out) if x is None]
        for i, ids, wrong in zip(left, *self.checked([words[i] for i in left]), strict=True):
            out[i], faults[i] = as_bytes(ids), wrong
        return out, faults

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids (little-endian, 32 bits) of each text, and DIFFERS and LOSSY where either holds of a part of it."""
        if self.whole:
            ids, wrong = self.checked(pc.fill_null(texts, "").to_pylist())
            return pa.array([as_bytes(x) for x in ids], pa.large_binary()), np.asarray(wrong, np.uint8)
        return self.memo.encode(texts)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@cache
def codec(path: str) -> PieceCodec:
    """One codec per worker."""
    return PieceCodec(path)


def set_threads(threads: int) -> None:
    """Threads of the tokenizers library among which a batch is shared (their number holds from the process's first batch on)."""
    os.environ |= {"TOKENIZERS_PARALLELISM": "true" if threads > 1 else "false", "RAYON_NUM_THREADS": str(threads)}


def encode_pieces(docs: DataFrame, model_path: str, threads: int = 2, keep_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_crc32 (of little-endian 32-bit ids), parity (sentencepiece gives the same ids), decoded_ok (decoding gives
    the text back) and, if keep_ids, the ids."""
    extra = {"n_tokens": pa.int64(), "ids_crc32": pa.int64(), "parity": pa.bool_(), "decoded_ok": pa.bool_()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
    kept = bounded_batches(named(docs, "text").drop("ids", *extra))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_threads(threads)
        own = codec(model_path)
        for batch in small_batches(batches, "text", 4 << 20):
            raw, faults = own.encode(batch.column("text"))
            raw = raw.to_pylist()
            columns = [[len(x) // 4 for x in raw], [zlib.crc32(x) for x in raw], (faults & DIFFERS) == 0, (faults & LOSSY) == 0]
            made = [pa.array(x, t) for x, t in zip(columns, extra.values(), strict=False)]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(columns[0])]).astype(np.int32)
                made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *extra])

    names = {"n_tokens": "long", "ids_crc32": "long", "parity": "boolean", "decoded_ok": "boolean", "ids": "array<int>"}
    return kept.mapInArrow(run, kinds + "".join(f", {k} {names[k]}" for k in extra))


def decode_pieces(encoded: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """encoded with text, decoded from ids (null ids: empty)."""
    kept = bounded_batches(encoded.drop("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_threads(threads)
        own = codec(model_path)
        for batch in batches:
            texts = own.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return kept.mapInArrow(run, f"{kinds}, text string")
