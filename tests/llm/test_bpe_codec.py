"""The scanned pre-tokens and the rank merges against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken

import public_tokenizers
from touchline.llm import bpe_codec as B

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab  '' \n\t\r strevmdlS'.,!-_1²٣é中Ώ  　\x1c​😀Ⅷ𞤀"
HARD = [
    None, "", " ", "  ", "\n", " \n ", "'s", "''s", " 's", "\n's", "a's's 'll'lls 're'r 'e 'ved", "x'S", "don't I'll we've they're I'm he'd", "  a", "\n\na", " \na", "\n a", "1'd", "1 2  3", "a1b2",
    "....'s", ".'s", "'", "''''", "'r", "'re", "'l", "'v e", " a", "  a", "  a", "end  ", "end \n", "é'té", "a" * 3000, " " * 3000 + "x", "ab" * 2000, "🙂" * 500, "\U0001c89aᲉᲊ", "中文 字符，測試。" * 40,
]


@pytest.fixture(scope="module")
def codec():
    return B.codec(MULTI, B.class_runs())


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n)]


def test_the_pattern_is_the_fixed_one():
    assert B.PATTERN == public_tokenizers.PATTERN


def test_functions_compose():
    of_code, joined, reach = B.automaton()
    assert len(joined) <= 256 and (reach[of_code[16]] == np.arange(8)).all()
    for f in range(len(joined)):
        for g in of_code:
            assert (reach[g][reach[f]] == reach[joined[f, g]]).all()


@pytest.mark.parametrize("slab", [1, 7, 64, 1 << 20])
def test_starts_are_those_of_the_pattern(codec, slab):
    texts = [x for x in HARD if x] + random_texts(1, 400 if slab > 7 else 60)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array([len(x.encode()) for x in texts])
    starts = np.cumsum(sizes) - sizes
    want = [s + len(t[: m.start()].encode()) for s, t in zip(starts, texts, strict=True) for m in regex.finditer(public_tokenizers.PATTERN, t)]
    if slab == 1:
        texts, data, starts = texts[:30], data[: starts[30]], starts[:30]
        want = [x for x in want if x < len(data)]
    assert B.token_starts(data, starts, codec.classes, slab).tolist() == want


def test_encodes_as_the_library_and_decodes(codec, reference):
    texts = HARD + random_texts(2, 1500)
    ids, ends = codec.encode(pa.array(texts))
    back = codec.decode(ids, ends).to_pylist()
    for t, i, b, e in zip(texts, ids.to_pylist(), back, ends.to_pylist(), strict=True):
        assert np.frombuffer(i, "<u4").tolist() == reference.encode_ordinary(t or "") and b == (t or "").encode()
        raw = (t or "").encode()
        for a, z in ((0, len(raw)), (1, len(raw) - 1), (len(raw) // 3, len(raw) // 2)):
            if 0 <= a < z:
                assert codec.part(i, e, a, z) == raw[a:z]


def test_every_code_point_is_classed_as_the_library_does(codec, reference):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["x" + "a1. \n".join(points[i : i + 400]) for i in range(0, len(points), 400)]
    ids = codec.encode(pa.array(texts))[0].to_pylist()
    assert [np.frombuffer(i, "<u4").tolist() for i in ids[:700]] == reference.encode_ordinary_batch(texts[:700])


def test_slices_of_arrays_and_wrong_ids(codec):
    texts = pa.array(["one two", None, "three's", "  four"]).slice(1, 3)
    ids, ends = codec.encode(texts)
    assert codec.decode(ids, ends).to_pylist() == [b"", b"three's", b"  four"]
    assert codec.decode(ids.slice(1), ends.slice(1)).to_pylist() == [b"three's", b"  four"]
    with pytest.raises(ValueError):
        codec.decode(ids, ends.slice(0, 1).take(pa.array([0, 0, 0])))
    with pytest.raises(ValueError):
        codec.decode(pa.array([np.array([60_000], "<u4").tobytes()]), pa.array([np.array([1], "<u4").tobytes()]))


def test_digests_and_columns(spark, reference):
    texts = [*HARD, HARD[10]]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, Text string, IDS string, decoded int")
    got = {r.doc_id: tuple(r[1:]) for r in B.digests(docs, MULTI).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert B.decode_texts(B.encode_texts(docs, MULTI), MULTI).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert B.digests(docs.limit(0), MULTI).count() == 0
    assert base64.b64encode(bytes(B.encode_texts(docs.where("doc_id = 0"), MULTI).first().ids)) == b""
