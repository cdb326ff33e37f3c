"""LM scores, nearest neighbours, token files, SentencePiece codec, edit counts, SimHash: brute force, exact round trips, recall."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import edit_counts, lm_score, nn_descent, piece_codec, simhash, token_files
from touchline.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "\n x", "a\n\nb c", "x x x ", "don't 12 a's", "é  b", "日本 語 \U0001f600", "a\tb", "word " * 3000, "<s> hi </s>", "wor" * 900]


def texts_of(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "of", f"w{rng.randint(0, 400)}", "it's", "né", "\n", "12"]) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def brute_losses(texts, targets):
    """Each document's losses by models of all other rows."""
    words = [lm_score.words_of(t) for t in texts]
    vocabulary = len({w for x in words for w in x})
    uni, bi, starts = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for i, x in enumerate(words):
        k = i not in targets
        uni[k].update(x)
        bi[k].update(zip([None, *x], x, strict=False))
        starts[k][None] += bool(x)
    for i, x in enumerate(words):
        if not x:
            yield None
            continue
        own, pairs, out = collections.Counter(x), collections.Counter(zip([None, *x], x, strict=False)), []
        for k in (False, True):
            mine = (i not in targets) == k
            total, loss = sum(uni[k].values()) - mine * len(x), 0
            for v, w in zip([None, *x], x, strict=False):
                history = starts[k][None] - mine if v is None else uni[k][v] - mine * own[v]
                plain = (uni[k][w] - mine * own[w] + 1) / (total + vocabulary)
                loss -= math.log(lm_score.MIX * (bi[k][v, w] - mine * pairs[v, w]) / history + (1 - lm_score.MIX) * plain if history else plain)
            out.append(loss / len(x))
        yield out


@pytest.mark.parametrize(("chunk_bytes", "run"), [(1, 1 << 18), (700, 40), (700, 1), (1 << 20, 1 << 18)])
def test_lm_score_against_brute_force(spark, monkeypatch, chunk_bytes, run):
    """One chunk a document, several chunks and buckets, everything in one."""
    monkeypatch.setattr(lm_score, "RUN", run)
    texts = texts_of(80) + ["", None, "the of the", "twice seen text", "twice seen text", "hapax"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("chunk", F.lit(1))
    targets = spark.createDataFrame([(i,) for i in range(0, 80, 3)] * 2 + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(docs, targets, chunk_bytes=chunk_bytes).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_losses(texts, set(range(0, 80, 3)))):
        if want is None:
            assert got[i].score is None and got[i].n_tokens == 0
        else:
            assert (got[i].target_loss, got[i].background_loss) == pytest.approx(want, abs=1e-9) and got[i].score == pytest.approx(want[0] - want[1], abs=1e-9)


def test_lm_score_of_repeated_and_nameless_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c"), (None, "a b" * 4000)], "doc_id long, text string")
    texts = [r.text for r in docs.collect()]
    got = sorted((r.n_tokens, r.doc_id or 0, r.target_loss, r.background_loss) for r in lm_score.score(docs, spark.createDataFrame([(1,)], "doc_id long")).collect())
    want = sorted((len(t.split()), i, *x) for t, i, x in zip(texts, (1, 1, 0, 0), brute_losses(texts, {0, 1}), strict=True))
    assert all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(docs, none).count() == 4 and lm_score.score(docs.limit(0), none).count() == 0


def exact(vectors, q, k):
    ids = np.array(sorted(i for i in vectors if i != q))
    s = np.array([np.dot(np.float64(vectors[i]), np.float64(vectors[q])) for i in ids])
    return ids[np.lexsort((ids, -s))][:k].tolist()


def test_nearest_is_exact_when_small_and_handles_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = {i: rng.standard_normal(8).tolist() for i in range(60)}
    for i in range(30, 50):
        good[i] = good[30]
    odd = [(100, None), (101, [0.0] * 8), (102, [1.0, None] * 4), (103, [float("nan")] * 8), (104, [3.0]), (105, []), (None, [1.0] * 8), (5, good[5])]
    rows = spark.createDataFrame([*good.items(), *odd], "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = nn_descent.nearest(rows, F.col("vec_id") % 20 == 0, k=20, rounds=2).orderBy("query_id", "rank").collect()
    good[104] = [3.0] + [0.0] * 7  # shorter vectors count as followed by zeros
    for q in (0, 20, 40):
        mine = [r for r in got if r.query_id == q]
        assert [r.vec_id for r in mine] == exact(good, q, 20) and [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(np.dot(good[q], good[r.vec_id])), abs=1e-12) for r in mine)
    assert {r.query_id for r in got} == {0, 20, 40}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in nn_descent.nearest(few, F.col("vec_id") % 20 == 0, rounds=1).collect()] == [(0, 1)]


def test_nearest_answers_vectors_with_negative_zeros(spark):
    rows = spark.createDataFrame([(0, [-0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, -0.0])], "vec_id long, embedding array<double>")
    got = nn_descent.nearest(rows, F.col("vec_id") < 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 1.0), (0, 2, 0.0), (1, 0, 1.0), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0)]


def test_search_goes_on_until_no_node_is_left(spark):
    """Node i of a chain links only to the next, which is nearer to the query: 12 steps to the last."""
    q = nn_descent.quantised(np.array([[1.0 + i, 1.0] for i in range(13)]))
    near = spark.createDataFrame([(i, [(i + 1, q[i + 1])]) for i in range(12)], "a long, near array<struct<b:long,q:binary>>")
    queries = spark.createDataFrame([(0, 0, nn_descent.quantised(np.array([[1.0, 0.0]]))[0])], "query_id long, start long, qq binary")
    assert {r.node for r in nn_descent.search(near, queries, 20, 4).collect()} == set(range(13))


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    vectors = {i: x.astype(np.float32).tolist() for i, x in enumerate(rng.standard_normal((3000, 24)))}
    rows = spark.createDataFrame([*vectors.items()], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in nn_descent.nearest(rows, F.col("vec_id") % 60 == 0, rounds=2).collect():
        got[r.query_id].add(r.vec_id)
    recall = np.mean([len(got[q] & set(exact(vectors, q, 20))) / 20 for q in range(0, 3000, 60)])
    assert recall >= 0.9


def test_nearest_recall_of_clusters_with_unequal_norms(spark):
    """The defaults, on clusters (one holds a third of the rows) of vectors whose lengths differ by a factor of ten, some with -0.0."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((25, 16)) * 3
    own = np.where(rng.random(4000) < 1 / 3, 0, rng.integers(0, 25, 4000))
    made = (centres[own] + rng.standard_normal((4000, 16))) * rng.uniform(0.3, 3, (4000, 1))
    made[::40, 3] = -0.0
    vectors = {i: x.tolist() for i, x in enumerate(made)}
    got = collections.defaultdict(list)
    rows = spark.createDataFrame([*vectors.items()], "vec_id long, embedding array<double>")
    for r in nn_descent.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append(r.vec_id)
    assert len(got) == 200 and all(len(set(x)) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(exact(vectors, q, 20))) / 20 for q in range(0, 4000, 20)]) >= 0.95


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_shard_round_trip(kind):
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 2**32, n, dtype=np.uint32).tobytes() for n in (0, 1, 7, 1000, 33)]
    rows, ids = token_files.unpack_shard(token_files.pack_shard([3, None, 5, 6, 7], streams, kind, block=100))
    assert ids.tobytes() == b"".join(streams) and rows["n"].tolist() == [0, 1, 7, 1000, 33] and rows["null"].tolist() == [False, True, False, False, False]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_against_the_tokenizer(spark, kind):
    texts = ODD + texts_of(60)
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)][::-1] + [(6, "again")], "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = token_files.encode_to_files(docs, BPE, kind=kind).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BPE)
    rows = sorted([(i * 3, t) for i, t in enumerate(texts)] + [(6, "again")], key=lambda x: (x[0], x[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.encode_to_files(docs.limit(0), BPE).count() == 0


def test_piece_codec_against_sentencepiece(spark):
    import sentencepiece

    texts = ODD + texts_of(60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("parity", F.lit(1))
    encoded = piece_codec.encode_pieces(docs, PIECES)
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in encoded.collect():
        assert r.ids == reference.encode(texts[r.doc_id] or "") and r.parity and r.decoded_ok
    back = {r.doc_id: r.text for r in piece_codec.decode_pieces(encoded, PIECES).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert piece_codec.encode_pieces(docs.limit(0), PIECES).count() == 0


def test_memo_encoder_at_its_limits():
    """Few and short words remembered, words without spaces, odd spacing, sliced arrays: ids are those of the whole text."""
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(BPE)
    own = token_files.word_encoder.__wrapped__(BPE)
    own.limit, own.longest = 20, 3
    texts = [*ODD, "東京" * 5000, "dGhlIGVuZA==" * 3000 + " a b", "a \x1cb", "a\u00a0 b \u3000c", *texts_of(30)]
    for some in (texts, texts[::-1], texts[3:9]):
        got, faults = own.encode(pa.array(["skipped", *some]).slice(1))
        assert not faults.any() and len(own.memo) <= 20 and all(len(x) <= 3 for x in own.memo)
        for text, ids in zip(some, got.to_pylist(), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
    assert len(own.encode(pa.array([], pa.string()))[0]) == 0


def test_texts_beyond_a_shard(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d e " * 400), (3, None), (None, "f")], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "ids"), BPE, shard_ids=100, block=64)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, str(tmp_path / "ids")).collect()}
    tokenizer, start = Tokenizer.from_file(BPE), 0
    for doc_id, text in ((None, "f"), (1, "a b"), (2, "c d e " * 400), (3, "")):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def unigram_model(extra: tuple = (), squeeze: int = 0) -> bytes:
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, kind, value):
        return varint(number << 3 | kind) + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)

    names = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)], ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3, 1), ("▁a", -2.2, 1), ("▁ab", -4, 1), *extra]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, k)) for p, s, k in names)
    return data + field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, squeeze) + field(5, 0, 1))


def test_unigram_model_is_rebuilt():
    import sentencepiece

    data = unigram_model()
    model = piece_codec.parse_model(data)
    assert model["type"] == piece_codec.UNIGRAM and model["byte_fallback"] and len(model["pieces"]) == 265
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    tokenizer = piece_codec.build_tokenizer(model)
    for text in ("ab a b", "aab  bb", "abé"):
        assert tokenizer.encode(text, add_special_tokens=False).ids == reference.encode(text)


@pytest.mark.parametrize(("extra", "squeeze"), [((), 0), ((("a▁b", -1.5, 1),), 0), ((), 1)])
def test_unigram_model_in_spark(spark, tmp_path, extra, squeeze):
    """Words apart, pieces that span words, and squeezed spaces (which do not decode to themselves)."""
    import sentencepiece

    path = tmp_path / f"own{squeeze}{len(extra)}.model"
    path.write_bytes(unigram_model(extra, squeeze))
    texts = ["ab a b", "aab bb " * 300 + "a", "abé ab", "", None, "a  b", " b", "zz a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own, reference = piece_codec.PieceCodec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert own.whole == bool(extra or squeeze)
    for r in piece_codec.encode_pieces(docs, str(path)).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == own.tokenizer.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.parity == (r.ids == reference.encode(text)) and r.decoded_ok == (own.decode([r.ids])[0] == text)
        assert r.parity and (r.decoded_ok or squeeze)


def test_codec_faults_are_marked(tmp_path):
    """Where sentencepiece differs the ids stay the tokenizers library's, and the texts that hold such a word are marked."""
    import pyarrow as pa

    own = piece_codec.PieceCodec(PIECES)
    right = own.reference

    class Other:
        def encode(self, texts, num_threads):
            return [[1] if "bad" in x else y for x, y in zip(texts, right.encode(texts), strict=True)]

    own.reference = Other()
    for texts in (["good one", "a bad one", None, "bad"], ["fine", "one bad"]):
        ids, faults = own.encode(pa.array(texts))
        assert faults.tolist() == [piece_codec.DIFFERS * ("bad" in (x or "")) for x in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [right.encode(x or "") for x in texts]


def test_edit_counts_against_recounts():
    tokenizer = Tokenizer.from_file(BPE)
    cut, count = regex.compile(public_tokenizers.PATTERN).findall, edit_counts.piece_counter(BPE)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "re", "'ll", "1", "é", "!", "\t", " x", "日"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 400, 1500])))
        tree = edit_counts.PieceTree(cut(text), cut, count)
        for _ in range(5):
            a, b = rng.randint(0, len(text)), rng.choice([0, 0, 1, 3, 30])
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 9])))
            tree.edit(a, a + b, new)
            text = text[:a] + new + text[a + b :]
            assert tree.text() == text and [p for x in tree.pieces for p in x] == cut(text)
            assert tree.tokens == len(tokenizer.encode(text, add_special_tokens=False))


def test_edit_counts_in_spark(spark):
    texts = ODD[:11] + texts_of(20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    edits = spark.createDataFrame([(i % 31, i, i % 9, i % 9 + i % 4, f" new{i}") for i in range(90)] + [(3, 5, None, None, None), (4, 6, 10**6, 2, "end")], "doc_id long, seq long, start long, end long, insert string")
    edited = edit_counts.with_edits(docs, edits)
    got = {r.doc_id: r for r in edit_counts.count_edits(edited, BPE, public_tokenizers.PATTERN).collect()}
    tokenizer = Tokenizer.from_file(BPE)
    for row in edited.collect():
        text = row.text or ""
        assert got[row.doc_id].tokens_before == len(tokenizer.encode(text, add_special_tokens=False))
        for e in row.edits or []:
            a = min(e.start or 0, len(text))
            b = max(a, min(e.end if e.end is not None else a, len(text)))
            text = text[:a] + (e.insert or "") + text[b:]
        assert (got[row.doc_id].n_tokens, got[row.doc_id].n_chars_after) == (len(tokenizer.encode(text, add_special_tokens=False)), len(text))
    assert edit_counts.count_edits(edit_counts.trial_edits(docs).limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(parts))


def groups(labels):
    out = collections.defaultdict(set)
    for k, v in labels.items():
        out[v].add(k)
    return set(map(frozenset, out.values()))


def brute_components(fps):
    label = {x: x for x in fps}
    todo = set(fps)
    while todo:
        frontier = [todo.pop()]
        root = frontier[0]
        while frontier:
            x = frontier.pop()
            label[x] = root
            near = {y for y in todo if (x ^ y).bit_count() <= 4}
            todo -= near
            frontier += near
    return label


@pytest.mark.parametrize("small_key", [4096, 3])
def test_fingerprint_links_against_brute_force(spark, small_key):
    rng = random.Random(small_key)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 1, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randint(0, 63)
            fps.add(x)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(table, small_key)).collect()}
    assert groups({x: roots.get(signed(x), signed(x)) for x in fps}) == groups(brute_components(fps))


def test_near_duplicates_against_brute_force(spark):
    texts = texts_of(50) + ["", None, " \n", "One two", "one TWO"] + ["Same text here for all of them and more"] * 30
    long = " ".join(f"u{i}" for i in range(900))
    texts += [long, long.replace("u450 ", "x "), long.replace("u7 ", "")]
    docs = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    fps = {i + 10: brute_fingerprint(t) for i, t in enumerate(texts)}
    label = brute_components(set(fps.values()))
    least = collections.defaultdict(list)
    for i, x in fps.items():
        least[label[x]].append(i)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == min(least[label[fps[r.doc_id]]])
    kept = simhash.one_of_each(docs.withColumn("fp", F.lit(1))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(x) for x in least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_on_a_small_corpus(spark):
    import corpus_pipeline

    rng = random.Random(9)
    page = lambda k: "\n".join(" ".join(f"{rng.choice('abcdefg')}{rng.randint(0, 9999)}" for _ in range(12)) for _ in range(k))
    texts = [page(8) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", "short", "spam ham eggs " * 80, None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = spark.createDataFrame(stage(spark, rows, "").collect(), docs.schema)
        assert rows.columns == docs.columns, name
    kept = {r.doc_id for r in rows.collect()}
    assert set(range(60)) <= kept and not kept & {60, 62, 63, 64}
    last = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, rows, ""), "").collect()
    assert 0 < len(last) < len(kept) and all(r.parity and r.decoded_ok and r.n_tokens == len(r.ids) for r in last)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(docs, docs.select("doc_id")).count() == 0
    assert nn_descent.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, rounds=1).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert {(r.doc_id, r.score) for r in lm_score.score(blank, docs.select("doc_id")).collect()} == {(1, None), (2, None)}
