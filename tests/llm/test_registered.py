"""The registered queries without SQL, and the pipeline, as the driver calls them: small tables, against plain versions of the whole."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import sentencepiece
from test_models import BPE, ODD, PIECES, brute_components, brute_fingerprint, exact, texts_of
from test_texts import brute_dedup, brute_quality
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from touchline.llm import edit_counts, mixing, registry


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    """documents, embeddings and pages with odd rows."""
    root, rng = tmp_path_factory.mktemp("sf"), random.Random(6)
    line = lambda n: " ".join(f"{rng.choice('abcdefg')}{rng.randint(0, 9999)}" for _ in range(n))
    pages = ["\n".join(line(12) for _ in range(8)) for _ in range(70)]
    texts = [x and x[:1200] for x in ODD] + texts_of(15) + pages + [pages[0], pages[1] + " tail", "spam ham eggs " * 80, pages[2].replace("a", "b", 1), f"{line(30)}\n{pages[3]}\n{line(9)}"]
    passage = line(60)
    texts += [f"{line(40)}\n{passage}\n{line(20)}", f"{line(70)}\n{passage}", f"{line(55)} | a | b licensed under", passage]
    rows = [(i, t, rng.choice(["en", "en", "de", None]), "hot" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    pq.write_table(pa.table({k: pa.array(v) for k, v in zip(("doc_id", "text", "lang", "source", "n_chars"), zip(*rows, strict=True), strict=True)}), root / "documents.parquet")
    vectors = np.random.default_rng(3).standard_normal((200, 12)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(200)), "embedding": pa.array([*vectors.tolist()], pa.list_(pa.float32()))}), root / "embeddings.parquet")
    html = [None, "", *(f"<nav><a href=/>Home</a></nav><article><h1>T{i}</h1><p>{line(20)}</p><p>Short {i}.</p></article><footer>Bye</footer>" for i in range(20))]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html))), "url": pa.array(["u"] * len(html)), "html": pa.array(html)}), root / "pages.parquet")
    return str(root)


def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def test_op1(spark, sf_dir):
    for r in registry.op1_main_text(spark, sf_dir).collect():
        page = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()[r.page_id]["html"] or ""
        assert r.text == "\n".join(re.findall("<(?:h1|p)>(.*?)</", page)) and r.n_chars == len(r.text) and r.url == "u"


def test_op4(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()}
    got = collections.defaultdict(list)
    for r in registry.op4_nn_descent(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(vectors[r.query_id], vectors[r.vec_id])), abs=1e-9)
    assert got == {q: exact(vectors, q, 20) for q in range(0, 200, 20)}


def test_op5(spark, sf_dir):
    tokenizer, start = Tokenizer.from_file(BPE), 0
    for r, d in zip(registry.op5_token_files(spark, sf_dir).orderBy("doc_id").collect(), documents(sf_dir), strict=True):
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op7(spark, sf_dir):
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r, d in zip(registry.op7_piece_codec(spark, sf_dir).orderBy("doc_id").collect(), documents(sf_dir), strict=True):
        ids = np.array(reference.encode(d["text"] or ""), "<u4")
        assert (r.doc_id, r.n_tokens, r.ids_crc32, r.parity, r.decoded_ok) == (d["doc_id"], len(ids), zlib.crc32(ids.tobytes()), True, True)


def test_op9(spark, sf_dir):
    tokenizer = Tokenizer.from_file(BPE)
    count = lambda x: len(tokenizer.encode(x, add_special_tokens=False))
    edits = {r.doc_id: r for r in edit_counts.trial_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for r in registry.op9_edit_counts(spark, sf_dir).collect():
        text = edits[r.doc_id].text or ""
        assert r.tokens_before == count(text)
        for e in edits[r.doc_id].edits:
            a = min(e.start, len(text))
            text = text[:a] + e.insert + text[max(a, min(e.end, len(text))) :]
        assert (r.n_tokens, r.n_chars_after, r.n_pieces) == (count(text), len(text), len(regex.findall(public_tokenizers.PATTERN, text)))


def test_op10(spark, sf_dir):
    prints = {d["doc_id"]: brute_fingerprint(d["text"]) for d in documents(sf_dir)}
    label = brute_components(set(prints.values()))
    first = {}
    for i, f in prints.items():
        first[label[f]] = min(i, first.get(label[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op10_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", first[label[f]]) for i, f in prints.items()}


def plain_pipeline(docs):
    """The five stages over lists of dicts; mixing by its SQL."""
    kept = []
    for d in docs:
        n, repeated, covered, longest = brute_quality(d["text"], 10)
        if not (n < 50 or 100 * repeated > 50 * n or covered > 0.3 * n or longest > 100):
            kept.append(d)
    lines = []
    for d, text in zip(kept, brute_dedup([d["text"] for d in kept]), strict=True):
        if text == d["text"] or re.search(r"[^\x20\x09-\x0D]", text):
            lines.append(d | {"text": text, "n_chars": len(text)})
    prints = {d["doc_id"]: brute_fingerprint(d["text"]) for d in lines}
    label, seen, single = brute_components(set(prints.values())), set(), []
    for d in lines:
        root = label[prints[d["doc_id"]]]
        if root not in seen:
            seen.add(root)
            single.append(d)
    db = duckdb.connect()
    db.register("input", pa.Table.from_pylist(single, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])))
    mixed = {i for (i,) in db.sql(f"WITH {mixing.mixed_ctes('input')} SELECT doc_id FROM mix_result").fetchall()}
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return {d["doc_id"]: (d["lang"], d["source"], d["n_chars"], reference.encode(d["text"])) for d in single if d["doc_id"] in mixed}


def test_pipeline(spark, sf_dir):
    want = plain_pipeline(documents(sf_dir))
    got = {r.doc_id: (r.lang, r.source, r.n_chars, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 10 < len(got) < 70


def test_pipeline_of_an_empty_table_and_odd_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.withColumnRenamed("text", "Text").selectExpr("*", "1 as _nth", "2 as _of", "3 as n_words", "4 as rate", "5 as fp", "6 as topic").where("doc_id < 40")
    odd = odd.unionByName(odd.where("doc_id % 7 = 0")).unionByName(odd.where("doc_id = 20").selectExpr("cast(null as long) as doc_id", *odd.columns[1:]))
    for rows in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, sf_dir)
            assert name == corpus_pipeline.STAGES[-1][0] or [x.lower() for x in got.columns] == docs.columns
            assert got.count() <= rows.count()
