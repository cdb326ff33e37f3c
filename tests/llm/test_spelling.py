"""Spelling variants against a plain comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from touchline.llm import spelling as S


def near(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, min_count=S.MIN_COUNT, ratio=S.RATIO):
    words = {w: n for w, n in counts.items() if n >= min_count}
    out, forms = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [n, len(close), forms[w], words[best] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (*out[w], root)
    return out


def plain_counts(docs, trial):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if trial and h % trial == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= S.MIN_CHARS:
                total[run] += 1
    return dict(total)


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def random_words(rng, letters, n, least, most):
    words = set()
    while len(words) < n:
        word = "".join(rng.choices(letters, k=rng.randint(least, most)))
        words.add(word)
        for _ in range(2):
            i, kind = rng.randrange(len(word)), rng.randrange(3)
            words.add(word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind < 2) :])
    return sorted(words)


@pytest.mark.parametrize(("letters", "least", "most"), [("ab", 2, 7), ("aé😀", 1, 6), ("abcdefgh", 6, 9), ("a", 1, 90), ("ab", 60, 70)])
def test_variants_are_those_of_all_pairs(spark, letters, least, most):
    rng = random.Random(least)
    words = random_words(rng, letters, 150 if len(letters) > 1 else 60, least, most)
    counts = {w: rng.choice([1, 5, 6, 7, 30, 40, 150, 160, 900, 5000]) for w in words}
    rows = [*counts.items(), (None, 50), *((w, 2) for w in words[:5])]
    for w in words[:5]:
        counts[w] += 2
    got = found(S.variants(spark.createDataFrame(rows, "word string, n long")))
    assert got == plain_variants(counts)
    assert sum(x[1] for x in got.values()) > 20


def test_hash_collisions_are_seen_through(spark, monkeypatch):
    rng = random.Random(3)
    words = random_words(rng, "abc", 200, 3, 6)
    counts = {w: rng.choice([5, 30, 200]) for w in words}
    for top in (S.mixed(np.arange(3).astype(np.uint64) + np.uint64(1)).tolist(),):
        keys = lambda w, t=top, real=S.deletion_keys: (lambda o, k, a, b: (o, np.array(t, np.uint64)[(k % np.uint64(3)).astype(int)], a, b))(*real(w))
        owner, key, first, last = keys(words)
        rows = [(int(k), int(a), int(b), words[o], counts[words[o]]) for o, k, a, b in zip(owner, key, first, last, strict=True)]
        near_of = Counter()
        for k in set(key.tolist()):
            for word, n, _, _ in S.near_words([r[1:] for r in rows if r[0] == k]):
                near_of[word] += n
        assert near_of == {w: x[1] for w, x in plain_variants(counts).items() if x[1]}


def test_deletion_keys_are_those_of_the_shorter_words():
    words = ["", "a", "aa", "abcab", "éé€😀", "x" * 500]
    owner, key, first, last = S.deletion_keys(words)
    whole = {w: k for w, k in zip(words, key, strict=False)}
    for o, k, a, b in zip(owner[len(words) :], key[len(words) :], first[len(words) :], last[len(words) :], strict=True):
        w = words[o]
        for i in {a, b, (a + b) // 2}:
            assert S.deletion_keys([w[:i] + w[i + 1 :]])[1][0] == k
    assert whole["a"] in key[owner == 2] and len(key) == len(set(key.tolist())) + 1 + 1  # "" is "a" less a, "a" is "aa" less a


def test_words_of_documents(spark):
    rng = random.Random(4)
    base = ["receive", "believe", "naïveté", "Straße", "colour", "ÉCLAIR", "éclair"]
    docs = [(i, " ".join(rng.choice(base) for _ in range(120)) + " x" * 3 + "—receive’s £receive") for i in range(40)]
    docs += [(None, "receive receive"), (41, None), (42, ""), (43, "1234 !"), (44, "abcdef" * 3000), (44, "abcdef" * 3000)]
    df = spark.createDataFrame([(*d, "y") for d in docs], "doc_id long, text string, N string")
    for trial in (None, 7):
        counts = plain_counts(docs, trial)
        assert {r.word: r.n for r in S.word_counts(df, trial=trial).collect()} == counts
        assert found(S.variants(S.word_counts(df, trial=trial))) == plain_variants(counts)
    assert S.variants(S.word_counts(df.limit(0))).count() == 0
