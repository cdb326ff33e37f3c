"""Main text, quality rules, line dedup, mixing: small fixtures against plain Python."""

import collections
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import line_dedup, main_text, mixing, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home page"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class="cookie-banner"><p>We use cookies.</p></div><aside class=sidebar><h3>Popular</h3><ul><li><a href=x>Foo bar</a></ul></aside>
<main><article class="post"><h1>Title &eacute;&nbsp;here</h1><p>One   two<br>three <b>four</b> &lt;tag&gt; <a href=x>link</a>.<p>Short.
<script>var x="</p><p>no</p>";</script><ul><li>item one<li>item two</ul><!-- <p>gone</p> -->
<div class="ad-slot">Buy now</div><form><input value=x>Name <button>Go</button></form><p>Last &#8212; one &#x41; A&ampB</p></article>
<section class="comments"><h2>Comments</h2><p>I liked it so much thank you very much indeed dear author.</p></section></main>
<footer><p>(c) 2020</p></footer></body></html>"""


def test_main_text_of_a_page(spark):
    want = "Title é here\nOne two three four <tag> link.\nShort.\nitem one\nitem two\nLast — one A A&B"
    rows = [(1, PAGE, "x"), (1, PAGE, "x"), (2, None, None), (None, "", "y"), (4, "<div><p", "z")]
    got = main_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert [r.text for r in got] == [want, want, "", "", ""] and [r.n_chars for r in got][:3] == [len(want), len(want), 0]
    assert main_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_main_text_tree_fits_its_table():
    """At least LEAST blocks a leaf, so not every block; pages that were held out are judged as well."""
    x, y = main_text.labelled_features()
    assert ((main_text.judged(main_text.trained(), x) > 0.5) == y).mean() > 0.97
    held = np.arange(len(y)) % 3 == 0
    assert ((main_text.judged(main_text.grow(x[~held], y[~held], 8, main_text.LEAST), x[held]) > 0.5) == y[held]).mean() > 0.85

    def leaves(tree, x):
        if len(tree) == 1:
            yield len(x)
        else:
            yield from leaves(tree[2], x[x[:, tree[0]] <= tree[1]])
            yield from leaves(tree[3], x[x[:, tree[0]] > tree[1]])

    assert min(leaves(main_text.trained(), x)) >= main_text.LEAST


@pytest.mark.parametrize("last", ["The end.", "Fin.", "Not so.", "One <a href=x>link</a> in it.", "I"])
def test_main_text_keeps_short_last_paragraphs(last):
    long = "The keeper saw the lamp from his window and ran down all the steps to the water below."
    for close in ("", "</article><footer>Made here</footer>"):
        page = f"<article><p>{long}</p><p>{long}</p><p>{last}</p>{close}"
        assert main_text.main_text(page).split("\n") == [long, long, re.sub("<.*?>", "", last)]


def test_main_text_and_names():
    """Names that only begin like those of notices keep their text; long text in an article stays under any of them; readers' comments go."""
    long = " ".join(["word"] * 45)
    page = f"<article><h1>Title</h1><div class='shared-story'>A short start.</div><p class=replica>So be it.</p><p class='follow-up'>It goes on.</p><div class=banner><p>{long}</p></div>"
    page += f"<div class='ad'>Buy two for one</div><section id=comments><p>{long}</p><p>Nice.</p></section></article>"
    assert main_text.main_text(page).split("\n") == ["Title", "A short start.", "So be it.", "It goes on.", long]


def test_main_text_without_marks():
    """No article element and no names: word counts and link densities of a block and its neighbours decide."""
    long = ["The harbour was built when whaling still fed the town, and most of its sheds stand to this day behind the sea wall.", "Visitors may walk around them on every day but Monday, when the boats are taken out of the water to be cleaned."]
    links = "".join(f"<div><a href=/{i}>Section {i}</a></div>" for i in range(4))
    page = f"<body>{links}<div><p>{long[0]}</p><p>They are red.</p><p>{long[1]}</p></div>{links}</body>"
    assert main_text.main_text(page).split("\n") == [long[0], "They are red.", long[1]]


def plain_blocks(page):
    """The text of well-formed pages between tags of blocks, by the standard library's parser."""
    from html.parser import HTMLParser

    out = [""]

    class Reader(HTMLParser):
        hidden = 0

        def handle_starttag(self, tag, attrs):
            if tag in main_text.HIDDEN:
                self.hidden += 1
                out[-1] += " "
            elif tag == "br":
                out[-1] += " "
            elif tag in main_text.BLOCKS:
                out.append("")

        def handle_endtag(self, tag):
            if tag in main_text.HIDDEN:
                self.hidden -= 1
            elif tag in main_text.BLOCKS:
                out.append("")

        def handle_data(self, data):
            if not self.hidden:
                out[-1] += data

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    return [x for x in (" ".join(b.split()) for b in out) if x]


def test_blocks_against_a_plain_parser():
    rng = random.Random(5)

    def made(depth):
        kind = rng.choice(["text", "text", "inline", "block", "block", "hidden", "void", "comment"]) if depth else "text"
        inner = lambda: "".join(made(depth - 1) for _ in range(rng.randint(0, 3)))
        if kind == "inline":
            return f"<b class='x'>{inner()}</b>"
        if kind == "block":
            tag = rng.choice(["div", "section", "blockquote", "ul", "table", "h2", "article"])
            return f"<{tag} id=a>{inner()}</{tag}>"
        if kind == "hidden":
            tag = rng.choice(["script", "style"])
            return f"<{tag}>var a = '<p>' + {rng.randint(0, 9)};</{tag.upper()} >"
        return {"void": rng.choice(["<br>", "<hr/>", "<img src='a>b'>"]), "comment": "<!-- <p>no</p> -->"}.get(kind) or rng.choice([" one two", "a&amp;b ", "&eacute;", "\n x\t", "3 &lt; 4", "&#x41;&nbsp;z"])

    for _ in range(300):
        page = "".join(made(4) for _ in range(6))
        assert [b.text for b in main_text.blocks(page)] == plain_blocks(page)


@pytest.mark.parametrize("part", ["<button>a", "<b>", "<i><p><b>", '<a "', "<svg>", "<!--", "<div class=x>", "<![CDATA[", "<p>&amp;", "<li><a>", "<td><b>"])
@pytest.mark.parametrize("end", ["", "</title>", "</i>", ">", "<p>x"])
def test_main_text_of_broken_long_pages_in_linear_time(part, end):
    def seconds(n):
        page = part * (n // len(part)) + end * (n // max(1, len(end)) if end else 0)
        began = time.process_time()
        main_text.main_text(page)
        return time.process_time() - began

    assert seconds(1 << 17) < 8 * seconds(1 << 15) + 0.5


def test_main_text_on_generated_pages():
    rng = random.Random(3)
    words = "river bridge town after under council winter market small green paper found stone light".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    hit = 0
    for _ in range(40):
        body = [sentence(rng.randint(1, 60)) for _ in range(rng.randint(2, 9))]
        page = f"<body><nav><ul><li><a href=/a>{sentence(2)}</a></li></ul></nav><div class=ad>{sentence(9)}</div><article>" + "".join(f"<p>{x}</p>" for x in body) + f"</article><footer>{sentence(5)}</footer></body>"
        hit += main_text.main_text(page) == "\n".join(body)
    assert hit == 40


def brute_quality(text, least):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    spans = lambda f: len({p for i, m in enumerate(best) if m for p in range(i, i + f(m))})
    return n, spans(lambda m: 3 if m >= 3 else 0), spans(lambda m: m if m >= least else 0), max(best, default=0)


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 7, 60, 90]))) for _ in range(40)] + [None, "", " \n\t", "a " * 200, "x\x0b\x1cy é" * 3]
    got = quality_rules.quality_measures(docs(spark, texts), 5).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert (r.n_words, r.n_repeat_words, r.covered_words, r.longest_repeat) == brute_quality(text, 5)
        assert r.word_chars == sum(len(w) for w in re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_quality_rules_keep_and_reject(spark):
    rng = random.Random(1)
    clean = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400))
    passage = " ".join(f"p{i}" for i in range(110))
    texts = [clean, f"{passage} {clean} {passage}", "few words", "spam eggs ham " * 100, f"{clean}\n#one\n#one", None]
    got = quality_rules.apply_quality_rules(docs(spark, texts).withColumn("kept", F.lit("clash"))).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False, False, False, True, False]
    assert [r.base_failed for r in got] == [False, False, True, True, False, True]
    assert (got[4].n_dup_lines, got[4].n_symbols) == (1, 2)
    assert quality_rules.apply_quality_rules(docs(spark, [])).count() == 0


def brute_dedup(texts):
    """Three-line windows, one window of shorter texts, and lines of over 50 words."""
    seen, out = set(), []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        lines, gone = text.split("\n"), set()
        clean = [x.strip(" \t\v\f\r") for x in lines]
        windows = [(i, tuple(clean[i : i + 3])) for i in range(max(1, len(lines) - 2))]
        windows += [(i, (x,)) for i, x in enumerate(clean) if len(re.findall(r"[^\x20\x09-\x0D]+", x)) > 50 and len(lines) > 1]
        for i, w in windows:
            if any(w):
                gone |= set(range(i, i + len(w))) if w in seen else set()
                seen.add(w)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    long, edge = " ".join(["word"] * 51), " ".join(["word"] * 50)
    texts = ["\n".join(rng.choice(["a", "b", " a", "", "c", "long line here"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "a\nb", "x\n" * 3000, "\n\n\n\n", "a\nb", " b", "b\t", f"p\n{long}\nq", f"r\ns\n{long} \nt\nu", long, f"v\n{edge}\nw", f"x\n{edge}\ny", f"{long}\n{long}"]
    got = line_dedup.dedup_lines(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in got] == brute_dedup(texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_line_dedup_of_repeated_rows_and_odd_columns(spark):
    rows = docs(spark, ["a\nb\nc"]).union(docs(spark, ["a\nb\nc"])).union(docs(spark, ["a\nb\nc\nd"]))
    got = sorted(r.text for r in line_dedup.dedup_lines(rows).collect())
    assert len(got) == 3 and got.count("a\nb\nc") in (0, 2)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a\nb\nc", 1, 2, 3, "x", "y"), (4, "a\nb\nc", 5, 6, 7, "x", "y"), (None, "a\nb\nc", 1, 2, 3, "x", "y")], "doc_id long, Text string, _at int, _Of int, _spans int, pos string, N_lines string")
    got = line_dedup.dedup_lines(odd).collect()
    assert sorted((r.doc_id or 0, r.Text, r._at, r._Of, r._spans, r.pos, r.n_lines) for r in got) == [(0, "a\nb\nc", 1, 2, 3, "x", 3)] * 2 + [(4, "", 5, 6, 7, "x", 3)]


def test_mixing_marginals_with_full_cells(spark):
    """Marginals that a sample can have are met though cells are full; the rates are within one and meet the budget."""
    cells = spark.createDataFrame([("a", "en", "prose", 1000), ("a", "de", "prose", 40), ("b", "en", "prose", 30), ("b", "de", "prose", 500), (None, "en", "table", 20), ("null", "de", "table", 60)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.4, None: 0.025, "null": 0.075}, "lang": {"en": 0.55, "de": 0.45}, "topic": {"prose": 0.9, "table": 0.1}}
    raked, budget = mixing.raked_cells(cells, targets, 0.4)
    missed = {(r.margin, r.level): r.expected - r.goal for r in mixing.residuals(raked).collect()}
    assert len(missed) == 8 and budget == pytest.approx(660) and max(map(abs, missed.values())) < 1e-4 * budget
    rates = mixing.cell_rates(raked, budget).collect()
    assert all(0 <= r.rate <= 1 for r in rates) and sum(r.rate * r.tokens for r in rates) == pytest.approx(budget)
    tight, budget = mixing.raked_cells(cells, {"source": {"a": 0.01, "b": 0.01, None: 0.97, "null": 0.01}, "lang": 1.0, "topic": 1.0}, 0.4)
    rates = mixing.cell_rates(tight, budget).collect()
    assert sum(r.rate * r.tokens for r in rates) == pytest.approx(budget) and all(0 <= r.rate <= 1 for r in rates)


def test_mixing_of_odd_tables(spark):
    rows = [(i if i % 5 else None, "a b c" if i % 3 else None, "en", "s", 1, 2, 3, 4, 5) for i in range(40)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _source int, of_source int, _u int, level_lang int, Rate int")
    got = mixing.mix(odd)
    assert {x.lower() for x in got.columns} == {x.lower() for x in odd.columns} | {"n_tokens", "topic", "rate", "weight"}
    assert all((r._source, r.of_source, r._u, r.level_lang) == (1, 2, 3, 4) for r in got.collect())
    assert mixing.mix(docs(spark, ["", None, " "])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    same = mixing.mix(docs(spark, ["a b"] * 30).unionAll(docs(spark, ["a b"] * 30))).groupBy("doc_id").count().collect()
    assert same and all(r["count"] == 2 for r in same)


def test_mixing_meets_targets_and_budget(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30) + ("| a | b " if i % 3 == 0 else ""), rng.choice(["en", "en", "en", "de", None]), "hot" if i % 3 else f"s{i % 7}", 0) for i in range(6000)]
    table = spark.createDataFrame(rows, DOCS)
    total = table.select(mixing.word_count("text").alias("n")).agg(F.sum("n")).first()[0]
    targets = {"source": 0.5, "lang": {"de": 0.5, "en": 0.4, None: 0.1}, "topic": 1.0}
    got = mixing.mix(table.withColumn("topic", F.lit(1)), targets, share=0.3, rounds=20).collect()
    tokens = sum(r.n_tokens for r in got)
    assert 0.27 * total < tokens < 0.33 * total
    by = collections.Counter()
    for r in got:
        by[r.lang] += r.n_tokens
    assert by["de"] > 0.4 * tokens and all(abs(r.weight * r.rate - 1) < 1e-9 for r in got)
    assert mixing.mix(table.limit(0)).count() == 0


@pytest.mark.parametrize("share", [1.0, 2.0])
def test_mixing_keeps_all_when_the_budget_allows(spark, share):
    table = docs(spark, ["a b c"] * 20 + ["", None])
    assert mixing.mix(table, share=share).count() == 22


@pytest.mark.parametrize(
    ("attributes", "notice", "reader"),
    [(' class="commentlist"', False, True), (" id=postComments", False, True), (' class="article-header"', False, False), (' class="site-header"', True, False), (' class="overflow-hidden lead"', False, False),
     (" hidden", True, False), (' style="display: none"', True, False), (' class="post content"', False, False), (' class="AdSlot"', True, False), (' class="address"', False, False), (' role="navigation"', True, False),
     (' class="shared-story"', False, False), (' class="replica"', False, False)],
)
def test_names_of_notices(attributes, notice, reader):
    assert main_text.names_of(attributes) == (notice, reader)
