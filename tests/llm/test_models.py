"""Learnt operators: held-out accuracy, exact sums, and brute-force versions."""

import fractions
import itertools
import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from settings import SF
from pyspark.sql import functions as F
from tables import odd_documents, no_documents

from launchgrid.llm import bitslice, html, lmscore, quality

BIG = "/root/testdata/sf0.1"


def test_interactions_by_the_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS + quality.STATS), rng.normal(size=(quality.BUCKETS + quality.STATS, 4)), np.zeros(quality.STATS), np.ones(quality.STATS))
    row, bucket, value, stats = quality.features(pa.array(["one two two three, four", ""]))
    got, idx, rows, val, _, _ = quality._linear(m, row, bucket, value, stats)
    for r in (0, 1):
        i, x = idx[rows == r], val[rows == r]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[r] == pytest.approx(0.3 + m.weights[i] @ x + pairs)


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = quality.assess(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 500
    assert (rows.predicted == rows.quality).mean() > 0.97
    assert rows.predicted[rows.quality == 1].mean() > 0.98


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.assess(docs, x).orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_quality_odd_documents(spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (4, 0), (99, 1), (None, 0), (5, None)], "doc_id long, quality int")
    rows = quality.assess(odd_documents(spark), labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.assess(no_documents(spark), labels).count() == 0
    assert quality.assess(odd_documents(spark).union(odd_documents(spark)).union(odd_documents(spark)), labels).filter("score is null").count() == 0
    none = quality.assess(odd_documents(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the machine alone, the one that all rows in order of their ids give."""
    rows = [(i, "well kept words, in order. " * (i % 5 + 1) if i % 2 else f"buy {i} now " * (i % 7 + 1), i % 2) for i in (7, 3, 12, 8, 1, 20, 15, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    rows.sort()
    row, bucket, value, stats = quality.features(pa.array([r[1] for r in rows]))
    want = quality.fit(row, bucket, value.astype("<f4").astype(float), stats, np.array([float(r[2]) for r in rows]))
    monkeypatch.delattr(quality, "fit")
    got = quality.train(docs.drop("quality"), docs.drop("text"))
    assert got.bias == want.bias and all(np.array_equal(getattr(got, k), getattr(want, k)) for k in ("weights", "factors", "centre", "scale"))


def brute_top(vectors, k=5):
    ids = np.array(sorted(vectors))
    v = np.floor(256 * np.array([vectors[i] for i in ids], float)).astype(int)
    out = []
    for q in range(len(ids)):
        if ids[q] % 50 == 0:
            s = v @ v[q]
            order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
            out += [(int(ids[q]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
    return sorted(out)


def test_top_products(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_top({r.vec_id: r.embedding for r in rows.collect()})
    top = lambda: sorted(map(tuple, bitslice.top_products(rows, F.col("vec_id") % 50 == 0).collect()))
    assert top() == want
    monkeypatch.setattr(bitslice, "BLOCK", 70)
    monkeypatch.setattr(bitslice, "ROUND_BYTES", 8 * 65 * 3)
    assert top() == want


def test_top_products_ties_and_gaps(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [0.5, -0.25]) for i in range(60)] + [(100, [1.0, 1.0]), (101, [nan, 1.0]), (102, [inf, 1.0]), (103, None), (None, [1.0, 1.0]), (104, [None, 1.0]), (7, [0.5, -0.25])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit(1)).withColumn("ids", F.lit(1))
    got = sorted(map(tuple, bitslice.top_products(df, F.col("vec_id") % 50 == 0).collect()))
    want = brute_top({i: v for i, v in data[:61]})
    assert got == want and [r[2] for r in got if r[0] == 0] == [1, 2, 3, 4, 5]
    assert bitslice.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_products_of_any_finite_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(bitslice, "WIDE_BLOCK", 8)
    data = {i: rng.normal(size=6).tolist() for i in range(120)}
    data |= {200 + i: (rng.normal(size=6) * 10.0 ** rng.integers(3, 30)).tolist() for i in range(30)}
    data |= {300: [1e300, -1e300, 0.0, 1.5, -70000.25, 3.0], 301: [-1e300, 1e300, 1e-300, 0.0, 70000.0, 65536.0], 302: [70000.0] * 6, 350: [-1.7e308] * 6}
    exact = {i: [math.floor(fractions.Fraction(c) * 256) for c in v] for i, v in data.items()}
    want = []
    for q in (i for i in exact if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[i], strict=True)), i) for i in exact if i != q)[:5]
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
    df = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    assert sorted(map(tuple, bitslice.top_products(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)


def test_selection_from_the_top_digit_down():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 200)
    total = bitslice.slices_of(values[:, None], 6)[0]
    every = np.zeros(total.shape[1] * 8, np.uint8)
    every[:25] = 255
    for k in (1, 5, 37):
        want = sorted(np.lexsort((np.arange(200), -values))[:k])
        assert sorted(bitslice.select_top(total, every.view(np.uint64), k)) == want


def test_cross_entropy_difference_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b a b c"), (1, "c c c"), (2, None), (3, " ")], "doc_id long, text string")
    good = spark.createDataFrame([(0,), (0,)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, good).collect()}
    uni = [{"a": 2, "b": 2, "c": 1}, {"a": 2, "b": 2, "c": 4}]
    pairs = [{"ab": 2, "ba": 1, "bc": 1}, {"ab": 2, "ba": 1, "bc": 1, "cc": 2}]

    def loss(words, t):
        n, out = sum(uni[t].values()), []
        for i, w in enumerate(words):
            p = (uni[t].get(w, 0) + 0.5) / (n + 0.5 * 3)
            if i:
                h = words[i - 1]
                p = (pairs[t].get(h + w, 0) + 20 * p) / (uni[t].get(h, 0) + 20)
            out.append(-math.log(p))
        return sum(out) / len(out)

    for doc, words in ((0, "ababc"), (1, "ccc")):
        assert got[doc].target_loss == pytest.approx(loss(words, 0), rel=1e-4)
        assert got[doc].background_loss == pytest.approx(loss(words, 1), rel=1e-4)
        assert got[doc].score == pytest.approx(got[doc].target_loss - got[doc].background_loss)
    assert got[2].score is None and got[3].n_words == 0


def test_losses_against_counted_words_over_a_table(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_WORDS", 5_000)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    good = {r.doc_id for r in labels.collect()}
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or "")) for r in docs.collect()}
    models = []
    for own in ([w for i, w in texts.items() if i in good], list(texts.values())):
        models.append((Counter(w for words in own for w in words), Counter(p for words in own for p in itertools.pairwise(words))))
    v = len(models[1][0])
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, words in texts.items():
        want = []
        for one, two in models:
            n, loss = sum(one.values()), 0.0
            for k, w in enumerate(words):
                p = (one[w] + 0.5) / (n + 0.5 * v)
                loss -= math.log(p if not k else (two[words[k - 1], w] + 20 * p) / (one[words[k - 1]] + 20))
            want.append(loss / len(words) if words else None)
        assert got[i].n_words == len(words)
        assert (got[i].target_loss, got[i].background_loss) == (pytest.approx(want[0], rel=1e-9), pytest.approx(want[1], rel=1e-9)) if words else got[i].score is None


def test_every_word_and_pair_is_counted_by_itself(spark, monkeypatch):
    # More distinct words and pairs than any fixed table of 2^17 and 2^20 classes keeps apart.
    monkeypatch.setattr(lmscore, "CHUNK_WORDS", 100_000)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 999), i -> concat('w', id * 1000 + i)), ' ')").alias("text"))
    got = lmscore.cross_entropy_difference(df, df.filter("doc_id < 0")).collect()
    n, v = 400_000, 400_000
    alone = 1.5 / (n + 0.5 * v)
    want = -(math.log(alone) + 999 * math.log((1 + 20 * alone) / 21)) / 1000
    assert len(got) == 400 and all(r.background_loss == pytest.approx(want, rel=1e-9) for r in got)


def test_cross_entropy_odd_documents(spark):
    good = spark.createDataFrame([(0,)], "doc_id long")
    assert lmscore.cross_entropy_difference(odd_documents(spark), good).count() == 11
    assert lmscore.cross_entropy_difference(no_documents(spark), good).count() == 0
    assert lmscore.cross_entropy_difference(odd_documents(spark), good.limit(0)).filter("score is not null").count() > 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/x>Home</a></li><li><a href=/y>News</a></li></ul></nav>
<div class="ad">Buy now, it is cheap.</div><article><h1>The&nbsp;title &amp; more</h1><p><b>First   line<br>goes on.<p>Second &#233; line.</article><footer>&copy; site, all rights.</footer></body></html>"""


def test_blocks():
    got = [(p.tag, t) for p, t, _ in html.blocks(PAGE)]
    assert got == [("li", "Home"), ("li", "News"), ("div", "Buy now, it is cheap."), ("h1", "The title & more"), ("p", "First line goes on."), ("p", "Second é line."), ("footer", "© site, all rights.")]


def test_gradients_by_difference():
    pages = html.read([PAGE, PAGE[: PAGE.index("<article>")]])[1]
    labels = [html.silver(html.blocks(PAGE)).astype(float), np.zeros(3)]
    m = html.Labeller()

    def loss():
        z, (_, mask, *_rest) = m.forward(pages)
        y = np.zeros_like(mask)
        for j, lab in enumerate(labels):
            y[: len(lab), j] = lab
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    g = m.gradients(pages, labels)
    rng = np.random.default_rng(0)
    for name, grad in g.items():
        at = np.unravel_index(np.argmax(np.abs(grad) * (rng.random(grad.shape) + 0.5)), grad.shape)
        keep = m.p[name][at]
        m.p[name][at] = keep + 1e-5
        up = loss()
        m.p[name][at] = keep - 1e-5
        assert grad[at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=1e-8), name
        m.p[name][at] = keep


def test_main_text(spark):
    pages = spark.read.parquet(f"{BIG}/pages.parquet")
    rows = html.main_text(pages.filter("page_id < 400"), html.train(pages)).join(pages.select("page_id", "html"), "page_id").collect()
    exact = 0
    for r in rows:
        read = html.blocks(r.html)
        exact += r.text == "\n".join(t for (_, t, _), keep in zip(read, html.silver(read), strict=True) if keep)
        assert r.n_chars == len(r.text)
    assert exact >= 0.99 * len(rows)


def test_main_text_under_other_tags(spark):
    pages = spark.read.parquet(f"{BIG}/pages.parquet")
    m = html.train(pages)
    read = [p for p, _, _ in html.sample(pages.filter("page_id between 1000 and 1100"))]
    other = [b for p in read for b in p if b.facts[0] > 40]
    made = [html._made(p, html.silver(p), other, np.random.default_rng(i)) for i, p in enumerate(read)]
    found = m.label([html.Vectors.made(p) for p, _ in made])
    assert np.mean([(a == b).mean() for a, (_, b) in zip(found, made, strict=True)]) > 0.98


FIRST, SECOND = "The river rose in the night, and by morning the lower road was gone.", "Nobody in the village had seen it that high since the old mill burned."
LINKS = "<ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About us</a></ul>"
BY_HAND = [  # a page, and the text that a reader would call its article
    (f"<html><head><title>x</title><body><nav>{LINKS}</nav><article><h1>High water</h1><p>{FIRST}<p>{SECOND}</article><footer>All rights reserved.</footer>", ["High water", FIRST, SECOND]),
    (f"<nav>{LINKS}</nav><main><p>{FIRST}</p><div class=ad>Buy two, get one.</div><p>{SECOND}</p></main><section class='reader comments'><p>I was there too, it was worse.</p></section>", [FIRST, SECOND]),
    (f"<header>The Daily</header><article><p>{FIRST}<!-- <p>never</p> --></p><script>var a = '<p>no</p>'</script><p>{SECOND}</p><aside>Related: the mill</aside></article>", [FIRST, SECOND]),
    (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold. {FIRST}</p><p>{SECOND} &lt;&eacute;&#x263a;&gt;</p></article><div class=comments><div class=comment><p>First!</p></div></div>", [f"Let x=2 hold. {FIRST}", f"{SECOND} <é☺>"]),
    (f"<body><div class=cookie-banner>We use cookies.</div>{'<div>' * 3000}<article><p>{FIRST}<p>{SECOND}</article>", [FIRST, SECOND]),
    (f"<article><ul><li>{FIRST}<li>{SECOND}</ul></article><form><input><button>Send</button></form><footer>Contact</footer>", [FIRST, SECOND]),
]


def test_main_text_of_pages_read_by_hand(spark):
    m = html.train(spark.read.parquet(f"{BIG}/pages.parquet"))
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(BY_HAND)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(df, m).collect()} == {i: "\n".join(want) for i, (_, want) in enumerate(BY_HAND)}


def test_every_word_counts(spark):
    words = [f"w{i}" for i in range(500)]
    _, (a, b) = html.read([f"<p>{' '.join(words)}", f"<p>{' '.join(words[:250] + ['other'] + words[251:])}"])
    assert len(a.word_ids) == 500 and (a.word_ids != b.word_ids).sum() == 1
    names = [f"name{i:c}x" for i in range(97, 117)]
    (path, _, _), = html.blocks(f"<div class='{' '.join(names)}'>t</div>")
    assert all(path.mask >> html._hash("." + n, html.PATHS) & 1 for n in names)


@pytest.mark.parametrize("hostile", ["<b>" * 50_000 + "x" + "</i>" * 50_000, "<div>t" * 15_000, "<p>" + "<b>" * 20_000 + "<hr>" * 20_000, "<table>" + "<tr><td>x" * 15_000, "<div class=a>" + "<li>x<span>" * 15_000, "<" * 300_000, "&" * 300_000, "<a " * 100_000, "<p>x</p>" + "<!--" * 100_000, "<![CDATA[>" * 50_000, "<p>word " * 30_000])
def test_reading_is_linear(hostile):
    began = time.process_time()
    html.Labeller().label(html.read([hostile])[1])
    assert time.process_time() - began < 30


def test_main_text_of_a_very_long_page(spark):
    lines = [f"{FIRST} {'and so on ' * 60}{i}" for i in range(16_000)]
    page = f"<nav>{LINKS}</nav><article>{''.join(f'<p>{x}' for x in lines)}</article><footer>All rights reserved.</footer>"
    assert len(page) > 10_000_000
    m = html.train(spark.read.parquet(f"{BIG}/pages.parquet"))
    found, vectors = html.read([page])
    kept = [t for (_, t, _), keep in zip(found[0], m.label(vectors)[0], strict=True) if keep]
    assert kept == lines


def test_long_pages_are_learnt_from(spark):
    page = "<article>" + "".join(f"<p>{FIRST} {i}" for i in range(2000)) + "</article>"
    (run, at, of), = html.sample(spark.createDataFrame([(page,), (page,), (None,), ("",)], "html string"))
    assert len(run) == html.RUN and of == 2000 and 0 <= at <= 2000 - html.RUN and html.silver(run).all()


def test_main_text_odd_pages(spark):
    rows = [(0, "u", None), (1, None, ""), (2, "u", "no tags at all"), (3, "u", "<p><p></div></b>" * 50), (3, "u", "<script>x"), (4, "u", PAGE), (None, "u", "<ul>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(1))
    got = html.main_text(df).collect()
    assert len(got) == 7 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert html.main_text(df.limit(0)).count() == 0
