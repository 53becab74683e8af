"""Near duplicates and the pipeline against brute force."""

import random
import re

import numpy as np
from settings import SF
from pyspark.sql import functions as F
from tables import odd_documents, no_documents

from launchgrid.llm import graph, neardup, pii, quality

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts, threshold=85):
    """(component of each id, size of each set)."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def check(df, threshold=0.85):
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    component, size = brute(texts, round(100 * threshold))
    rows = neardup.near_duplicates(df, threshold).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert (r.component_id, r.n_shingles, r.kept) == (component[r.doc_id], size[r.doc_id], component[r.doc_id] == r.doc_id)


def test_near_duplicates(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def chained(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(6):
        base = [r.choice(words) for _ in range(90)]
        for step in range(25):  # each copy edits the one before or the first: chains, and pairs about the threshold
            source = list(base)
            for _ in range(r.randrange(4)):
                source[r.randrange(len(source))] = r.choice(words)
            rows.append((n, " ".join(source).upper() if step % 5 == 0 else " ".join(source)))
            n += 1
            if r.random() < 0.5:
                base = source
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


def test_chains_and_near_misses(spark):
    for threshold in (0.85, 0.8):
        check(chained(spark), threshold)


def test_odd_documents(spark):
    odd = odd_documents(spark).filter("doc_id is not null")
    check(odd)
    rows = neardup.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 11 and [r.kept for r in rows if r.doc_id is None] == [True]
    assert neardup.near_duplicates(no_documents(spark)).count() == 0
    assert neardup.deduplicated(odd_documents(spark)).columns == odd.columns


def test_equal_ids_are_one_document(spark):
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "p q r s t u v"), (1, "p q r s t u v"), (9, "a b c d e f g")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()} == {(5, 1), (1, 1), (9, 1)}


def test_links_of_an_id_with_several_texts_are_kept(spark):
    run = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, run("x", 60)), (5, run("x", 60) + " tail"), (5, run("a", 300)), (9, run("a", 300) + " tail"), (20, run("b", 90)), (30, run("b", 90) + " end"), (30, run("c", 90)), (30, run("d", 40)), (7, run("d", 40))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (9, 1), (20, 7), (30, 7), (7, 7)} and len(got) == len(rows)


def test_bands_follow_the_threshold():
    assert (neardup.bands_for(0.85), neardup.bands_for(0.8)) == (25, 37)
    assert (neardup.fewest_equal_bits(0.85), neardup.fewest_equal_bits(0.8)) == (101, 95)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for share in (0.5, 0.9):
        k = int(1000 * share)
        sets = [np.unique(a), np.unique(np.concatenate([a[:k], rng.integers(0, 2**63, 1000 - k, dtype=np.uint64)]))]
        sig = neardup.superminhash(sets)
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.13
    small = neardup.superminhash([a[:3], a[:3][::-1].copy(), a[:0]])
    assert (small[0] == small[1]).all() and (small[2] == neardup._EMPTY).all() and (small[0] != neardup._EMPTY).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.m for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = p.keep_quality(spark, docs, SF).cache()
    want = {r.doc_id for r in quality.assess(docs, labels).filter("predicted = 1").collect()}
    assert good.columns == list(p.COLUMNS) and {r.doc_id for r in good.collect()} == want
    single = p.drop_near_duplicates(spark, good, SF).cache()
    component, _ = brute({r.doc_id: r.text for r in good.collect()}, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, c in component.items() if i == c}
    clean = p.redact_personal_data(spark, single, SF).cache()
    assert clean.columns == list(p.COLUMNS) and clean.count() == single.count()
    left = pii.digests(clean).agg(*(F.sum(f"n_{k}") for k in pii.KINDS)).first()
    assert list(left) == [0, 0, 0, 0]
    assert clean.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    packed = p.pack_tokens(spark, clean, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}
    # Partitions pack on their own, so pieces may be cut elsewhere; what is packed is the same.
    whole = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    assert whole(p.run(spark, SF)) == whole(packed)


def test_pipeline_of_odd_and_empty_tables(spark):
    import corpus_pipeline as p

    base = spark.read.parquet(f"{SF}/documents.parquet").select(*p.COLUMNS)
    odd = odd_documents(spark).withColumn("n_chars", F.char_length("text").cast("long"))
    for docs in (odd, odd.limit(0)):
        for name, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, SF).cache()
            assert docs.columns == list(p.COLUMNS), name
        packed = p.STAGES[-1][1](spark, docs, SF)
        ids = lambda df: {r.doc_id for r in df.select("doc_id").distinct().collect()}
        assert ids(packed) == ids(docs)
    # What the learnt stage keeps is the corpus's affair; the others must not lose an odd row.
    mixed = base.unionByName(odd.select(*p.COLUMNS).withColumn("doc_id", F.col("doc_id") + 10**6))
    single = p.drop_near_duplicates(spark, mixed, SF).cache()
    kept = single.filter(f"doc_id >= {10**6} or doc_id is null").collect()
    assert sorted((r.doc_id is None, (r.doc_id or 0) % 10**6) for r in kept) == sorted([(False, i) for i in (0, 1, 2, 3, 3, 4, 5, 6, 7)] + [(True, 0)])


def test_a_large_band_is_compared_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GRID", 3)
    rows = spark.createDataFrame([(i % 2, i) for i in range(41)], "band long, rep long")
    x, y = neardup._grid(rows)
    met = x.join(y, F.col("x.cell") == F.col("y.cell")).select("x.rep", "y.rep", "x.band", "y.band").collect()
    assert len(met) == len(set(met)) == sum(1 for a in range(41) for b in range(41) if a % 2 == b % 2)
    check(chained(spark), 0.8)


def test_components_around_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HUB", 5)
    edges = [(7, i) for i in range(100, 400)] + [(i, i + 1000) for i in range(100, 200)] + [(3, 1150), (None, 5), (5, None)]
    got = {r.v: r.m for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {v: 3 for e in edges for v in e if None not in e and v != 3}
