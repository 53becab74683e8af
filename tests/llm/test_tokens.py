"""Byte-level BPE and packing against the public tokenizers."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from settings import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import odd_documents, no_documents
from tokenizers import Tokenizer

from launchgrid.llm import bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(text=st.text(max_size=300) | st.text(alphabet="ab é\n'1", max_size=400))
def test_encoder_agrees_on_any_text(reference, text):
    own = np.frombuffer(bpe._Encoder.of(RANKS, P.PATTERN).ids([text])[0], "<i4").tolist()
    assert own == reference.encode_ordinary(text)


def test_long_matches(reference):
    rng = np.random.default_rng(0)
    for n in (63, 64, 65, 500, 3000):
        text = "".join(rng.choice(list("abcdeé"), n))
        assert np.frombuffer(bpe._Encoder.of(RANKS, P.PATTERN).ids([text])[0], "<i4").tolist() == reference.encode_ordinary(text)


def check_digests(rows, reference):
    for r in rows:
        ids = reference.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_digests(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_digests(bpe.digests(docs, RANKS, P.PATTERN).join(docs.select("doc_id", "text"), "doc_id").collect(), reference)


def test_odd_documents(spark, reference):
    odd = odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = bpe.digests(odd, RANKS, P.PATTERN).join(odd.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 9
    check_digests(rows, reference)
    assert bpe.digests(odd_documents(spark), RANKS, P.PATTERN).count() == 11
    assert bpe.digests(no_documents(spark), RANKS, P.PATTERN).count() == 0


def check_packing(pieces, texts, library, window=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array([*library(texts[doc] or ""), 0], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at & (at - 1) == 0


def test_packing(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(packing.pack(docs, JSON).collect(), {r.doc_id: r.text for r in docs.collect()}, library)


def test_packing_odd_documents(spark, library):
    odd = odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(odd, JSON).collect(), {r.doc_id: r.text for r in odd.collect()}, library)
    assert packing.pack(odd_documents(spark), JSON).select("doc_id").distinct().count() == 10
    assert packing.pack(no_documents(spark), JSON).count() == 0


def test_sum_of_squares_prefers_a_perfect_fit():
    p = packing.SumOfSquares(10, 0)
    for doc, n in enumerate([6, 5, 4]):
        p.add(doc, np.zeros(n, "<u4"))
    assert [(d[0], d[5], d[6]) for d in p.take()] == [(0, 0, 0), (2, 0, 6)]
    assert p.count[5] == 1 and p.count.sum() == 1
    p.close()
    assert [d[2] for d in p.take()] == [4, 1]


MARKED = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b\n<|endoftext|", "  <|endoftext|>  x", "none here"]


@pytest.mark.parametrize("added", [False, True])
def test_added_tokens_as_the_library_has_them(added):
    t = Tokenizer.from_file(JSON)  # as it is, it makes them tokens of their own
    t.encode_special_tokens = not added
    own = packing.load_tokenizer(JSON, added)
    for text in MARKED:
        assert own(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_marked_documents_are_packed_either_way(spark):
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    for added in (False, True):
        t = Tokenizer.from_file(JSON)
        t.encode_special_tokens = not added
        check_packing(packing.pack(docs, JSON, added_tokens=added).collect(), dict(enumerate(MARKED)), lambda x, t=t: t.encode(x, add_special_tokens=False).ids)


def test_placement_fills_most_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for parts, least in ((32, 0.6), (1, 0.95)):
        pieces = packing.pack(docs.repartition(parts), JSON).collect()
        met = [p for p in pieces if p.length < 1024]
        assert sum(p.length for p in met if p.placed) > least * sum(p.length for p in met)


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), max_size=60), window=st.sampled_from([8, 10, 16]), levels=st.integers(1, 16))
def test_any_pieces_fill_windows_without_gaps(sizes, window, levels):
    p = packing.SumOfSquares(window, 5, levels)
    for doc, n in enumerate(sizes):
        p.add(doc, np.arange(n, dtype="<u4"))
        assert p.count.tolist() == [len(x) for x in p.open] and all(w[0] < window for x in p.open for w in x)
    p.close()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, seq, at, _ in p.take():
        assert crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes()) and total == sizes[doc]
        by_doc[doc].append((start, length))
        by_seq[seq].append((at, length))
    for spans, end in [*((v, sizes[d]) for d, v in by_doc.items()), *((v, None) for v in by_seq.values())]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == (end or at) and (end or at == window or at & (at - 1) == 0)
    assert len(by_doc) == len(sizes)
