"""The prefix trie against one built of whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from settings import SF

from launchgrid.llm import trie, turns


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for x in own.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(r[1:] for r in own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in below[path]) or 1
        saved[path] = sum(saved[p] for p in below[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def check(spark, rows):
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("d", F.lit("clash"))).collect()
    assert sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in got) == plain(rows)


def made(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(350), convs):
        n = rng.randrange(longest)
        like = rng.random() < 0.6
        for t in range(n):
            text = f"turn {t}" if like and rng.random() < 0.9 else rng.choice(["a", "b", "é😀", "", None])
            rows.append((c, rng.choice([t, t, t, t // 2, None]), rng.choice(["user", "user", "assistant", None]) if not like else "user", text))
    return rows


def test_whole_table(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_made_conversations_and_nulls(spark):
    check(spark, made(1, 200, 9) + [(None, 1, "user", "x"), (100, None, None, None), (100, None, None, None)])


def test_short_segments_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT_BITS", 2)
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(trie, "IDS_BITS", 1)
    check(spark, made(2, 60, 9) + [(c, t, "user", f"turn {t}") for c in (300, 320, 340, 360) for t in range(40 + c % 7)])


def test_equal_fingerprints_of_unequal_prefixes_are_found(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "b")]
    ordered = turns.in_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    a, b = (r.at for r in ordered.orderBy("at").collect())
    steps = spark.createDataFrame([(1, 1, b"x", b"", a, 1, True), (2, 1, b"x", b"", b, 1, True)], trie.STEPS)
    assert trie.unequal(steps, trie.nodes_of(steps), ordered).count() == 1
    same = spark.createDataFrame([(1, 1, b"x", b"", a, 1, True), (2, 1, b"x", b"", a, 1, True), (3, 1, b"y", b"", b, 1, True)], trie.STEPS)
    assert trie.unequal(same, trie.nodes_of(same), ordered).count() == 0


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
