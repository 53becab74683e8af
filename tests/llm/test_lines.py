"""Line deduplication against a plain version, runs that outlast a session, odd rows."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F
from tables import no_documents, odd_documents

from launchgrid.llm import lines


def key(line):
    out = line.strip(" \t\n\x0b\x0c\r").encode()
    return out.lower().decode()  # of bytes: A-Z only


def plain(rows, at_least=5, least=40):
    """(id, kept text, lines, dropped) of each row."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if i is None or len(holders.get(key(x), ())) < at_least or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(split), len(split) - len(kept)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    common = ["A Common Line That Is Long Enough To Count, number %d" % k for k in range(6)] + ["É" * 40, "é" * 40, "x" * 39, "İ" * 41, "short"]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 7)):
            x = rng.choice(common)
            parts.append(rng.choice([x, "  " + x.upper() + "\t", x + "\x0b", x.lower()]) if rng.random() < 0.8 else "")
        rows.append((rng.randrange(25) if rng.random() < 0.3 else 100 + i, "\n".join(parts) if rng.random() < 0.9 else None))
    return rows + rows[:3] + [(None, common[0] + "\n" + common[1]), (None, None)] + [(-7, common[2])]


def test_agrees_with_plain_version(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in got), key=str) == plain(rows)


def test_digest_of_what_is_kept(spark):
    rows = [(i, "the same line, long enough to be counted here\nown " + str(i)) for i in range(6)]
    got = {r.doc_id: r for r in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].kept_sha256 == hashlib.sha256(b"own 3").hexdigest() and got[3].n_dropped == 1
    assert got[5].kept_sha256 == hashlib.sha256(rows[5][1].encode()).hexdigest() and got[5].n_dropped == 0


def test_runs_are_merged_by_level_and_outlast_a_session(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted({(i, k, -k) for i in range(80) for k in rng.sample(range(30), 3)})
    folder = f"file://{tmp_path}/runs"
    for k in range(7):
        runs = lines.Runs(spark, folder)  # as another session would
        runs.add(spark.createDataFrame([r for r in rows if r[0] % 7 == k], "id long, h1 long, h2 long"))
    assert [len(level) for level in lines.Runs(spark, folder).levels] == [1, 1, 1]
    holders = defaultdict(set)
    for i, a, b in rows:
        holders[a, b].add(i)
    want = {(*k, max(v)) for k, v in holders.items() if len(v) >= 5}
    assert {tuple(r) for r in lines.Runs(spark, folder).frequent(5).collect()} == want
    table = lines.Runs(spark, folder)
    held = [r for level in table.levels for name in level for r in table.table(name).filter("fresh").collect()]
    assert len(held) == len({(r.h1, r.h2) for r in held}) == len(holders)  # a key is fresh in one run only


def test_a_batch_moves_no_run(spark):
    runs = lines.Runs(spark)
    for k in range(2):
        runs.add(spark.createDataFrame([(k, 5, 6), (k, k, k)], "id long, h1 long, h2 long"))
    own = spark.createDataFrame([(9, 5, 6)], "id long, h1 long, h2 long").groupBy("h1", "h2").count()
    known = runs.table(runs.levels[1][0]).select("h1", "h2", "n")
    plan = own.join(known.hint("merge"), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("n_lines", F.lit("clash")).withColumn("places", F.lit("clash"))
    got = lines.deduplicated(docs).collect()
    assert len(got) == docs.count() and {"n_lines", "n_lines_", "n_dropped", "places"} <= set(got[0].asDict())
    assert all(r.n_dropped == 0 for r in got)
    assert lines.deduplicated(no_documents(spark)).collect() == []
