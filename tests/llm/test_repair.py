"""Conversation repair against a search over all edits, over whole tables and in many short segments."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import defaultdict

from settings import SF

from launchgrid.llm import repair, turns

BLANKS = " \t\n\x0b\x0c\r"
TAIL = {"": "", "s": "ua", "u": "a", "a": ""}


def follows(last, initial):
    return (initial == "s" and last == "") or (initial == "u" and last in ("", "s", "a")) or (initial == "a" and last == "u")


def cheapest(rows):
    """(cost, audit, repaired lines) by Dijkstra on (cost, audit); rows: (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(out)
        if (i, last) in done:
            continue
        done.add((i, last))
        for r in ("user", "assistant"):
            if follows(last, r[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, r[0], (*out, r + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role and follows(last, role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if follows(last, r[0]):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, r[0], (*out, f"{r}:{text}")))


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def plain(rows):
    convs = {r[0]: [] for r in rows}
    for r in hurt(rows):
        convs[r[0]].append(r[1:])
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, marked, n = set(), [], defaultdict(int)
        for _, role, text in own:
            solid = text.strip(BLANKS)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
            n[fault] += 1
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, text = cheapest(marked)
        out[conv] = (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, rows):
    got = repair.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[n] for n in NAMES) == want[r.conv_id]


def made(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            rows.append((c, rng.choice([t, t, t, None, t + 3]), role, rng.choice(["Yes.", "no", "Well! ", "", " \t", "Why?", "ok\n", f"{t}."])))
    return rows


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_made_conversations_and_nulls(spark):
    check(spark, made(1, 150, 12) + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (7000, 1, "assistant", None), (-5, None, "user", "Go.")])


def test_long_runs_in_short_segments(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT_BITS", 2)
    rows = made(2, 6, 60) + [(100, t, "user", f"{t}.") for t in range(70)] + [(101, t, "assistant", "same.") for t in range(50)]
    check(spark, rows)


def test_a_run_is_its_powers():
    rng = random.Random(4)
    for _ in range(200):
        symbols = [s for s in (rng.randrange(9) for _ in range(5)) for _ in range(rng.randrange(1, 40))]
        one = repair.ONE
        for s in symbols:
            one = repair.times(one, repair.squared(s, 0))
        assert repair.product(symbols) == one


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Hello again."), (1, 3, "assistant", "Hi.")]
    out, audits = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert audits.first().audit == "KKIKK"
    assert [(r.role, r.text) for r in out.orderBy("at", "k").collect()] == [("system", "Be kind."), ("user", "Hello."), ("assistant", ""), ("user", "Hello again."), ("assistant", "Hi.")]


def test_empty_table(spark):
    assert repair.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
