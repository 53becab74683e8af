"""Cheapest repair of a conversation's structure, by a min-plus product over runs of equal symbols.

What a repaired conversation looks like: nothing, or an optional system turn and then user and
assistant in turns, an assistant last. The state after some repaired turns is one of four: nothing yet,
system, user, assistant. A row is one of nine symbols (role's initial, whether it's truncated,
or must go); each symbol is a 4 x 4 min-plus matrix of the cheapest edits from state to state. Consecutive equal
symbols are one run, and a run advances by cached squares of its matrix, so its cost takes as many
products as its length has binary digits.

Matrices compose, so a conversation of any length is worked on in segments (``turns``): each gives its
matrix; a fold over a conversation's few matrices gives each segment the costs to come; segments unroll
their choices from each state they may be entered in; a second fold picks the entered ones.

Costs: Keep 0, Rerole 3, Delete 4, Insert 3, and 3 for each truncated row that stays. Rows that are blank or
repeat an earlier role and text must be deleted. Of equally cheap edits the audit that is least in ASCII wins;
at each place the least letter that still leads to the least cost is taken.

Defined results: rows of one turn go by role, then text (``turns``); a null turn comes first; a null role or text is
one space; rows with a null conv_id are one conversation; equal rows are duplicates of the first; a role
without or with another initial can't be kept; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchgrid.llm.storage import bounded_batches, written
from launchgrid.llm.turns import in_order, segments, text_hash

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # by initial: state before to state after
TURN = (2, 2, 3, 2)  # the state after the only user or assistant turn that may follow
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
GONE = 8  # the symbol of rows that must go
FAR = 1 << 40
END = (0, 2 * INSERT, INSERT, 0)  # what the last inserts cost, by state

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def symbol(initial: int, fault: int) -> int:
    return GONE if fault in (BLANK, DUPLICATE) else 2 * initial + (fault == TRUNCATED)


# Codes of edits: K and D as in the audit; u and a insert a turn, U and A change a row's role.
LETTER = {"D": "D", "u": "I", "a": "I", "K": "K", "U": "R", "A": "R"}


def edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(code, state after, cost) of what can be done with a row."""
    out = [("D", state, DELETE)]
    if sym != GONE:
        cut = CUT * (sym % 2)
        if state in KEPT[sym // 2]:
            out.append(("K", KEPT[sym // 2][state], cut))
        out.append(("xxUA"[TURN[state]], TURN[state], REROLE + cut))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(x + y for x, y in zip(row, column, strict=True))) for column in zip(*b, strict=True)) for row in a)


def before(m: Matrix, v: Vector) -> Vector:
    """Costs to come before ``m``, from those after it."""
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in m)


ONE: Matrix = tuple(tuple(0 if s == t else FAR for t in range(4)) for s in range(4))


@cache
def squared(sym: int, k: int) -> Matrix:
    """The matrix of 2^k rows of a symbol; before a row, turns may be inserted."""
    if k:
        return times(squared(sym, k - 1), squared(sym, k - 1))
    insert = tuple(tuple(min(FAR if s != t else 0, INSERT if TURN[s] == t else FAR) for t in range(4)) for s in range(4))
    row = tuple(tuple(min((c for _, t2, c in edits(sym, s) if t2 == t), default=FAR) for t in range(4)) for s in range(4))
    return times(times(insert, insert), row)


def powers(sym: int, n: int) -> Iterator[Matrix]:
    """Matrices whose product is that of ``n`` rows of a symbol."""
    return (squared(sym, k) for k in range(n.bit_length()) if n >> k & 1)


def level(v: Vector) -> Vector:
    low = min(v)
    return tuple(x - low for x in v)


@cache
def step(sym: int, after: Vector) -> Vector:
    return level(before(squared(sym, 0), after))


@cache
def choice(sym: int, after: Vector, state: int) -> tuple[str, int]:
    """The codes that lead through a row with the least letters, and the state then."""
    costs = before(squared(sym, 0), after)
    codes = ""
    while True:
        ways = [(c + after[t], x, t) for x, t, c in edits(sym, state)] + [(INSERT + costs[TURN[state]], "xxua"[TURN[state]], TURN[state])]
        _, code, then = min((w for w in ways if w[0] == costs[state]), key=lambda w: LETTER[w[1]])
        codes, state = codes + code, then
        if LETTER[code] != "I":
            return codes, state


def runs_of(symbols: list[int]) -> list[tuple[int, int]]:
    return [(sym, sum(1 for _ in same)) for sym, same in groupby(symbols)]


def product(symbols: list[int]) -> Matrix:
    out = ONE
    for sym, n in runs_of(symbols):
        for m in powers(sym, n):
            out = times(out, m)
    return out


def unroll(symbols: list[int], after: Vector, state: int, last: bool) -> tuple[list[str], int]:
    """The codes for each row (what is inserted behind the last goes to it), and the state then."""
    runs, at_ends = runs_of(symbols), [level(after)]
    for sym, n in reversed(runs):
        v = at_ends[-1]
        for m in powers(sym, n):
            v = level(before(m, v))
        at_ends.append(v)
    out: list[str] = []
    for (sym, n), v in zip(runs, at_ends[-2::-1], strict=True):
        inside = [v]
        for _ in range(n - 1):
            inside.append(step(sym, inside[-1]))
        for v in reversed(inside):
            codes, state = choice(sym, v, state)
            out.append(codes)
    if last:
        out[-1] += ("", "ua", "a", "")[state]
    return out, state


def _flat(column: pa.Array) -> tuple[list[int], dict[str, np.ndarray]]:
    """Offsets and the fields of an array of structs; null numbers are left to ``valid_<name>``."""
    items = column.flatten()
    out = {}
    for field in items.type:
        x = items.field(field.name)
        out[field.name] = x.fill_null(0).to_numpy(zero_copy_only=False)
        out[f"valid_{field.name}"] = x.is_valid().to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(column.value_lengths().to_numpy())).tolist(), out


def _symbols(fields: dict[str, np.ndarray], i: int, j: int) -> list[int]:
    return [symbol(k, f) for k, f in zip(fields["initial"][i:j].tolist(), fields["fault"][i:j].tolist(), strict=True)]


LEGAL = {(0, 1), (1, 2), (2, 1)}
SUMMARY = "conv_id long, sid long, matrix array<int>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first_initial int, last_initial int"


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, f = _flat(batch.column("rows"))
        out = []
        for conv, sid, i, j in zip(batch.column("conv_id").to_pylist(), batch.column("sid").to_pylist(), offsets, offsets[1:], strict=False):
            initial, fault = f["initial"][i:j].tolist(), f["fault"][i:j]
            turns = f["turn"][i:j][f["valid_turn"][i:j]]
            counts = [int((fault == k).sum()) for k in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum(pair not in LEGAL for pair in zip(initial, initial[1:], strict=False))
            ends = (len(np.unique(turns)), int(turns[0]), int(turns[-1])) if len(turns) else (0, None, None)
            matrix = [min(x, FAR) if x < FAR else -1 for row in product(_symbols(f, i, j)) for x in row]
            out.append((conv, sid, matrix, *counts, illegal, *ends, initial[0], initial[-1]))
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        kinds = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "int": pa.int32()}
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, SUMMARY.split(", "), strict=True)], names=names)


COSTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, segs array<struct<sid: long, after: array<int>, first: boolean, last: boolean>>"


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's summaries, in order: its counts, its cost, and the costs to come after each segment."""
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            v, segs = END, []
            for p in reversed(parts):
                segs.append({"sid": p["sid"], "after": list(level(v)), "first": p is parts[0], "last": p is parts[-1]})
                flat = [FAR if x < 0 else x for x in p["matrix"]]
                v = before(tuple(tuple(flat[4 * s : 4 * s + 4]) for s in range(4)), v)
            known = [p for p in parts if p["turns"]]
            distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
            gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
            illegal = sum(p["illegal"] for p in parts) + sum((a["last_initial"], b["first_initial"]) not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
            out.append({"conv_id": conv, "gaps": gaps, **{k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": v[0], "segs": segs[::-1]})
        yield pa.RecordBatch.from_pylist(out, FOLDED)


_SEGS = pa.list_(pa.struct([("sid", pa.int64()), ("after", pa.list_(pa.int32())), ("first", pa.bool_()), ("last", pa.bool_())]))
FOLDED = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("segs", _SEGS)])
WAYS = pa.schema([("conv_id", pa.int64()), ("sid", pa.int64()), ("ats", pa.list_(pa.int64())), ("ways", pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("codes", pa.list_(pa.string()))])))])


def _unrolled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's codes, from every state that it may be entered in."""
    for batch in batches:
        offsets, f = _flat(batch.column("rows"))
        given = [batch.column(c).to_pylist() for c in ("conv_id", "sid", "after", "first", "last")]
        out = []
        for conv, sid, after, first, last, i, j in zip(*given, offsets, offsets[1:], strict=False):
            symbols, ways = _symbols(f, i, j), []
            for state in range(1 if first else 4):
                codes, leave = unroll(symbols, tuple(after), state, last)
                ways.append({"enter": state, "leave": leave, "codes": codes})
            out.append({"conv_id": conv, "sid": sid, "ats": f["at"][i:j].tolist(), "ways": ways})
        yield pa.RecordBatch.from_pylist(out, WAYS)


def _entered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sids, states = [], []
        for parts in batch.column("parts").to_pylist():
            state = 0
            for p in parts:
                sids.append(p["sid"])
                states.append(state)
                state = p["leaves"][state]
        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(states, pa.int32())], names=["sid", "enter"])


def marked(ordered: DataFrame) -> DataFrame:
    """(conv_id, at, turn, initial, fault) of each row; no text."""
    h1, h2 = text_hash("text")
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = ordered.select("conv_id", "at", "turn", "role", h1.alias("h1"), h2.alias("h2"), (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("open"))
    firsts = rows.filter(~F.col("blank")).groupBy("conv_id", "role", "h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    a, b = rows.alias("a"), firsts.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(NONE)
    initial = F.when(F.col("a.role") == "", 0).otherwise(F.position(F.left("a.role", F.lit(1)), F.lit(INITIALS)))
    return a.join(b, same, "left").select("a.conv_id", "at", "turn", F.when(initial > 0, initial - 1).otherwise(3).alias("initial"), fault.alias("fault"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, audits) of conversation rows (conv_id, turn, role, text).

    ``turns``: conv_id, at, k, role, text of each repaired turn, in order of (at, k) in a conversation.
    ``audits``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    bounded_batches(rows.sparkSession)
    space = F.lit(" ")
    ordered = in_order(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")))
    marks = marked(ordered)
    segs = written(segments(marks, turn=F.col("turn"), initial=F.col("initial"), fault=F.col("fault")), "segments")
    parts = segs.mapInArrow(_summaries, SUMMARY)
    names = [x.split()[0] for x in SUMMARY.split(", ")][1:]
    folded = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("parts")).mapInArrow(_fold, COSTS)
    folded = written(folded, "costs")
    to_come = folded.select(F.explode("segs").alias("s")).select("s.*")
    kinds = "conv_id long, sid long, ats array<long>, ways array<struct<enter: int, leave: int, codes: array<string>>>"
    ways = written(segs.join(to_come, "sid").mapInArrow(_unrolled, kinds), "ways")
    chain = ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("sid", F.col("ways.leave").alias("leaves")))).alias("parts"))
    entered = chain.mapInArrow(_entered, "sid long, enter int")
    way = F.col("ways")[F.when(F.size("ways") == 1, 0).otherwise(F.col("enter"))]
    taken = written(ways.join(entered, "sid").select("conv_id", "sid", "ats", way["codes"].alias("codes")), "codes")
    pieces = F.sort_array(F.collect_list(F.struct("sid", F.array_join("codes", "").alias("x"))))
    letters = F.translate(F.array_join(F.transform(pieces, lambda p: p["x"]), ""), "".join(LETTER), "".join(LETTER.values()))
    a, b = folded.alias("a"), taken.groupBy("conv_id").agg(letters.alias("audit")).alias("b")
    counts = (f"a.{c}" for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    audits = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select(*counts, "b.audit")
    return _turns(ordered, taken), audits


def _turns(ordered: DataFrame, taken: DataFrame) -> DataFrame:
    """The repaired turns, from each row's codes; rows that only go are not read."""
    coded = taken.select(F.explode(F.arrays_zip("ats", "codes")).alias("e")).select(F.col("e.ats").alias("at"), F.col("e.codes").alias("codes")).filter("codes <> 'D'")
    each = ordered.select("conv_id", "at", "role", "text").join(coded, "at").select("conv_id", "at", "role", "text", F.posexplode(F.split("codes", "")).alias("k", "code"))
    role = F.when(F.lower("code") == "u", "user").when(F.lower("code") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("code").isin("u", "a"), "").otherwise(F.col("text"))
    return each.filter("code in ('u', 'a', 'U', 'A', 'K')").select("conv_id", "at", "k", role.alias("role"), text.alias("text"))


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted rows (conv_id, line), joined by newlines; a conversation is never held."""
    now, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    yield done()
                now, digest = conv, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
    if digest is not None:
        yield done()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of "conv_id:turn" modulo 20: 0 no row, 1 no text, 2 no end marks, 3 twice, 4 a user's. Nulls are one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))).cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", space))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation: what the damage did, the cheapest repair, and the digest of what it gives."""
    turns, audits = repair(damaged(conversations))
    lines = turns.select("conv_id", "at", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").select("conv_id", "line").mapInArrow(_streamed, "conv_id long, repaired_sha256 string")
    all_ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    a, b, c = all_ids.alias("a"), audits.alias("b"), hashes.alias("c")
    both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").join(c, F.col("a.conv_id").eqNullSafe(F.col("c.conv_id")), "left")
    counts = [F.coalesce(f"b.{n}", F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return both.select("a.conv_id", *counts, F.coalesce("b.audit", F.lit("")).alias("audit"), F.coalesce("c.repaired_sha256", nothing).alias("repaired_sha256"))
