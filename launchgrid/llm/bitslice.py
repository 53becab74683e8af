"""Exact top-k inner products by a bit-sliced index.

Rows are dealt into blocks. In a block, each component's quantised values are held as bit
slices: one bitmap over the block's rows for each binary digit. A query's score is a sum of
slices, each shifted by the digits of the query's component, made with bitmap arithmetic
(full adders over whole bitmaps). The rows with the highest sums are then selected from the
most significant slice of the sum downward; rows that tie at the boundary are taken by the
smaller id. The scores of the rows selected are read back from the slices, exactly.

A stated query set meets all rows, in blocks: the index stays where it is written, and queries
come to it in rounds of at most ROUND_BYTES, which are broadcast. Where blocks are fewer than
the cluster's cores, a block's queries are shared among several tasks. A block's best k per query
are merged by rank.

Defined results: rows whose id or vector is null, or whose vector holds a null or non-finite
component, take no part. Shorter vectors count as padded with zeros. Rows of one id count
as one row, with the greatest of their vectors. Ids are whole numbers. An empty
table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchgrid.llm.storage import written

BLOCK, WIDE_BLOCK, TOP = 1 << 15, 1 << 11, 5
NARROW = 1 << 16  # of a component
ROUND_BYTES = 1 << 25


def slices_of(values: np.ndarray, digits: int) -> np.ndarray:
    """Bitmaps [component, digit, words] of non-negative ``values`` [rows, components]."""
    n = len(values)
    out = np.zeros((values.shape[1], digits, -(-n // 64) * 8), np.uint8)
    for d in range(digits):
        packed = np.packbits((values >> d & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, d, : packed.shape[1]] = packed
    return out.view(np.uint64)


def add_up(slices: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Bitmaps of sum over components of query x value, plus a constant; least digit first.

    A negative component adds its complement slices, so only additions are needed.
    """
    digits = slices.shape[1]
    size = np.abs(query)
    waiting: dict[int, list[np.ndarray]] = {}
    plus, minus = slices, None
    for t in range(int(size.max(initial=0)).bit_length()):
        chosen = (size >> t & 1 == 1).astype(bool)
        up, down = np.flatnonzero(chosen & (query > 0)), np.flatnonzero(chosen & (query < 0))
        for d in range(digits):
            if len(up):
                waiting.setdefault(t + d, []).append(plus[up, d])
            if len(down):
                waiting.setdefault(t + d, []).append(~plus[down, d])
    out, w = [], 0
    while waiting:
        rows = np.concatenate(waiting.pop(w)) if w in waiting else np.zeros((0, slices.shape[2]), np.uint64)
        carries = []
        while len(rows) > 1:
            k = len(rows) // 3
            if k:
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                half = a ^ b
                carries.append(a & b | c & half)
                rows = np.concatenate([half ^ c, rows[3 * k :]])
            else:
                carries.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        out.append(rows[0] if len(rows) else np.zeros(slices.shape[2], np.uint64))
        if carries:
            waiting.setdefault(w + 1, []).extend(carries)
        w += 1
    return np.array(out) if out else np.zeros((1, slices.shape[2]), np.uint64)


def select_top(total: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` greatest sums of rows in the bitmap ``among``; ties by position."""
    sure, maybe = np.zeros_like(among), among.copy()
    if int(np.bitwise_count(among).sum()) > k:
        for digit in total[::-1]:
            higher = sure | maybe & digit
            n = int(np.bitwise_count(higher).sum())
            if n > k:
                maybe &= digit
            else:
                sure = higher
                maybe &= ~digit
                if n == k:
                    maybe[:] = 0
                    break
    places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    best = places(sure)
    return np.concatenate([best, places(maybe)[: k - len(best)]])


def _values(slices: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[rows, components] read back from the slices."""
    digit = (slices[:, :, at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(_kind(slices.shape[1]))
    return (digit << np.arange(slices.shape[1]).astype(digit.dtype)[None, :, None]).sum(1).T


def _kind(bits: int) -> type:
    """What holds whole numbers of so many bits."""
    return np.int64 if bits < 63 else object


def _bits(values: np.ndarray) -> int:
    return int(np.abs(values).max(initial=0)).bit_length()


def quantised(vectors: list, width: int, scale: int) -> np.ndarray:
    """floor(scale x component), [rows, width], shorter vectors filled up with 0; Python's numbers where 64 bits are too few."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    if np.abs(x).max(initial=0) < NARROW:
        return np.floor(scale * x).astype(np.int64)
    exact = [[math.floor(scale * c) if abs(c) < NARROW else scale * math.floor(c) + math.floor(scale * (c % 1)) for c in row] for row in x.tolist()]
    return np.array(exact, object).reshape(x.shape)


def order_key(n: int) -> bytes:
    """Bytes that sort as whole numbers of any size do."""
    if n < 0:
        return bytes(255 - b for b in order_key(-n - 1))
    size = (n.bit_length() + 7) // 8
    return b"\x80" + size.to_bytes(2, "big") + n.to_bytes(size, "big")


def products(values: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products, as Python's numbers."""
    wide = _bits(values) + _bits(query) + len(query).bit_length() >= 63
    return (values.astype(object) @ query.astype(object) if wide else values @ query).tolist()


def top_products(vectors: DataFrame, is_query: F.Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``is_query`` (of the id column), the
    ``k`` other rows with the greatest inner product of floor(scale x component).

    Any finite components will do: rows with one of NARROW or more lie in blocks of their own, with as many slices as they need.
    Rows are ranked by the exact product; one that 64 bits cannot hold is given as the nearest number that they can.
    """
    spark, x = vectors.sparkSession, F.col(vector_col)
    whole = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    parts = vectors.filter(whole).select(F.col(id_col).alias("id"), F.transform(x, lambda c: c.cast("double")).alias("v"), is_query.alias("asks"))
    rows = parts.groupBy("id").agg(F.max("v").alias("v"), F.max("asks").alias("asks"))
    rows = written(rows.withColumn("wide", F.exists("v", lambda c: F.abs(c) >= NARROW)), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_if("wide").alias("n_wide"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("width")).first()
    width, blocks, wide_blocks = size.width or 0, max(1, -(-size.n // BLOCK)), max(1, -(-size.n_wide // WIDE_BLOCK))
    rounds = max(1, -(-size.q // max(1, ROUND_BYTES // (8 * (width + 1)))))
    shares = max(1, min(8, -(-2 * spark.sparkContext.defaultParallelism // blocks)))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        values = quantised(pdf.v.tolist(), width, scale)
        low = int(values.min(initial=0))
        digits = max(1, (int(values.max(initial=0)) - low).bit_length())
        s = slices_of(values - low, digits)
        return pd.DataFrame({"block": pdf.block.iloc[:1], "ids": [pdf.id.to_numpy("<i8").tobytes()], "slices": [s.tobytes()], "low": [str(low)], "digits": [digits]})

    def search(asked) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            every_id, every_vector = asked.value
            for batch in batches:
                for r in batch.itertuples():
                    ids = np.frombuffer(r.ids, "<i8")
                    slices = np.frombuffer(r.slices, np.uint64).reshape(width, r.digits, -1)
                    every = np.zeros(slices.shape[2] * 8, np.uint8)
                    every[: -(-len(ids) // 8)] = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
                    found: list[tuple[int, int, int]] = []
                    for q, vector in zip(every_id[r.share :: shares], every_vector[r.share :: shares], strict=True):
                        among = every.copy()
                        own = np.searchsorted(ids, q)
                        if own < len(ids) and ids[own] == q:
                            among[own // 8] &= np.uint8(255 - (1 << own % 8))
                        best = select_top(add_up(slices, vector), among.view(np.uint64), k)
                        values = _values(slices, best) + int(r.low)
                        found += [(q, i, s) for i, s in zip(ids[best].tolist(), products(values, vector), strict=True)]
                    if found:
                        of, near, score = zip(*found, strict=True)
                        held = [max(-(2**63), min(2**63 - 1, s)) for s in score]
                        yield pd.DataFrame({"query_id": of, "id": near, "score": np.array(held, np.int64), "exact": [order_key(s) for s in score]})

        return run

    def in_round(turn: int) -> DataFrame:
        asks = rows.filter("asks").filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)) == turn).select("id", "v", "wide").toPandas()
        vectors = [quantised([v], width, scale)[0] for v in asks.v]
        asked = spark.sparkContext.broadcast((asks.id.tolist(), vectors))
        found = made.mapInPandas(search(asked), "query_id long, id long, score long, exact binary")
        return found if rounds == 1 else written(found, "found")

    hashed = F.xxhash64("id")
    block = F.when(F.col("wide"), blocks + F.pmod(hashed, F.lit(wide_blocks))).otherwise(F.pmod(hashed, F.lit(blocks)))
    made = written(rows.select(block.alias("block"), "id", "v").groupBy("block").applyInPandas(index, "block long, ids binary, slices binary, low string, digits int"), "slices")
    made = made.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    if shares > 1:
        made = made.repartition(blocks * shares, "block", "share")
    found = reduce(DataFrame.unionByName, map(in_round, range(rounds)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
