"""Connected components of an edge table, by union-find in tasks and star rounds between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchgrid.llm.storage import written

UNITE_AT = 500_000
LEAST_HUB, HUBS = 100, 100_000


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by node-to-smallest-node edges, a bounded number at a time."""

    def forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        root = np.array([find(x) for x in range(len(nodes))])
        far = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["v", "m"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= UNITE_AT:
            yield forest(held)
            held, n = [], 0
    if n:
        yield forest(held)


def _with_least(rows: DataFrame, key: str, value: str, hub: int) -> DataFrame:
    """``rows`` with m, the least of a row's key and all values of that key.

    A key of ``hub`` rows or more would send them all to one task: such keys are at most
    HUBS, so their least values are broadcast and their rows stay where they are.
    """
    least = rows.groupBy(key).agg(F.least(key, F.min(value)).alias("m"), F.count("*").alias("n"))
    known = rows.join(F.broadcast(least.filter(F.col("n") >= hub).select(key, "m")), key, "left")
    return known.filter("m is not null").unionByName(known.filter("m is null").drop("m").join(least.filter(F.col("n") < hub).select(key, "m"), key))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, m) for every node v of ``edges`` (a, b: long) but the smallest of each component: m is
    that smallest node. An edge with a null end links nothing. No edges: no rows.

    Each round is a large-star and a small-star step (Kiveris et al., 2014): a node's larger
    neighbours move to its least neighbour, then its smaller ones do; the rounds end when
    every edge is (node, least of its component). Rounds grow with the logarithm of the
    longest chain. Each is written, so a lost executor costs one round at most.
    """
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    now = written(ends.mapInArrow(_unite, "v long, m long"), "edges")
    size, seen = now.count(), None
    for _ in range(most_rounds):
        hub = max(LEAST_HUB, -(-2 * size // HUBS))
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select(F.col("m"), F.col("v")))
        large = written(_with_least(both, "u", "w", hub).filter("w > u").select(F.col("w").alias("v"), "m").distinct(), "edges")
        small = _with_least(large.withColumnRenamed("m", "w"), "v", "w", hub)
        now = written(small.select(F.when(F.col("w") == F.col("m"), F.col("v")).otherwise(F.col("w")).alias("v"), "m").distinct(), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m") % 1_000_003), F.bit_xor(F.xxhash64("m", "v"))).first()
        if mark == seen:
            return now.groupBy("v").agg(F.min("m").alias("m"))
        seen, size = mark, mark.n
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
