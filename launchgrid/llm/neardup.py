"""Near-duplicate documents by SuperMinHash signatures.

A text's set is its distinct runs of five words (A-Z as a-z). SuperMinHash gives every
element of a set a correlated sequence: at step j a random rank in [j, j+1) for the
j-th slot of the element's own permutation of the slots. A slot keeps its least rank.
As ranks only grow with j, a set stops when each of its slots is filled: about one step
for a long text. Signatures are banded; texts that share a band are candidates; links
are confirmed by counting common shingles of the whole sets.

1. Texts of one set form one class: everything after works on classes.
2. In each band, every class is compared with one pivot, another class for each band, and
   confirmed links are united. Bands that still hold different components do so once more,
   with other pivots.
3. What a band still holds of different components is compared within the join: a sketch of
   one bit a slot rules out pairs far below the threshold, then the whole sets are counted.
   A band of more than GRID classes is a grid of such joins, each of some GRID rows by as many.
   Only links come out of it. So every pair that shares a band is either confirmed, or in
   one component already, or ruled out; no group of copies is expanded into its pairs,
   and none is capped.

Bands have 5 slots and are as many as it takes to miss a pair at the threshold with probability
below MISSED: 25 for 0.85, 37 for 0.8. The sketch rules one out with about 1e-8.

Defined results: a null, empty or blank text has no shingles and is its own component; a
text of one to four words has one shingle, all its words; equal ids count as one document
of which every row is returned; rows with a null id are returned with a null component and
kept. Ids are whole numbers. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchgrid.llm.graph import components
from launchgrid.llm.storage import bounded_batches, written
from launchgrid.llm.textkit import mix, shingles, slices, utf8, words

SLOTS, ROWS = 128, 5
SHINGLE = 5
MISSED = 5e-7  # the share of pairs at the threshold that may share no band
DEVIATIONS = 5.8  # how far below its mean, at the threshold, a sketch's agreement may be
GRID = 512  # classes of a band that one join compares with as many
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, 257, dtype=np.uint64) * _STEP
_EMPTY = np.uint64(2**64 - 1)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` ranks for each set of 64-bit elements; an empty set keeps all ones."""
    sig = np.full((len(sets), slots), _EMPTY, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Step 0 needs no permutation: the slot is a hash of the element.
    r = mix(elements + _STEP)
    np.minimum.at(sig.ravel(), owner * slots + ((r >> np.uint64(33)) % np.uint64(slots)).astype(np.int64), r & np.uint64(0xFFFFFFFF))
    open_sets = np.flatnonzero((sig == _EMPTY).any(1) & (sizes > 0))
    ends = np.cumsum(sizes)
    i = 0
    while i < len(open_sets):  # some sets at a time: their permutations are held
        j, n = i, 0
        while j < len(open_sets) and (j == i or n + sizes[open_sets[j]] <= 40_000):
            n += sizes[open_sets[j]]
            j += 1
        group = open_sets[i:j]
        rows = np.repeat(group, sizes[group])
        own = np.concatenate([elements[ends[g] - sizes[g] : ends[g]] for g in group])
        perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(own), slots)).copy()
        for step in range(slots):
            r = mix(own + _STEPS[step])
            at = np.arange(len(own))
            k = step + ((r >> np.uint64(33)) % np.uint64(slots - step)).astype(np.int64)
            slot = perm[at, k]
            perm[at, k] = perm[:, step]
            if step:
                np.minimum.at(sig.ravel(), rows * slots + slot, r & np.uint64(0xFFFFFFFF) | np.uint64(step << 32))
            done = (sig[group] >> np.uint64(32)).max(1) <= step
            if done.all():
                break
            if done.any():
                group = group[~done]
                keep = np.isin(rows, group)
                rows, own, perm = rows[keep], own[keep], perm[keep]
        i = j
    return sig


def bands_for(threshold: float) -> int:
    """How many bands of ROWS slots a threshold needs."""
    return math.ceil(math.log(MISSED) / math.log(1 - threshold**ROWS))


def fewest_equal_bits(threshold: float) -> int:
    """Of the 128 bits of two sketches, how many must agree for a pair to be looked at."""
    p = (1 + threshold) / 2
    return math.floor(128 * p - DEVIATIONS * math.sqrt(128 * p * (1 - p)))


def _sets(part: pa.RecordBatch) -> list[np.ndarray]:
    raw, offs = utf8(part.column("text"))
    hashes, _, _, counts = words(raw, offs)
    return list(shingles(hashes, counts, SHINGLE))


def _sign(n_bands: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part)
                sig = superminhash(sets, max(SLOTS, n_bands * ROWS))
                bands = np.empty((len(sets), n_bands), np.uint64)
                for b in range(n_bands):
                    h = np.full(len(sets), b + 1, np.uint64)
                    for s in range(ROWS):
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, b * ROWS + s])
                    bands[:, b] = h
                bits = np.packbits((mix(sig[:, :128]) & np.uint64(1)).astype(np.uint8), axis=1)
                sketch = bits.view(">i8").astype(np.int64)
                digest = _digest(sets)
                flat = pa.array(bands.ravel().view(np.int64))
                ends = pa.array(np.arange(0, len(flat) + 1, n_bands), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(ends, flat), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                    names=["id", "n", "digest", "bands", "s0", "s1"],
                )

    return run


def _digest(sets: list[np.ndarray]) -> list[bytes]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]


def _shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sh) of the rows that have the asked class's set; rows of its id may have others."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            sets = _sets(part)
            own = [k for k, (d, asked) in enumerate(zip(_digest(sets), part.column("digest").to_pylist(), strict=True)) if d == asked]
            sets = [sets[k] for k in own]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(own, pa.int64())), pa.ListArray.from_arrays(ends, flat)], names=["rep", "sh"])


def _sets_of(reps: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, sh) of the asked classes, each from a text of its least id."""
    asked = reps.join(classes.select("rep", "id", "digest"), "rep").select("rep", F.col("id").alias("of"), "digest")
    own = texts.join(asked.hint("shuffle_hash"), texts.id == asked.of).select("rep", "digest", "text")
    return written(own.mapInArrow(_shingle_sets, "rep long, sh array<long>").groupBy("rep").agg(F.max("sh").alias("sh")), "sets")


def _similar(a: str, b: str, threshold: float) -> Column:
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= round(threshold * 100) * (F.size(a) + F.size(b) - common)


def _confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (a, b) of classes, those whose whole sets are similar enough."""
    pairs = written(pairs, "pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), classes, texts)
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("sh").alias("shb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("sh").alias("sha")), "a")
    return written(both.filter(_similar("sha", "shb", threshold)).select("a", "b"), "links")


def _pivots(crowd: DataFrame, turn: int) -> DataFrame:
    """(band, pivot, in_band): one class of each band, by a different order in each."""
    order = F.xxhash64("band", F.lit(turn))
    least = crowd.groupBy("band").agg(F.min(F.col("rep").bitwiseXOR(order)).alias("least"), F.count("*").alias("in_band"))
    return least.select("band", F.col("least").bitwiseXOR(order).alias("pivot"), "in_band")


def _mixed(crowd: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The rows of bands whose members are not all in one component, with their ``part``."""
    placed = crowd.join(known, crowd.rep == known.v, "left").select(*crowd.columns, F.coalesce("m", "rep").alias("part"))
    mixed = placed.groupBy("band").agg((F.min("part") < F.max("part")).alias("mixed")).filter("mixed").select("band")
    return written(placed.join(mixed, "band", "left_semi"), name)


def _grid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, as x and y, with a ``cell``: any two rows of one band meet in just one cell, and
    no cell has many more than GRID rows of either side."""
    size = rows.groupBy("band").agg(F.ceil(F.count("*") / F.lit(float(GRID))).alias("side"))
    own = rows.join(size, "band").withColumn("at", F.pmod(F.xxhash64("rep"), F.col("side")))
    across = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("side") - 1)).alias("across")
    place = lambda row, col: own.select(*rows.columns, "at", across).select(*rows.columns, F.xxhash64("band", row, col).alias("cell"))
    return place("at", "across").alias("x"), place("across", "at").alias("y")


def near_duplicates(docs: DataFrame, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable), kept."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign(bands_for(threshold)), "id long, n long, digest binary, bands array<long>, s0 long, s1 long"), "signatures")
    real = signed.filter("n > 0 and id is not null")
    # Equal sets have equal everything but the id, so any row's signature will do. A class is named by a number of its own, as
    # an id may have rows in several.
    alike = real.groupBy("digest").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("bands").alias("bands"), F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    classes = written(alike.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # Equal ids with different texts are one document: unite their classes too.
    same_id = real.select("id", "digest").distinct().groupBy("id").agg(F.collect_set("digest").alias("d")).filter(F.size("d") > 1)
    of_id = same_id.select(F.col("id").alias("of"), F.explode("d").alias("digest")).join(classes.select("digest", "rep"), "digest").select("of", "rep")
    joined = of_id.join(of_id.groupBy("of").agg(F.min("rep").alias("a")), "of").filter("rep <> a").select("a", F.col("rep").alias("b"))

    banded = classes.select("rep", "n", "s0", "s1", F.explode("bands").alias("band"))
    crowd = written(banded.join(_pivots(banded, 0).filter("in_band > 1"), "band"), "crowd")
    star = crowd.filter("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    known = components(_confirm(star, classes, texts, threshold).union(joined))

    crowd = crowd.drop("pivot", "in_band")
    again = _mixed(crowd, known, "again")
    pivots = _pivots(again, 1).join(again.select("band", F.col("rep").alias("pivot"), F.col("part").alias("pivot_part")), ["band", "pivot"])
    apart = again.join(pivots, "band").filter("part <> pivot_part")
    star = apart.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    linked = known.select(F.col("v").alias("a"), F.col("m").alias("b"))
    known = components(linked.union(_confirm(star, classes, texts, threshold)))

    x, y = _grid(_mixed(crowd, known, "rest"))
    equal_bits = 128 - F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) - F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    near = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.part") != F.col("y.part")) & (equal_bits >= fewest_equal_bits(threshold))
    near &= (F.col("x.n") >= threshold * 0.99 * F.col("y.n")) & (F.col("y.n") >= threshold * 0.99 * F.col("x.n"))
    close = written(x.join(y, near, "left_semi").drop("cell").distinct(), "close")  # of each pair that is left, both rows
    sets = _sets_of(close.select("rep").distinct(), classes, texts)
    x, y = _grid(close.join(sets, "rep"))
    more = written(x.join(y, near & (F.col("x.rep") < F.col("y.rep")) & _similar("x.sh", "y.sh", threshold)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "more")
    if not more.isEmpty():
        known = components(known.select(F.col("v").alias("a"), F.col("m").alias("b")).union(more))

    placed = classes.join(known, classes.rep == known.v, "left").select("digest", "id", F.coalesce("m", "rep").alias("part"))
    least = placed.groupBy("part").agg(F.min("id").alias("component"))
    lead = placed.join(least, "part").select("digest", "component")
    out = signed.select("id", "n", "digest").join(lead, "digest", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """The rows of ``docs`` of which near_duplicates keeps the id (all rows with a null id)."""
    drop = near_duplicates(docs, threshold).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(drop.hint("shuffle_hash"), "doc_id", "left_anti")
