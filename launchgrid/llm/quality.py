"""Quality of documents by a factorisation machine.

Inputs of a score come from the text alone: hashed words (their share of the text, as a
unit vector), and statistics of its structure and size. The machine scores

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

in time linear in the words: the pairwise part by the sum-of-squares identity.

Fitting: on at most ``MOST_ROWS`` labelled rows, those with the least hash of the id, so
the sample is the same on every run; the hash sample is joined by broadcast (its size is
bounded) to the scan of the texts, which never move. One task fits to the sample's features,
so of them nothing reaches the driver but the model, which is about a megabyte.

Defined results: null and empty texts have the statistics of an empty text and no words;
labels other than 0 and 1, or of an unknown id, are left out; repeated labels of an id count
once, by the greater, and of repeated rows of an id the one with the least statistics is learnt from; without labels of both kinds every score is the share of ones (0.5 with none).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchgrid.llm.storage import bounded_batches
from launchgrid.llm.textkit import slices, utf8, words

MOST_ROWS = 12_000
BUCKETS = 1 << 14
FACTORS = 6
EPOCHS = 12
THRESHOLD = 0.7

_CLASSES = (b"#$%&*", b"|", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), b"\n", b" \t", b"=_/\\<>{}[]()@+~^`\"'")
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _k
_CLASS_OF[128:] = len(_CLASSES) + 1
STATS = len(_CLASSES) + 2 + 8


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


def _statistics(raw: np.ndarray, offs: np.ndarray, hashes: np.ndarray, first: np.ndarray, end: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of STATS numbers for each text."""
    n = len(counts)
    size = (offs[1:] - offs[:-1]).astype(float)
    texts = np.repeat(np.arange(n), offs[1:] - offs[:-1])
    wide = len(_CLASSES) + 2
    shares = np.bincount(texts * wide + _CLASS_OF[raw], minlength=n * wide).reshape(n, wide) / np.maximum(size, 1)[:, None]
    of = np.repeat(np.arange(n), counts)
    total = np.maximum(counts, 1)
    length = (end - first).astype(float)
    mean = np.bincount(of, length, n) / total
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / total - mean**2, 0))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    two = np.zeros(len(hashes))
    two[2:] = (hashes[2:] == hashes[:-2]) & (of[2:] == of[:-2])
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(hashes))
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], fresh, n) / total
    one = np.bincount(of, length <= 1, n) / total
    more = [np.log1p(size), np.log1p(counts), mean, spread, np.bincount(of, again, n) / total, np.bincount(of, two, n) / total, distinct, one]
    return np.column_stack([shares, *more])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the hashed words, rows ascending, and the statistics of each text."""
    raw, offs = utf8(column)
    hashes, first, end, counts = words(raw, offs)
    stats = _statistics(raw, offs, hashes, first, end, counts)
    of = np.repeat(np.arange(len(counts)), counts)
    key, times = np.unique(of * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    value = np.sqrt(times)
    norm = np.sqrt(np.bincount(row, value**2, len(counts)))
    return row, bucket, value / norm[row] if len(row) else value, stats


def _linear(m: Machine, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, ...]:
    x = np.clip((stats - m.centre) / m.scale, -6, 6) / np.sqrt(stats.shape[1])
    n = len(stats)
    idx = np.concatenate([bucket, np.tile(BUCKETS + np.arange(x.shape[1]), n)])
    rows = np.concatenate([row, np.repeat(np.arange(n), x.shape[1])])
    val = np.concatenate([value, x.ravel()])
    v = m.factors[idx]
    part = v * val[:, None]
    total = np.stack([np.bincount(rows, part[:, f], n) for f in range(v.shape[1])], 1)
    squares = np.bincount(rows, (part**2).sum(1), n)
    score = m.bias + np.bincount(rows, m.weights[idx] * val, n) + 0.5 * ((total**2).sum(1) - squares)
    return score, idx, rows, val, v, total


def score(m: Machine, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_linear(m, row, bucket, value, stats)[0], -35, 35)))


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """AdaGrad on the log loss, by batches of rows in a fixed random order."""
    rng = np.random.default_rng(seed)
    n = len(label)
    width = BUCKETS + STATS
    share = float(label.mean()) if n else 0.5
    bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    centre = stats.mean(0) if n else np.zeros(STATS)
    scale = stats.std(0) + 1e-6 if n else np.ones(STATS)
    m = Machine(float(np.clip(bias, -20, 20)), np.zeros(width), np.zeros((width, factors)), centre, scale)
    if n == 0 or share in (0.0, 1.0):
        return m
    m.factors = rng.normal(0, 0.05, (width, factors))
    g_w, g_v, g_b = np.full(width, 1e-2), np.full((width, factors), 1e-2), 1.0
    starts = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            part = order[at : at + 256]
            size = starts[part + 1] - starts[part]
            take = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            r = np.repeat(np.arange(len(part)), size)
            s, idx, rows, val, v, total = _linear(m, r, bucket[take], value[take], stats[part])
            err = (1 / (1 + np.exp(-np.clip(s, -35, 35))) - label[part]) / len(part)
            d = err[rows] * val
            uniq, inv = np.unique(idx, return_inverse=True)
            gw = np.bincount(inv, d) + 1e-6 * m.weights[uniq]
            dv = d[:, None] * (total[rows] - v * val[:, None])
            gv = np.stack([np.bincount(inv, dv[:, f]) for f in range(factors)], 1) + 1e-5 * m.factors[uniq]
            g_w[uniq] += (len(part) * gw) ** 2
            g_v[uniq] += (len(part) * gv) ** 2
            g_b += (len(part) * err.sum()) ** 2
            m.weights[uniq] -= 0.3 * len(part) * gw / np.sqrt(g_w[uniq])
            m.factors[uniq] -= 0.05 * len(part) * gv / np.sqrt(g_v[uniq])
            m.bias -= 0.3 * len(part) * err.sum() / np.sqrt(g_b)
    return m


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text's features, packed: the texts themselves stay where they are."""
    for batch in batches:
        for part in slices(batch, "text"):
            row, bucket, value, stats = features(part.column("text"))
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            b, v = bucket.astype("<u2"), value.astype("<f4")
            cut = lambda a: [a[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(cut(b), pa.binary()), pa.array(cut(v), pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], names=["id", "label", "buckets", "weights", "stats"])


def _fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine fitted to all rows of a partition, pickled; nothing of an empty one."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        found = pa.Table.from_batches(held).sort_by([("id", "ascending")])
        flat = lambda name, kind: np.frombuffer(b"".join(found[name].to_pylist()), kind)
        bucket = flat("buckets", "<u2").astype(np.int64)
        row = np.repeat(np.arange(len(found)), [len(b) // 2 for b in found["buckets"].to_pylist()])
        machine = fit(row, bucket, flat("weights", "<f4").astype(float), flat("stats", float).reshape(-1, STATS), found["label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], names=["machine"])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Fit to at most ``most_rows`` rows of ``labels`` (id, label 0 or 1)."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter("id is not null and label in (0, 1)")
    sample = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = texts.join(F.broadcast(sample), "id").mapInArrow(_sampled, T.StructType([T.StructField("id", texts.schema["id"].dataType), *(T.StructField(n, T.BinaryType() if n != "label" else T.DoubleType()) for n in ("label", "buckets", "weights", "stats"))]))
    one = seen.groupBy("id").agg(F.min(F.struct("stats", "label", "buckets", "weights")).alias("r"))  # however often an id is repeated
    found = one.select("id", "r.*").repartition(1).mapInArrow(_fitted, "machine binary").collect()
    none = np.zeros(0)
    return pickle.loads(found[0].machine) if found else fit(none, none, none, none.reshape(0, STATS), none)


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; score from 0 to 1, higher: label 1 likelier."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score(shared.value, *features(part.column("text"))))], names=[id_col, "score"])

    return plain.mapInArrow(run, T.StructType([T.StructField(id_col, plain.schema["id"].dataType), T.StructField("score", T.DoubleType())]))


def kept(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that score ``threshold`` or more; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(score(shared.value, *features(part.column(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row's label may not be learnt from: crc32 of the id's digits mod 4 is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    machine = train(docs, labels.filter(~held_out()))
    out = scored(docs, machine)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
