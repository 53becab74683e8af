"""Language-model scores of documents: cross-entropy difference.

Two bigram models of the same form share one vocabulary: one of target texts, one of the
background, all texts. Every word and every pair of neighbouring words is a key of its own, a
full 64-bit hash, so what is counted grows with the corpus and nothing is merged into classes.

Texts are dealt into chunks of about CHUNK_WORDS words. A chunk counts its own keys once each
and deals them among buckets by their leading bits, packed in order: one row per chunk and
bucket. A bucket sums the counts of its keys over all chunks and answers each chunk in the
order in which it asked; the chunks then score their texts. A key, however common, is at most
one entry a chunk, and the buckets grow in number with the corpus, so no task and no broadcast
holds a model.

    p(w) = (c(w) + 1/2) / (N + V/2),   p(w | h) = (c(h, w) + 20 p(w)) / (c(h) + 20)

with V the distinct words of the background, the same for both models. A text's score is the
mean over its words of target loss less background loss (in nats): negative where the
text is more like the target. The first word of a text is scored by p(w).

Defined results: null, empty and blank texts have no words, and null losses and score; rows of
one id are scored each; an id labelled twice counts once; without target texts, the target
model is uniform. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchgrid.llm.storage import bounded_batches
from launchgrid.llm.textkit import mix, slices, utf8, words

CHUNK_WORDS, BUCKET_WORDS, LEAST_BITS = 1_000_000, 4_000_000, 8
PRIOR, BACKOFF = 0.5, 20.0


def keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key of each word, key of the pair it ends, whether it begins a text, words per text)."""
    word, _, _, counts = words(*utf8(column))
    pair = np.zeros(len(word), np.uint64)
    pair[1:] = mix(word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:])
    begins = np.zeros(len(word), bool)
    begins[(np.cumsum(counts) - counts)[counts > 0]] = True
    return word, pair, begins, counts


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words(*utf8(part.column("text")))[3])], names=["id", "n"])


def _vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(*utf8(part.column("text")))[0]).view(np.int64))], names=["key"])


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: their count, the bytes each needs, and those bytes plane by plane."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(7, "little") + bytes([width]) + planes.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:7], "little"), data[7]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, 8).reshape(width, n).T
    return out.view("<u8")[:, 0]


def _pack_keys(ordered: np.ndarray) -> bytes:
    return int(ordered[0]).to_bytes(8, "little") + _pack(np.diff(ordered, prepend=ordered[:1]))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data[8:]), dtype=np.uint64) + np.uint64(int.from_bytes(data[:8], "little"))


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, place of each word's key, place of each later word's pair, begins, words per text)."""
    word, pair, begins, counts = keys(column)
    distinct, at = np.unique(np.concatenate([word, pair[~begins]]), return_inverse=True)
    return distinct, at[: len(word)], at[len(word) :], begins, counts


def _sum(rows: pa.Table) -> pa.Table:
    """A bucket's rows with each key's counts over all of them."""
    own = [_unpack_keys(k) for k in rows.column("keys").to_pylist()]
    distinct, at = np.unique(np.concatenate(own), return_inverse=True)
    ends = np.cumsum([len(k) for k in own])[:-1]
    out = {"chunk": rows.column("chunk"), "bucket": rows.column("bucket")}
    for name in ("target", "every"):
        n = np.concatenate([_unpack(zlib.decompress(x)) for x in rows.column(name).to_pylist()])
        whole = np.bincount(at, n, len(distinct)).astype(np.int64)[at]
        out[name] = pa.array([zlib.compress(_pack(x), 1) for x in np.split(whole, ends)], pa.binary())
    return pa.table(out)


def counted(texts: DataFrame, targets: DataFrame, bits: int = LEAST_BITS) -> DataFrame:
    """(chunk, bucket, target, every): counts over the whole corpus of every key a chunk holds, in order.

    ``texts`` has chunk, id and text; ``targets`` the chunk (of) and id (good) of the target texts.
    """

    def count(texts: pa.Table, targets: pa.Table) -> pa.Table:
        distinct, word, pair, begins, counts = _distinct(texts.column("text"))
        good = np.repeat(pc.is_in(texts.column("id"), targets.column("good").combine_chunks()).to_numpy(), counts)
        at, of, n = np.concatenate([word, pair]), np.concatenate([good, good[~begins]]), len(distinct)
        seen = np.bincount(at[of], minlength=n), np.bincount(at, minlength=n)
        buckets, starts = np.unique(distinct >> np.uint64(64 - bits), return_index=True)
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)) if n else []
        return pa.table({
            "chunk": pa.array([texts.column("chunk")[0].as_py()] * len(cuts), pa.int32()), "bucket": pa.array(buckets.astype(np.int64)), "keys": pa.array([_pack_keys(distinct[i:j]) for i, j in cuts], pa.binary()),
            **{name: pa.array([zlib.compress(_pack(x[i:j]), 1) for i, j in cuts], pa.binary()) for name, x in zip(("target", "every"), seen, strict=True)},
        })

    own = texts.groupBy("chunk").cogroup(targets.groupBy("of")).applyInArrow(count, "chunk int, bucket long, keys binary, target binary, every binary")
    return own.groupBy("bucket").applyInArrow(_sum, "chunk int, bucket long, target binary, every binary")


def losses(counts: np.ndarray, total: np.ndarray, v: int, word: np.ndarray, pair: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """[target or background, words]: the loss of each word of a sequence, in nats.

    ``counts`` [2, keys] and ``total`` [2]; ``word`` and ``pair`` are places in ``counts``.
    """
    alone = (counts[:, word] + PRIOR) / (total[:, None] + PRIOR * max(1, v))
    later = np.flatnonzero(~begins)
    p = alone.copy()
    p[:, later] = (counts[:, pair] + BACKOFF * alone[:, later]) / (counts[:, word[later - 1]] + BACKOFF)
    return -np.log(p)


def cross_entropy_difference(docs: DataFrame, is_target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, target_loss, background_loss, score) of every row.

    ``is_target`` has the ids (in ``id_col``) of the target texts.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType
    ids = is_target.select(F.col(id_col).alias("id")).filter("id is not null").distinct()

    sizes = plain.mapInArrow(_sizes, T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType())]))
    marked = sizes.join(ids.withColumn("good", F.lit(True)), "id", "left")
    n = marked.agg(F.sum(F.when(F.col("good"), F.col("n"))).alias("target"), F.sum("n").alias("every")).first()
    total = np.array([n.target or 0, n.every or 0], float)
    v = plain.select("text").mapInArrow(_vocabulary, "key long").distinct().count()

    chunks = max(1, -(-int(total[1]) // CHUNK_WORDS))
    bits = max(LEAST_BITS, (int(total[1]) // BUCKET_WORDS).bit_length())
    texts = plain.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    targets = texts.select("chunk", "id").join(ids, "id", "left_semi").select(F.col("chunk").alias("of"), F.col("id").alias("good")).distinct()

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        distinct, word, pair, begins, counts = _distinct(own.column("text"))
        order = np.argsort(found.column("bucket").to_numpy())
        seen = np.zeros((2, len(distinct)))
        for t, name in enumerate(("target", "every")):
            parts = found.column(name).to_pylist()
            seen[t] = np.concatenate([np.zeros(0), *(_unpack(zlib.decompress(parts[i])) for i in order)])
        of = np.repeat(np.arange(len(counts)), counts)
        mean = [np.bincount(of, x, len(counts)) / np.maximum(counts, 1) for x in losses(seen, total, v, word, pair, begins)]
        columns = [pa.array(x, mask=counts == 0) for x in (*mean, mean[0] - mean[1])]
        return pa.Table.from_arrays([own.column("id"), pa.array(counts), *columns], names=[id_col, "n_words", "target_loss", "background_loss", "score"])

    fields = [T.StructField(id_col, kind), T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score"))]
    return texts.groupBy("chunk").cogroup(counted(texts, targets, bits).groupBy("chunk")).applyInArrow(score, T.StructType(fields))
