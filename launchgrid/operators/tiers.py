"""Publishers grouped by k-means, and whether the grouping is stable enough to use."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchgrid.sources.shared import written

SILHOUETTE_BAR, AGREEMENT_BAR = 0.35, 0.75
AT_ONCE = 4
VECTOR = ("log_count", "mean_volume_pct", "mean_positive_pct", "mean_breadth", "span_years")


def vectors(stats: DataFrame) -> DataFrame:
    """publisher_stats with its standardised five-part ``features`` vector."""
    rows = stats.withColumn("log_count", F.log1p("title_count"))
    joined = VectorAssembler(inputCols=list(VECTOR), outputCol="raw").transform(rows)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(joined).transform(joined)


def clustered(rows: DataFrame, k: int = 3, seeds: range = range(25)) -> DataFrame:
    """``rows`` with the ``label`` of the seed of least cost. The rows are written once and fitted from there."""
    rows = written(rows, "vectors")
    best = min(_fitted(rows, k, seeds), key=lambda m: m.summary.trainingCost)
    return best.transform(rows)


def _fitted(rows: DataFrame, k: int, seeds: range) -> list:
    """A fit for each seed; some run side by side, to fill the cluster."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(lambda s: KMeans(k=k, seed=s, featuresCol="features", predictionCol="label").fit(rows), seeds))


def by_scale(labelled: DataFrame, names: tuple[str, ...] = ("small", "mid", "large")) -> DataFrame:
    """(label, tier, tier_name): clusters in ascending scale, mean log count plus mean percentile."""
    scale = labelled.groupBy("label").agg((F.avg(F.log1p("title_count")) + F.avg("mean_volume_pct") / 100).alias("scale"))
    order = F.array_sort(F.collect_list(F.struct("scale", "label")))  # one entry a cluster
    placed = scale.agg(order.alias("all")).select(F.posexplode("all").alias("pos", "x"))
    return placed.select(F.col("x.label").alias("label"), (F.col("pos") + 1).alias("tier"), F.try_element_at(F.array(*(F.lit(n) for n in names)), F.col("pos") + 1).alias("tier_name"))


def adjusted_rand(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from their contingency counts."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda n: (n * (n - 1) / 2).cast("double")
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(name))
    one = cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("n")).crossJoin(side(a, "in_a")).crossJoin(side(b, "in_b"))  # one row each
    chance = F.col("in_a") * F.col("in_b") / F.nullif(two(F.col("n")), F.lit(0.0))
    top = (F.col("in_a") + F.col("in_b")) / 2
    return one.select("n", F.coalesce(F.when(top - chance != 0, (F.col("both") - chance) / (top - chance)), F.lit(1.0)).alias("adjusted_rand"))


def seed_agreement(rows: DataFrame, k: int = 3, seeds: range = range(12)) -> float:
    """Mean adjusted Rand index over pairs of seeds."""
    rows = written(rows, "vectors")
    every = rows.select("company", "features")
    for s, m in zip(seeds, _fitted(rows, k, seeds), strict=True):
        every = m.setPredictionCol(f"l{s}").transform(every)
    every = every.select(*(f"l{s}" for s in seeds))
    # All contingency tables in one pass: k x k counts a pair of seeds.
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("pair"), F.col(f"l{a}").alias("a"), F.col(f"l{b}").alias("b")) for i, (a, b) in enumerate(combinations(seeds, 2)))))
    cells = every.select(pairs.alias("x")).groupBy("x.pair", "x.a", "x.b").agg(F.count("*").alias("n")).toPandas()
    return float(np.mean([_rand_of(c) for _, c in cells.groupby("pair")]))


def _rand_of(cells: pd.DataFrame) -> float:
    """The adjusted Rand index of a small contingency table (a, b, n)."""
    two = lambda n: (n * (n - 1) / 2).sum()
    both, in_a, in_b, total = two(cells.n), two(cells.groupby("a").n.sum()), two(cells.groupby("b").n.sum()), cells.n.sum()
    chance = in_a * in_b / (total * (total - 1) / 2) if total > 1 else 0.0
    top = (in_a + in_b) / 2
    return float((both - chance) / (top - chance)) if top != chance else 1.0


def silhouette(labelled: DataFrame, block: int = 2000) -> DataFrame:
    """One row: the mean Euclidean silhouette, exactly.

    Rows are packed into blocks; each block meets every block's rows by an equi-join on the
    block number, so a task holds two blocks. Only sums of distances per label come out.
    """
    rows = labelled.select("company", "label", vector_to_array("features").alias("v"))
    n = max(1, -(-rows.count() // block))
    packed = rows.withColumn("block", F.pmod(F.xxhash64("company"), F.lit(n)))
    packed = packed.groupBy("block").agg(F.collect_list(F.struct("company", "label", "v")).alias("rows"))
    pairs = packed.select(F.col("rows").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("block")).join(packed.withColumnRenamed("rows", "y"), "block")

    def distances(batches):
        for batch in batches:
            for x, y in zip(batch.x, batch.y, strict=True):
                vx, vy = (np.array([list(r["v"]) for r in z]) for z in (x, y))
                labels = np.array([r["label"] for r in y])
                for lab in np.unique(labels):
                    part = vy[labels == lab]
                    d = np.sqrt(np.maximum(((vx[:, None, :] - part[None, :, :]) ** 2).sum(2), 0)).sum(1)
                    yield pd.DataFrame({"company": [r["company"] for r in x], "own": [r["label"] for r in x], "label": int(lab), "distance": d, "n": len(part)})

    sums = pairs.mapInPandas(distances, "company string, own int, label int, distance double, n long").groupBy("company", "own", "label").agg(F.sum("distance").alias("d"), F.sum("n").alias("n"))
    mean = F.when(F.col("own") == F.col("label"), F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(F.col("d") / F.col("n"))
    two = sums.withColumn("m", mean).groupBy("company").agg(F.max(F.when(F.col("own") == F.col("label"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("label"), F.col("m"))).alias("b"))
    return two.agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))


def sampled_silhouette(labelled: DataFrame, sample: int, seed: int = 0) -> tuple[float, float, int]:
    """(mean, standard error, n) of the Euclidean silhouette over ``sample`` publishers, each held against all of them.

    The publishers are those of the least hashes under a seed, so a larger sample has the smaller one in it. All publishers
    are read once, in blocks; of each block only a sum of distances per sampled publisher and label comes out.
    """
    rows = labelled.select("company", "label", vector_to_array("features").alias("v"))
    n = rows.count()
    asked = rows.withColumn("h", F.xxhash64(F.lit(seed), "company")).orderBy("h", "company").limit(sample).toPandas()  # at most ``sample`` rows
    points, own = np.array(asked.v.tolist()), asked.label.to_numpy()

    def distances(batches):
        for batch in batches:
            v, labels = np.array(batch.v.tolist()), batch.label.to_numpy()
            for lab in np.unique(labels):
                part = v[labels == lab]
                d = np.zeros(len(points))
                for k in range(0, len(part), 512):
                    d += np.sqrt(np.maximum(((points[:, None, :] - part[None, k : k + 512, :]) ** 2).sum(2), 0)).sum(1)
                yield pd.DataFrame({"k": np.arange(len(points)), "label": int(lab), "d": d, "n": len(part)})

    sums = rows.mapInPandas(distances, "k long, label int, d double, n long").groupBy("k", "label").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).toPandas()
    mine = sums.label.to_numpy() == own[sums.k]
    mean = sums.d / np.where(mine, sums.n - 1, sums.n).clip(1)
    a = pd.Series(np.where(mine & (sums.n > 1), mean, np.nan)).groupby(sums.k).max()
    b = pd.Series(np.where(mine, np.nan, mean)).groupby(sums.k).min()
    s = ((b - a) / np.maximum(a, b)).fillna(0.0).to_numpy()
    left_out = np.sqrt(max(0.0, 1 - len(s) / n)) if n else 0.0  # a sample of all of them has no error
    return float(s.mean()), float(s.std(ddof=1) / np.sqrt(len(s)) * left_out) if len(s) > 1 else 0.0, n


def clears(labelled: DataFrame, bar: float = SILHOUETTE_BAR, sample: int = 1000, sigmas: float = 4.0) -> tuple[bool, float, int]:
    """(whether the mean silhouette reaches ``bar``, its estimate, publishers sampled).

    A sample is enough where the bar lies ``sigmas`` standard errors off; else it is doubled, up to 8,000, and
    where that still leaves the bar inside the interval, or the table is no larger than the sample, the exact mean decides.
    """
    while sample <= 8000:
        mean, error, n = sampled_silhouette(labelled, sample)
        if n <= sample or abs(mean - bar) > sigmas * error:
            return mean >= bar, mean, min(n, sample)
        sample *= 2
    mean = silhouette(labelled).first().silhouette
    return mean >= bar, mean, n


def tier_table(stats: DataFrame, k: int = 3) -> DataFrame:
    """publisher_stats with tier and tier_name, null for all unless the grouping is stable."""
    rows = vectors(stats)
    found = clustered(rows, k)
    stable = clears(found)[0] and seed_agreement(rows, k) >= AGREEMENT_BAR
    placed = found.join(F.broadcast(by_scale(found)), "label")
    none = lambda c, kind: F.col(c) if stable else F.lit(None).cast(kind)
    return placed.select(*stats.columns, none("tier", "int").alias("tier"), none("tier_name", "string").alias("tier_name"))


def ordered(table: DataFrame) -> DataFrame:
    """A tier table for review: highest tier first, then most titles."""
    return table.orderBy(F.col("tier").desc_nulls_last(), F.desc("title_count"), "company")
