"""Running sums in order, in two levels, so that no key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], by: str, bucket: Column, n: Column) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``n`` over the key's rows up to this one, and ``total``, that over all.

    ``bucket`` grows with ``by`` and splits a key's rows into parts that a task can hold. Parts are summed first; the
    few sums of a key run over its parts, then each part runs within itself from its own start. Keys are not
    null and ``by`` is unique within a key.
    """
    cut = rows.withColumns({"_part": bucket, "_n": n})
    sums = cut.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"), F.sum("_sum").over(whole).alias("total"))
    inside = Window.partitionBy(*keys, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_in", F.sum("_n").over(inside))
    return own.join(starts, [*keys, "_part"]).withColumn("upto", F.col("_start") + F.col("_in")).select(*rows.columns, "upto", "total")
