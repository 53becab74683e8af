"""Conversation rows in order, in segments of bounded size.

Rows are dealt by ranges of (conv_id, turn, role, text), nulls first, so a conversation of any
length is spread over tasks, and numbered by ``at``, which grows in that order. Texts are told apart by their first BEGIN
characters and then by a hash, as whole texts would be too much for the sample that ranges are made from. A segment is what a
conversation has of 4,096 consecutive numbers: small conversations have one segment, seldom two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchgrid.llm.storage import bounded_batches, written

SEGMENT_BITS = 12
BEGIN = 64
COLUMNS = ("conv_id", "turn", "role", "text")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text: of these only conv_id and turn may be null) with ``at``, written.

    Equal rows get numbers next to each other; they may lie in different tasks.
    """
    bounded_batches(rows.sparkSession)
    order = ("conv_id", "turn", "role", "begin", "hash", "salt")
    salted = rows.select(*COLUMNS, F.substring("text", 1, BEGIN).alias("begin"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("salt"))
    dealt = salted.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select(*COLUMNS, F.monotonically_increasing_id().alias("at")), "turns")


def segments(rows: DataFrame, **columns: F.Column) -> DataFrame:
    """(conv_id, sid, rows: array of at and the columns, in order); sid is the least ``at``. ``rows`` has conv_id and at."""
    fields = F.struct("at", *(c.alias(n) for n, c in columns.items()))
    grouped = rows.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("part")).agg(F.sort_array(F.collect_list(fields)).alias("rows"))
    return grouped.select("conv_id", F.col("rows")[0]["at"].alias("sid"), "rows")


def text_hash(*columns: str) -> tuple[F.Column, F.Column]:
    """Two 64-bit hashes of the columns."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
