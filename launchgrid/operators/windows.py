"""Dated reviews anchored to each title's launch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchgrid.functions.measures import positive_share, retention
from launchgrid.schemas import WINDOW_KEYS, Windows

MEANINGFUL, LOOKBACK, HEAD_DAYS, AUTO_DAYS = 50, 90, 14, 7


def daily(events: DataFrame) -> DataFrame:
    """(appid, day, n, positive): reviews collapsed per title and day before any join.

    ``events`` has appid, day, positive (boolean) and weight. Map-side sums take most of the
    skew of a title with very many reviews.
    """
    return events.groupBy("appid", "day").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("positive"), F.col("weight")).otherwise(0)).alias("positive"))


def window_totals(releases: DataFrame, days: DataFrame, windows: Windows = Windows(), as_of=None) -> DataFrame:
    """(appid, window_key, review_total, review_positive, review_negative), one row per window.

    An equi-join on the title; a window [start, start + N) is a condition inside the sums.
    With ``as_of`` (a date Column) only windows that have elapsed by then are given.
    """
    lengths = dict(zip(WINDOW_KEYS, (windows.first, windows.second, windows.third, None), strict=True))
    joined = releases.select("appid", "store_date").join(days, "appid", "left")
    offset = F.date_diff("day", "store_date")
    inside = {k: offset.between(0, n - 1) if n else F.col("day").isNotNull() for k, n in lengths.items()}
    sums = [F.sum(F.when(c, F.col(v)).otherwise(0)).alias(f"{k}_{v}") for k, c in inside.items() for v in ("n", "positive")]
    wide = joined.groupBy("appid", "store_date").agg(*sums)
    parts = F.array(*(F.struct(F.lit(k).alias("window_key"), F.lit(n).cast("int").alias("length"), F.col(f"{k}_n").alias("review_total"), F.col(f"{k}_positive").alias("review_positive")) for k, n in lengths.items()))
    long = wide.select("appid", "store_date", F.explode(parts).alias("w")).select("appid", "store_date", "w.*")
    if as_of is not None:
        long = long.filter(F.col("length").isNull() | (F.date_add("store_date", F.col("length")) <= as_of))
    return long.select("appid", "window_key", "review_total", "review_positive", (F.col("review_total") - F.col("review_positive")).alias("review_negative"))


def launch_summary(windows: DataFrame, observed_only: bool = True) -> DataFrame:
    """(appid, first_total, third_total, positive_pct, retention): one wide row per title.

    ``observed_only``: a window without reviews was not observed, so its total is null.
    """
    pick = lambda key, col: F.sum(F.when(F.col("window_key") == key, F.col(col)))
    wide = windows.groupBy("appid").agg(pick("launch_2w", "review_total").alias("first_total"), pick("launch_2w", "review_positive").alias("first_positive"), pick("launch_3m", "review_total").alias("third_total"))
    if observed_only:
        wide = wide.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in ("first_total", "third_total")})
    return wide.select("appid", "first_total", "third_total", positive_share(F.col("first_positive"), F.col("first_total")).alias("positive_pct"), retention(F.col("third_total"), F.col("first_total")).alias("retention"))


def launch_start(releases: DataFrame, days: DataFrame) -> DataFrame:
    """(appid, recorded, detected, early_total, head_total, days_earlier, verdict).

    Reviews up to 90 days before the recorded date tell whether a title was on sale before it.
    """
    near = days.join(releases.select("appid", "store_date"), "appid").withColumn("before", F.date_diff("store_date", "day")).filter(F.col("before").between(1, LOOKBACK))
    probes = near.groupBy("appid").agg(
        F.sum(F.when(F.col("before") > HEAD_DAYS + 1, F.col("n")).otherwise(0)).alias("early_total"),
        F.sum(F.when(F.col("before").between(2, HEAD_DAYS), F.col("n")).otherwise(0)).alias("head_total"),
        F.max(F.when(F.col("before").between(1, HEAD_DAYS) & (F.col("n") > 0), F.col("before"))).alias("earliest"),
    )
    out = releases.select("appid", F.col("store_date").alias("recorded")).join(probes, "appid", "left")
    early, head = F.coalesce("early_total", F.lit(0)), F.coalesce("head_total", F.lit(0))
    moved = F.when((early < MEANINGFUL) & (head >= MEANINGFUL), F.coalesce("earliest", F.lit(0))).otherwise(0)
    verdict = F.when(early >= MEANINGFUL, "sold_before").when(head < MEANINGFUL, "no_head_start").when(moved > AUTO_DAYS, "needs_review").when(moved > 0, "shifted").otherwise("no_head_start")
    return out.select("appid", "recorded", F.date_sub("recorded", moved).alias("detected"), early.alias("early_total"), head.alias("head_total"), moved.alias("days_earlier"), verdict.alias("verdict"))
