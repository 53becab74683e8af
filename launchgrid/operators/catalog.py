"""Add-ons, demos, prices and knowledge-base statements joined to their titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchgrid.functions.dates import demo_timing, enrichment, precedes

ADDON_CAP, ADDON_DAYS = 12, 3
PREORDER_DAYS, LAUNCH_DAYS, SALES_DAYS = 30, 60, 120


def addon_summary(titles: DataFrame, listed: DataFrame, dates: DataFrame) -> DataFrame:
    """(appid, dlc_count, launch_day, post_launch, last_days) of each title's listed add-ons.

    ``listed``: appid, pos, addon; the first twelve are looked at, all are counted. ``dates``:
    addon, addon_date. A title without a date has only its count.
    """
    every = listed.groupBy("appid").agg(F.count("*").alias("dlc_count"))
    near = listed.filter(F.col("pos") < ADDON_CAP).join(dates, "addon").join(titles.select("appid", "store_date"), "appid").withColumn("gap", F.date_diff("addon_date", "store_date"))
    counts = near.groupBy("appid").agg(F.count_if(F.abs("gap") <= ADDON_DAYS).alias("launch_day"), F.count_if(F.col("gap") > ADDON_DAYS).alias("post_launch"), F.max(F.when(F.col("gap") > ADDON_DAYS, F.col("gap"))).alias("last_days"))
    rows = titles.select("appid", "store_date").join(every, "appid", "left").join(counts, "appid", "left")
    known = lambda c: F.when(F.col("store_date").isNotNull(), F.coalesce(c, F.lit(0)))
    return rows.select("appid", F.coalesce("dlc_count", F.lit(0)).alias("dlc_count"), known("launch_day").alias("launch_day"), known("post_launch").alias("post_launch"), F.when(F.col("store_date").isNotNull(), F.col("last_days")).alias("last_days"))


def demo_timings(titles: DataFrame, dates: DataFrame) -> DataFrame:
    """(appid, demo, timing) by the first listed demo. ``titles`` has demo_ids (array)."""
    first = titles.select("appid", "store_date", F.try_element_at("demo_ids", F.lit(1)).alias("demo")).join(dates, "demo", "left")
    return first.select("appid", "demo", demo_timing(F.col("store_date"), F.col("demo_date"), F.col("demo").isNotNull()).alias("timing"))


def oldest_prices(history: DataFrame) -> DataFrame:
    """(appid, price_cents, observed_on, parsed, total, newest): each title's first regular price.

    ``history``: appid, price_cents and day, null where an entry could not be read.
    """
    read = F.col("price_cents").isNotNull() & F.col("day").isNotNull()
    return history.groupBy("appid").agg(
        F.min(F.when(read, F.struct("day", "price_cents"))).alias("first"), F.count_if(read).alias("parsed"), F.count("*").alias("total"), F.max(F.when(read, F.col("day"))).alias("newest")
    ).select("appid", F.col("first.price_cents").alias("price_cents"), F.col("first.day").alias("observed_on"), "parsed", "total", "newest")


def price_verdict(parsed: Column, total: Column, days_after: Column) -> Column:
    """(suspect, is_launch_price, verdict) of a first price seen so many days after release."""
    suspect = (total > 1) & (parsed < total)
    inside = F.coalesce(~suspect & days_after.between(-PREORDER_DAYS, LAUNCH_DAYS), F.lit(False))
    verdict = F.when(suspect, "suspect").when(days_after.isNull(), "no_release_date").when(inside & (days_after < 0), "pre_order").when(inside, "launch").when(days_after < 0, "too_early").otherwise("too_late")
    return F.struct(suspect.alias("suspect"), inside.alias("is_launch_price"), verdict.alias("verdict"))


def original_dates(statements: DataFrame, editions: DataFrame | None = None) -> DataFrame:
    """(appid, original_date): the least preferred date, or else the least of all.

    ``statements``: appid, day, precision, rank; those of day precision that are not deprecated
    count. ``editions`` (appid, base): an edition also has its base title's statements.
    """
    every = statements if editions is None else statements.unionByName(editions.join(statements.withColumnRenamed("appid", "base"), "base").select(statements.columns))
    real = every.filter((F.col("precision") >= 11) & (F.col("rank") != "deprecated"))
    return real.groupBy("appid").agg(F.coalesce(F.min(F.when(F.col("rank") == "preferred", F.col("day"))), F.min("day")).alias("original_date"))


def date_updates(titles: DataFrame, found: DataFrame) -> DataFrame:
    """(appid, verdict, original_date, found_date, changes) of titles against looked-up dates.

    A date after which the store's came more than a week early is suspect and changes nothing.
    """
    rows = titles.select("appid", "store_date", "original_date").join(found.withColumnRenamed("original_date", "found_date"), "appid", "left")
    verdict = F.when(F.col("found_date").isNull(), "no_match").otherwise(enrichment(F.col("found_date"), F.col("store_date")))
    return rows.select("appid", verdict.alias("verdict"), "original_date", "found_date", (F.col("found_date").isNotNull() & (verdict != "suspect") & ~F.col("found_date").eqNullSafe(F.col("original_date"))).alias("changes"))


def nominations_before(titles: DataFrame, looked_up: DataFrame, nominations: DataFrame) -> DataFrame:
    """(appid, nominations, wins) surely before a title's date; nought if looked up without any,
    null if never looked up."""
    cutoff = titles.select("appid", F.coalesce("original_date", "store_date").alias("cutoff"))
    counted = nominations.join(cutoff, "appid").filter(precedes(F.col("when"), F.col("precision"), F.col("cutoff"))).groupBy("appid").agg(F.count("*").alias("n"), F.count_if("won").alias("w"))
    rows = titles.select("appid").join(looked_up.select("appid", F.lit(True).alias("_seen")), "appid", "left").join(counted, "appid", "left")
    known = lambda c: F.when(F.col("_seen").isNotNull(), F.coalesce(c, F.lit(0)))
    return rows.select("appid", known("n").alias("nominations"), known("w").alias("wins"))


def first_milestones(titles: DataFrame, milestones: DataFrame) -> DataFrame:
    """(appid, figures, as_of, units, gap_days, in_window): the first sales figure after launch.

    ``milestones``: appid, as_of (null where coarser than a day), units; repeats count once.
    """
    once = milestones.select("appid", "as_of", "units").distinct()
    joined = titles.select("appid", "store_date").join(once, "appid", "left")
    after = F.col("as_of") >= F.col("store_date")
    out = joined.groupBy("appid", "store_date").agg(F.count("units").alias("figures"), F.min(F.when(after, F.struct("as_of", "units"))).alias("first"))
    gap = F.date_diff("first.as_of", "store_date")
    return out.select("appid", "figures", F.col("first.as_of").alias("as_of"), F.col("first.units").alias("units"), gap.alias("gap_days"), F.coalesce(gap <= SALES_DAYS, F.lit(False)).alias("in_window"))
