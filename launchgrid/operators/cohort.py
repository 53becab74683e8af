"""Ranks, medians and going rates inside rolling year cohorts.

Titles are first counted per (year, value); the counts, not the titles, are spread to neighbouring years and
summed up in order. A year may have very many values, so its sums run in two levels, over buckets of WIDTH
neighbouring values and within each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchgrid.operators.running import running
from launchgrid.schemas import Cohort

WIDTH = 1024


def pooled(reference: DataFrame, cohort: Cohort = Cohort()) -> DataFrame:
    """(cohort_year, value, n): values of the years within ``span`` of each year."""
    counts = reference.filter("cohort_year is not null and value is not null").groupBy("cohort_year", "value").agg(F.count("*").alias("n"))
    years = F.explode(F.sequence(F.col("cohort_year") - cohort.span, F.col("cohort_year") + cohort.span))
    return counts.select(years.alias("cohort_year"), "value", "n").groupBy("cohort_year", "value").agg(F.sum("n").alias("n"))


def in_order(counts: DataFrame, width: float = WIDTH) -> DataFrame:
    """``counts`` (cohort_year, value, n) with ``upto`` and ``size``: titles up to a value, and of the year."""
    return running(counts, ["cohort_year"], "value", F.floor(F.col("value") / width), F.col("n")).withColumnRenamed("total", "size")


def percentiles(reference: DataFrame, probes: DataFrame, cohort: Cohort = Cohort()) -> DataFrame:
    """``probes`` (appid, cohort_year, value) with cohort_size and percentile (mid-rank, one decimal).

    A probe need not belong to the reference: its value joins the counts with weight nought. The
    percentile is null for a null year or value and in a cohort of fewer than ``least``.
    """
    asked = probes.select("cohort_year", "value").filter("cohort_year is not null and value is not null").distinct().withColumn("n", F.lit(0).cast("bigint"))
    counts = pooled(reference, cohort).unionByName(asked).groupBy("cohort_year", "value").agg(F.sum("n").alias("n"))
    ranked = in_order(counts).withColumnRenamed("size", "cohort_size")
    rank = F.when(F.col("cohort_size") >= cohort.least, F.bround(100.0 * (2 * F.col("upto") - F.col("n")) / (2 * F.col("cohort_size")), 1))
    ranked = ranked.select("cohort_year", "value", "cohort_size", rank.alias("percentile"))
    return probes.join(ranked, ["cohort_year", "value"], "left").select("appid", "cohort_year", "value", F.coalesce("cohort_size", F.lit(0)).alias("cohort_size"), "percentile")


def statistics(reference: DataFrame, cohort: Cohort = Cohort()) -> DataFrame:
    """(cohort_year, size, reliable, median): the exact whole median of each pooled year."""
    c = in_order(pooled(reference, cohort))
    at = lambda k: F.max(F.when((F.col("upto") - F.col("n") < k) & (F.col("upto") >= k), F.col("value")))
    low, high = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1
    out = c.groupBy("cohort_year", "size").agg(at(low).alias("low"), at(high).alias("high"))
    return out.select("cohort_year", "size", (F.col("size") >= cohort.least).alias("reliable"), F.floor((F.col("low") + F.col("high")) / 2).cast("bigint").alias("median"))


def going_rates(prices: DataFrame, cohort: Cohort = Cohort()) -> DataFrame:
    """(cohort_year, n_prices, rate): the commonest price of each pooled year, the higher of ties.

    Null in a cohort of fewer than ``least`` prices. ``prices`` has cohort_year and value (cents).
    """
    best = F.max(F.struct("n", "value"))
    out = pooled(prices.filter("value > 0"), cohort).groupBy("cohort_year").agg(F.sum("n").alias("n_prices"), best.alias("best"))
    return out.select("cohort_year", "n_prices", F.when(F.col("n_prices") >= cohort.least, F.col("best.value")).alias("rate"))


def rate_runs(rates: DataFrame) -> DataFrame:
    """(rate, from_year, to_year): runs of years with one going rate.

    The rates are one row a year, so the window over all of them is small.
    """
    known = rates.filter("rate is not null").withColumn("one", F.lit(1))
    order = Window.partitionBy("one").orderBy("cohort_year")
    marked = known.withColumn("new", (~F.col("rate").eqNullSafe(F.lag("rate").over(order))).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("run", "rate").agg(F.min("cohort_year").alias("from_year"), F.max("cohort_year").alias("to_year")).drop("run")


def recent_rates(years: DataFrame, rates: DataFrame, lookback: int = 3) -> DataFrame:
    """(cohort_year, rate, rate_year): the rate of the latest year, up to ``lookback`` years back."""
    asked = years.select("cohort_year").distinct().withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(lookback))))
    found = asked.join(rates.filter("rate is not null").select((F.col("cohort_year")).alias("rate_year"), "rate"), F.col("rate_year") == F.col("cohort_year") - F.col("back"))
    return found.groupBy("cohort_year").agg(F.min_by("rate", "back").alias("rate"), F.max("rate_year").alias("rate_year"))


def segment_rankability(titles: DataFrame, axes: list[str], least: int = 8) -> DataFrame:
    """(axis, titles, rankable): how many titles keep a large enough cohort under each extra axis.

    One pass: the titles are read once and counted under every axis together.
    """
    sets = [[F.col("cohort_year")], *([F.col("cohort_year"), F.col(a)] for a in axes)]
    bit = F.grouping_id()
    counts = titles.groupingSets(sets, F.col("cohort_year"), *(F.col(a) for a in axes)).agg(F.count("*").alias("n"), bit.alias("left_out"))
    every = 2 ** len(axes) - 1
    names = F.create_map(*(F.lit(x) for k, a in [(every, "none"), *((every - 2 ** (len(axes) - 1 - i), a) for i, a in enumerate(axes))] for x in (k, a)))
    axis = names[F.col("left_out")].alias("axis")
    return counts.groupBy(axis).agg(F.sum("n").alias("titles"), F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)).alias("rankable"))
