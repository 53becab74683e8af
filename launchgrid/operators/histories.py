"""What a title's companies did before: as-of records, overlaps and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchgrid.functions.text import companies, raw_names
from launchgrid.schemas import OUTCOMES
from launchgrid.sources.shared import written

DEFAULT_VOLUME, DEFAULT_POSITIVE = 50.0, 75.0
RECORD = ("n", "n_pct", "s_pct", "n_pos", "s_pos")
NO_DAY = 2**31 - 1
NAMES_TOLD = 3
HEAVY_LISTS = 200


def _two_decimals(tenths: Column, n: Column) -> Column:
    """The mean of ``n`` values whose tenths sum to ``tenths``; ties are exact, so half to even holds."""
    return F.bround(10.0 * tenths / n, 0) / 100


def named(titles: DataFrame, *columns: str) -> DataFrame:
    """One row per title and canonical publisher: appid, pos, company and the asked columns.

    Each distinct publisher text is normalised once, however many titles carry it.
    """
    texts = titles.select("publisher").filter("publisher is not null").distinct()
    known = texts.select("publisher", F.posexplode(companies(F.col("publisher"))).alias("pos", "company"))
    return titles.select("appid", "publisher", *columns).join(known, "publisher").select("appid", "pos", "company", *columns)


def publisher_records(titles: DataFrame) -> DataFrame:
    """(appid, title_count, mean_volume_pct, mean_positive_pct, known), as of each title's date.

    ``titles``: appid, publisher, store_date, percentile, positive_pct. Counted are dated titles of
    the company that came out strictly earlier; for an undated title all dated ones are. The first
    listed company with any wins. Running sums go over (company, day) totals, so a large
    publisher is some thousand rows; an undated title stands on a day after all others.
    """
    day = F.coalesce(F.date_diff("store_date", F.lit("1970-01-01").cast("date")), F.lit(NO_DAY))
    dated = F.col("day") < NO_DAY
    tenths = lambda c: F.sum(F.when(dated, F.bround(F.col(c) * 10, 0).cast("bigint")))
    by = named(titles, "store_date", "percentile", "positive_pct").withColumn("day", day)
    daily = by.groupBy("company", "day").agg(
        F.count_if(dated).alias("n"), F.count_if(dated & F.col("percentile").isNotNull()).alias("n_pct"), tenths("percentile").alias("s_pct"), F.count_if(dated & F.col("positive_pct").isNotNull()).alias("n_pos"), tenths("positive_pct").alias("s_pos")
    )
    before = Window.partitionBy("company").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    running = daily.select("company", "day", *(F.sum(c).over(before).alias(c) for c in RECORD))
    first = by.select("appid", "pos", "company", "day").join(running, ["company", "day"]).filter("n > 0").groupBy("appid").agg(F.min_by(F.struct(*RECORD), "pos").alias("r"))
    return _as_record(titles.select("appid").join(first, "appid", "left"))


def live_records(tracked: DataFrame, titles: DataFrame) -> DataFrame:
    """The same for titles not out yet: every dated title of history counts."""
    tenths = lambda c: F.bround(F.col(c) * 10, 0).cast("bigint")
    total = named(titles.filter("store_date is not null"), "percentile", "positive_pct").groupBy("company").agg(
        F.count("*").alias("n"), F.count("percentile").alias("n_pct"), F.sum(tenths("percentile")).alias("s_pct"), F.count("positive_pct").alias("n_pos"), F.sum(tenths("positive_pct")).alias("s_pos")
    )
    first = named(tracked).join(total, "company").groupBy("appid").agg(F.min_by(F.struct("n", "n_pct", "s_pct", "n_pos", "s_pos"), "pos").alias("r"))
    return _as_record(tracked.select("appid").join(first, "appid", "left"))


def _as_record(rows: DataFrame) -> DataFrame:
    mean = lambda s, n, default: F.coalesce(F.when(F.col(n) > 0, _two_decimals(F.col(s), F.col(n))), F.lit(default))
    return rows.select("appid", F.coalesce("r.n", F.lit(0)).alias("title_count"), mean("r.s_pct", "r.n_pct", DEFAULT_VOLUME).alias("mean_volume_pct"), mean("r.s_pos", "r.n_pos", DEFAULT_POSITIVE).alias("mean_positive_pct"), F.col("r").isNotNull().alias("known"))


def overlap_records(targets: DataFrame, labelled: DataFrame, heavy_lists: int = HEAVY_LISTS) -> DataFrame:
    """(appid, history, flop, underperform, success, breakout): labelled titles that share a raw
    developer or publisher name with each target, itself excluded, with no date cutoff.

    Titles of the same names are alike, so each distinct list of names is counted once, and a pair of lists that meet is
    counted at the first name they share. A name on over ``heavy_lists`` labelled lists would make too many pairs: lists are first
    told apart by their heavy names only, which few combinations do, and what shares a heavy name is counted
    between those combinations. Other pairs meet at a light name, at most ``heavy_lists`` to a list and name. So a title may have
    any number of names, and a name any number of titles.
    """
    cols = ("history", *OUTCOMES)
    names = F.array_sort(F.array_distinct(raw_names(F.col("developer"), F.col("publisher"))))
    asked = targets.select("appid", names.alias("names"))
    held = labelled.select(names.alias("names"), "outcome").filter(F.size("names") > 0).groupBy("names").agg(F.count("*").alias("history"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    held = written(held, "name_lists")
    heavy = written(held.select(F.explode("names").alias("name")).groupBy("name").count().filter(F.col("count") > heavy_lists).select("name"), "heavy_names")
    lists = written(_with_heavy(asked.filter(F.size("names") > 0).select("names").distinct(), heavy), "name_lists")
    held = written(_with_heavy(held, heavy), "name_lists")

    def first_shared(a: str, b: str) -> Column:
        return F.try_element_at(F.array_intersect(a, b), F.lit(1)) == F.col("name")

    combos = lists.filter(F.size("heavy") > 0).select("heavy").distinct().select("heavy", F.explode("heavy").alias("name"))
    theirs = held.filter(F.size("heavy") > 0).groupBy(F.col("heavy").alias("other")).agg(*(F.sum(c).alias(c) for c in cols)).select("*", F.explode("other").alias("name"))
    by_combo = combos.join(theirs, "name").filter(first_shared("heavy", "other")).groupBy("heavy").agg(*(F.sum(c).alias(f"h_{c}") for c in cols))
    light = F.explode(F.array_except("names", "heavy")).alias("name")
    met = lists.select("names", "heavy", light).join(held.select(*cols, light, F.col("names").alias("other"), F.col("heavy").alias("other_heavy")), "name")
    met = met.filter(~F.arrays_overlap("heavy", "other_heavy") & first_shared("names", "other")).groupBy("names").agg(*(F.sum(c).alias(f"l_{c}") for c in cols))
    summed = lists.join(by_combo, "heavy", "left").join(met, "names", "left").select("names", *((F.coalesce(f"h_{c}", F.lit(0)) + F.coalesce(f"l_{c}", F.lit(0))).alias(c) for c in cols))
    found = asked.join(summed, "names", "left")
    own = labelled.select("appid", F.col("outcome").alias("own"), F.lit(True).alias("counted"))
    itself = lambda c: F.when((F.size("names") > 0) & (F.col("counted") if c == "history" else F.col("own") == c), 1).otherwise(0)
    return found.join(own, "appid", "left").select("appid", *((F.coalesce(c, F.lit(0)) - itself(c)).cast("bigint").alias(c) for c in cols))


def _with_heavy(lists: DataFrame, heavy: DataFrame) -> DataFrame:
    """``lists`` with the heavy ones of their ``names``, in order."""
    has = lists.select("names", F.explode("names").alias("name")).join(heavy, "name").groupBy("names").agg(F.array_sort(F.collect_list("name")).alias("heavy"))
    return lists.join(has, "names", "left").withColumn("heavy", F.coalesce("heavy", F.array().cast("array<string>")))


def first_names(targets: DataFrame, labelled: DataFrame, most: int = NAMES_TOLD) -> DataFrame:
    """(appid, names): the first ``most`` distinct titles, by name, of each target's overlap history.

    Of each raw name only its first titles by name are joined, one more than are asked for, as a
    target itself may be among them; so a name that very many titles share brings a handful.
    """
    spread = lambda df, *columns: df.select("appid", *columns, F.explode(F.array_distinct(raw_names(F.col("developer"), F.col("publisher")))).alias("name"))
    held = spread(labelled, "game_name").groupBy("name", "game_name").agg(F.min("appid").alias("low"), F.max("appid").alias("high"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("game_name"))
    few = held.withColumn("place", place).filter(F.col("place") <= most + 1)
    met = spread(targets).join(few, "name").filter((F.col("low") != F.col("appid")) | (F.col("high") != F.col("appid")))
    return met.groupBy("appid").agg(F.slice(F.array_sort(F.collect_set("game_name")), 1, most).alias("names"))


def publisher_stats(titles: DataFrame, least_titles: int = 2) -> DataFrame:
    """Aggregates per canonical publisher over all titles (company, title_count, means, years).

    ``titles``: appid, publisher, cohort_year, percentile, positive_pct, platforms.
    """
    by = named(titles, "cohort_year", "percentile", "positive_pct", "platforms")
    out = by.groupBy("company").agg(
        F.count("*").alias("title_count"),
        _two_decimals(F.sum(F.bround(F.col("percentile") * 10, 0).cast("bigint")), F.count("percentile")).alias("mean_volume_pct"),
        _two_decimals(F.sum(F.bround(F.col("positive_pct") * 10, 0).cast("bigint")), F.count("positive_pct")).alias("mean_positive_pct"),
        F.bround(F.sum("platforms") / F.count("*").cast("double"), 2).alias("mean_breadth"),
        F.min("cohort_year").alias("first_year"), F.max("cohort_year").alias("last_year"),
        F.count("percentile").alias("_p"), F.count("positive_pct").alias("_s"),
    )
    return out.filter((F.col("title_count") >= least_titles) & (F.col("_p") > 0) & (F.col("_s") > 0)).drop("_p", "_s").withColumn("span_years", F.col("last_year") - F.col("first_year"))


def dilution(titles: DataFrame, days: int = 90) -> DataFrame:
    """(appid, company, nearby): titles of the same publisher within ``days`` either way.

    Windows go over (company, day) counts, so a large publisher is some thousand rows.
    """
    day = F.date_diff("store_date", F.lit("1970-01-01").cast("date"))
    by = named(titles.filter("store_date is not null"), "store_date").withColumn("day", day)
    near = Window.partitionBy("company").orderBy("day").rangeBetween(-days, days)
    daily = by.groupBy("company", "day").agg(F.count("*").alias("n")).select("company", "day", F.sum("n").over(near).alias("n"))
    return by.select("appid", "company", "day").join(daily, ["company", "day"]).select("appid", "company", (F.col("n") - 1).alias("nearby"))
