"""The append-only series of tracked titles: changes, latest rows and rollups, as batch jobs."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from launchgrid.functions.dates import is_coarse, loose_date
from launchgrid.sources.shared import last_state, partitions, put_state, remove

AGE, GRACE, REMOVED = 30, 7, "removed"


def date_changes(polls: DataFrame) -> DataFrame:
    """(appid, observed_at, previous_raw, new_raw, previous_date, new_date, days_moved, coarse, is_delay).

    ``polls``: appid, captured_at, raw. A first capture, an unchanged text and a change from null
    say nothing.
    """
    order = Window.partitionBy("appid").orderBy("captured_at")
    rows = polls.select("appid", "captured_at", "raw", F.lag("raw").over(order).alias("before"), F.row_number().over(order).alias("k"))
    changed = rows.filter((F.col("k") > 1) & F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("raw")))
    return described_changes(changed.select("appid", F.col("captured_at").alias("observed_at"), F.col("before").alias("previous_raw"), F.col("raw").alias("new_raw")))


def described_changes(changes: DataFrame) -> DataFrame:
    old, new = loose_date(F.col("previous_raw")), loose_date(F.col("new_raw"))
    out = changes.withColumns({"previous_date": old, "new_date": new}).withColumn("days_moved", F.date_diff("new_date", "previous_date")).withColumn("coarse", is_coarse(F.col("previous_raw")))
    return out.withColumn("is_delay", F.coalesce(~F.col("coarse") & (F.col("days_moved") > 0), F.lit(False)))


def delay_totals(changes: DataFrame) -> DataFrame:
    """(appid, changes, delay_count, total_days_delayed)."""
    return changes.groupBy("appid").agg(F.count("*").alias("changes"), F.count_if("is_delay").alias("delay_count"), F.sum(F.when(F.col("is_delay"), F.col("days_moved")).otherwise(0)).alias("total_days_delayed"))


def latest(series: DataFrame, key: str = "appid", at: str = "captured_at") -> DataFrame:
    """Each title's last row, by partial aggregation rather than a sort."""
    rest = [c for c in series.columns if c != key]
    return series.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def recent(series: DataFrame, n: int = 60, key: str = "appid", at: str = "captured_at", since: datetime.date | None = None) -> DataFrame:
    """Each title's ``n`` last rows (1 to 1000), with their place; of a series kept by day, only the days from ``since`` on are read."""
    if not 1 <= n <= 1000:
        raise ValueError("n must be from 1 to 1000")
    if since is not None:
        series = series.filter(F.col("day") >= F.lit(since))
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return series.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def daily_rollup(series: DataFrame) -> DataFrame:
    """(appid, day, polls, peak_players, sum_players, last_players)."""
    return series.groupBy("appid", F.to_date("captured_at").alias("day")).agg(F.count("*").alias("polls"), F.max("players").alias("peak_players"), F.sum("players").alias("sum_players"), F.max_by("players", "captured_at").alias("last_players"))


def append_days(series: DataFrame, path: str) -> None:
    """Add snapshots to a series kept by day of capture."""
    series.withColumn("day", F.to_date("captured_at")).write.mode("append").partitionBy("day").parquet(path)


def roll_up(spark: SparkSession, series: str, rollup: str, today: datetime.date, age: int = AGE, grace: int = GRACE) -> list[datetime.date]:
    """Roll up the days of ``series`` (kept by day) that are over ``age`` days old into ``rollup``, also by day; the days written.

    A day is written anew, alone, only if its snapshots have changed since it was written last: what a closed day's files looked
    like is kept beside the rollup, after it. So late snapshots of a day bring its row up to date, a run that broke off is made good
    by the next, and an unchanged day's file is not touched. Snapshots that are rolled up are kept for ``grace`` more
    days, then removed. Later ones of a removed day are refused: their day stays as it is.
    """
    told = last_state(spark, f"{rollup}/_days")
    done = json.loads(told[1]) if told else {}
    found = partitions(spark, series, "day")
    age_of = {d: (today - datetime.date.fromisoformat(d)).days for d in found if d[:1].isdigit()}
    due = sorted(d for d, n in age_of.items() if n > age and done.get(d) not in (found[d], REMOVED))
    if due:
        rows = spark.read.parquet(series).filter(F.col("day").isin(*map(datetime.date.fromisoformat, due)))
        daily_rollup(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(rollup)
        done |= {d: found[d] for d in due}
        put_state(spark, f"{rollup}/_days", json.dumps(done))
    spent = [d for d, n in age_of.items() if n > age + grace]
    if spent:
        put_state(spark, f"{rollup}/_days", json.dumps(done | dict.fromkeys(spent, REMOVED)))
        for d in spent:
            remove(spark, f"{series}/day={d}")
    return [datetime.date.fromisoformat(d) for d in due]


def sudden_drops(series: DataFrame, points: float, value: str = "positive_pct") -> DataFrame:
    """Rows whose value fell by ``points`` or more since the title's row before."""
    order = Window.partitionBy("appid").orderBy("captured_at")
    rows = series.withColumn("change", F.col(value) - F.lag(value).over(order))
    return rows.filter(F.col("change") <= -points)


def upserted(old: DataFrame, new: DataFrame, key: str = "appid", kept: tuple[str, ...] = ("store_date", "cohort_year")) -> DataFrame:
    """``old`` with ``new``'s rows put over it; a null never blanks one of the ``kept`` columns."""
    fields = [c for c in old.columns if c != key]
    n = new.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in fields))
    both = old.join(n, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in kept else F.when(F.col("_new").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(key, *(pick(c).alias(c) for c in fields))
