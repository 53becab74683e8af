"""Which titles are next in line for a lookup, a probe or research."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchgrid.schemas import DAY_ONE

SELECTED = 5


def missing_prices(titles: DataFrame) -> DataFrame:
    """Titles without a launch price, by date."""
    return titles.filter(F.col("launch_price_cents").isNull()).orderBy("store_date", "appid")


def answered(titles: DataFrame) -> DataFrame:
    """Titles both of whose signals are known, by date; "unknown" is no answer."""
    return titles.filter((F.col("studio") != "unknown") & (F.col("support") != "unknown")).orderBy("store_date", "appid")


def probe_scope(titles: DataFrame, include_ports: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """Dated titles whose launch may have been earlier; ports only if asked for. ``asked``: appids to keep to."""
    scope = titles.filter("store_date is not null")
    if not include_ports:
        scope = scope.filter(F.col("launch_type").isin(DAY_ONE, "unknown"))
    return scope if asked is None else scope.join(asked.select("appid").distinct(), "appid", "left_semi")


def research(scored: DataFrame) -> DataFrame:
    """(appid, store_date, reason, detail): unlabelled titles that the rubric leaves open, by date.

    ``scored``: appid, store_date, expected, predicted, unresolved, reasons.
    """
    rows = scored.filter("expected is null and predicted is null")
    return rows.select("appid", "store_date", F.col("unresolved").alias("reason"), F.array_join("reasons", "; ").alias("detail")).orderBy("store_date", "appid")


def selected(queue: DataFrame, most: int | None = SELECTED, asked: DataFrame | None = None) -> DataFrame:
    """The first ``most`` of an ordered queue; naming titles is the selection, without a limit of its own."""
    if asked is not None:
        return queue.join(asked.select("appid").distinct(), "appid", "left_semi")
    return queue.orderBy("store_date", "appid").limit(most) if most else queue
