"""Checks of curated tables, as jobs that return violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchgrid.functions.text import title_key
from launchgrid.schemas import BUDGETS, CONFIDENCES, CURATED_COLUMNS, LAUNCH_TYPES, OUTCOMES, RESEARCH, STUDIO, SUPPORT

ALLOWED = {"platform_launch_type": LAUNCH_TYPES, "budget_tier": BUDGETS, "studio_signal": STUDIO, "support_signal": SUPPORT, "resolved_outcome": OUTCOMES, "label_confidence": CONFIDENCES, "research_status": RESEARCH}


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in CURATED_COLUMNS if c not in df.columns]


def violations(rows: DataFrame) -> DataFrame:
    """(line, appid, rule, detail) of every broken rule. ``rows``: the curated columns as text, and line."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    broken = lambda when, rule, detail: F.when(when, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
    checks = [broken(~blank(c) & ~text(c).isin(*allowed), "unknown_value", F.concat_ws("", F.lit(f"{c}="), text(c), F.lit(" not in " + ",".join(allowed)))) for c, allowed in ALLOWED.items()]
    checks += [broken(blank(c), "required", F.lit(c)) for c in ("steam_appid", "game_name")]
    checks += [
        broken(~blank("steam_appid") & text("steam_appid").try_cast("bigint").isNull(), "bad_integer", text("steam_appid")),
        broken(~blank("original_release_date") & F.try_to_timestamp(text("original_release_date"), F.lit("yyyy-MM-dd")).isNull(), "bad_date", text("original_release_date")),
        broken(~blank("launch_price_usd") & text("launch_price_usd").try_cast("double").isNull(), "bad_price", text("launch_price_usd")),
        broken(~blank("resolved_outcome") & (F.when(blank("research_status"), "not_researched").otherwise(text("research_status")) == "not_researched"), "label_without_research", text("resolved_outcome")),
        broken(blank("resolved_outcome") & (text("research_status") == "researched"), "research_without_label", F.lit("")),
    ]
    own = rows.select("line", text("steam_appid").alias("appid"), F.explode(F.array_compact(F.array(*checks))).alias("v")).select("line", "appid", "v.*")
    keyed = rows.filter(~blank("steam_appid")).select("line", text("steam_appid").alias("appid"))
    first = keyed.groupBy("appid").agg(F.min("line").alias("first"), F.count("*").alias("n")).filter("n > 1")
    twice = keyed.join(first, "appid").filter(F.col("line") > F.col("first")).select("line", "appid", F.lit("duplicate").alias("rule"), F.concat(F.lit("first on line "), F.col("first").cast("string")).alias("detail"))
    return own.unionByName(twice)


def warnings(titles: DataFrame, as_of, window_days: int = 90, addon_cap: int = 12) -> DataFrame:
    """(appid, warning): names that differ from the store's, many add-ons, odd or unelapsed dates."""
    notes = F.array_compact(F.array(
        F.when(title_key(F.col("game_name")) != title_key(F.col("store_name")), "name_mismatch"),
        F.when(F.col("dlc_count") > addon_cap, "many_addons"),
        F.when(F.col("store_date").isNull(), "no_date").when(F.col("store_date") > as_of, "future_date").when(F.date_add("store_date", window_days) > as_of, "window_not_elapsed"),
        F.when(F.col("store_date") < F.col("original_date"), "store_before_original"),
    ))
    return titles.select("appid", F.explode(notes).alias("warning"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on more than one row, with how many."""
    return rows.withColumn("copies", F.count("*").over(Window.partitionBy(key))).filter("copies > 1")


def pending(queue: DataFrame, answered: DataFrame, key: str = "appid") -> DataFrame:
    """The queue's rows that no answer has yet."""
    return queue.join(answered.select(key).distinct(), key, "left_anti")


def selection(requested: DataFrame, available: DataFrame, key: str = "appid") -> DataFrame:
    """(key, present) of each requested key."""
    there = available.select(key).distinct().withColumn("present", F.lit(True))
    return requested.select(key).distinct().join(there, key, "left").select(key, F.coalesce("present", F.lit(False)).alias("present"))


def capped(rows: DataFrame, most: int = 60) -> DataFrame:
    """``rows`` if there are at most ``most``; else raises. For validation sets that people pay for."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows to validate")
    return rows
