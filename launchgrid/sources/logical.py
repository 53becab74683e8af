"""The star-schema tables seen as titles, reviews, polls and the rest, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchgrid.functions.dates import launch_type
from launchgrid.schemas import Windows

#: Order and ship dates lie years apart, so the windows are longer than a store's.
WINDOWS = Windows(365, 730, 1095)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, as a released title."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    k = F.col("o_orderkey")
    shift = F.when(k % 10 < 6, k % 3).when(k % 10 == 6, 20).when(k % 10 < 9, 400).otherwise(-30).cast("int")
    store = F.to_date("o_orderdate")
    suffix = F.when(k % 4 == 0, "").when(k % 4 == 1, " (Japan)").when(k % 4 == 2, ", Inc.").otherwise(" Co., Ltd. (Asia)")
    port = F.when(k % 7 == 0, "\nFeral Interactive (Mac)").otherwise("")
    out = o.select(
        k.alias("appid"), F.concat(F.lit("Title "), k.cast("string")).alias("game_name"), F.concat("c_name", suffix, port).alias("publisher"), F.col("c_name").alias("developer"),
        F.when(k % 13 == 0, "Action\nMassively Multiplayer").when(k % 5 != 0, "Action\nFree To Play").alias("genres"),
        store.alias("store_date"), F.date_sub(store, shift).alias("original_date"), F.year(store).alias("cohort_year"),
        ((F.floor(F.col("o_totalprice") / 100000) + 1) * 1000).cast("int").alias("launch_price_cents"), F.lit(True).alias("on_windows"), (k % 3 == 0).alias("on_mac"), (k % 4 == 0).alias("on_linux"),
        F.when(k % 2 == 0, "aaa").otherwise("aa_leaning_aaa").alias("budget_tier"), F.when(k % 6 == 0, "pre_launch").otherwise("none_listed").alias("demo_timing"), F.when(k % 9 != 0, (k % 4).cast("int")).alias("launch_day_dlc_count"),
        F.when(F.col("o_orderpriority").startswith("1"), "flop").when(F.col("o_orderpriority").startswith("2"), "underperform").when(F.col("o_orderpriority").startswith("3"), "success").when(F.col("o_orderpriority").startswith("5"), "breakout").alias("outcome"),
        F.when(k % 11 == 0, "closed").when(F.col("o_orderstatus") == "F", "continued").when(F.col("o_orderstatus") == "O", "severe_layoffs").otherwise("unknown").alias("studio"),
        F.when(F.col("c_mktsegment") == "BUILDING", "sustained").when(F.col("c_mktsegment") == "AUTOMOBILE", "curtailed").when(F.col("c_mktsegment") == "MACHINERY", "abandoned").otherwise("unknown").alias("support"),
    )
    return out.withColumn("launch_type", launch_type(F.col("store_date"), F.col("original_date")))


TITLES = """
titles0 AS (
  SELECT o_orderkey AS appid, 'Title ' || o_orderkey AS game_name,
    c_name || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' (Japan)' WHEN 2 THEN ', Inc.' ELSE ' Co., Ltd. (Asia)' END
      || CASE WHEN o_orderkey % 7 = 0 THEN chr(10) || 'Feral Interactive (Mac)' ELSE '' END AS publisher,
    c_name AS developer,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Action' || chr(10) || 'Massively Multiplayer' WHEN o_orderkey % 5 <> 0 THEN 'Action' || chr(10) || 'Free To Play' END AS genres,
    o_orderdate::DATE AS store_date,
    o_orderdate::DATE - (CASE WHEN o_orderkey % 10 < 6 THEN o_orderkey % 3 WHEN o_orderkey % 10 = 6 THEN 20 WHEN o_orderkey % 10 < 9 THEN 400 ELSE -30 END)::INTEGER AS original_date,
    year(o_orderdate)::INTEGER AS cohort_year, ((floor(o_totalprice / 100000) + 1) * 1000)::INTEGER AS launch_price_cents,
    true AS on_windows, o_orderkey % 3 = 0 AS on_mac, o_orderkey % 4 = 0 AS on_linux,
    CASE WHEN o_orderkey % 2 = 0 THEN 'aaa' ELSE 'aa_leaning_aaa' END AS budget_tier,
    CASE WHEN o_orderkey % 6 = 0 THEN 'pre_launch' ELSE 'none_listed' END AS demo_timing,
    CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 4)::INTEGER END AS launch_day_dlc_count,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'flop' WHEN '2' THEN 'underperform' WHEN '3' THEN 'success' WHEN '5' THEN 'breakout' END AS outcome,
    CASE WHEN o_orderkey % 11 = 0 THEN 'closed' WHEN o_orderstatus = 'F' THEN 'continued' WHEN o_orderstatus = 'O' THEN 'severe_layoffs' ELSE 'unknown' END AS studio,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'sustained' WHEN 'AUTOMOBILE' THEN 'curtailed' WHEN 'MACHINERY' THEN 'abandoned' ELSE 'unknown' END AS support
  FROM orders JOIN customer ON c_custkey = o_custkey
), titles AS (
  SELECT *, CASE WHEN store_date - original_date < -7 THEN 'unknown' WHEN store_date - original_date > 7 THEN 'delayed_port' ELSE 'day_one_steam' END AS launch_type FROM titles0
)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, as dated reviews of a title."""
    i = read(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("appid"), F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") != "R").alias("positive"), F.col("l_quantity").cast("bigint").alias("weight"))


REVIEWS = """
days AS (
  SELECT l_orderkey AS appid, l_shipdate::DATE AS day, sum(l_quantity::BIGINT)::BIGINT AS n,
    sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS positive
  FROM lineitem GROUP BY ALL
)"""

SUMMARY = """
win AS (
  SELECT t.appid,
    sum(CASE WHEN day - store_date BETWEEN 0 AND 364 THEN n ELSE 0 END)::BIGINT AS n1, sum(CASE WHEN day - store_date BETWEEN 0 AND 364 THEN positive ELSE 0 END)::BIGINT AS p1,
    sum(CASE WHEN day - store_date BETWEEN 0 AND 729 THEN n ELSE 0 END)::BIGINT AS n2, sum(CASE WHEN day - store_date BETWEEN 0 AND 729 THEN positive ELSE 0 END)::BIGINT AS p2,
    sum(CASE WHEN day - store_date BETWEEN 0 AND 1094 THEN n ELSE 0 END)::BIGINT AS n3, sum(CASE WHEN day - store_date BETWEEN 0 AND 1094 THEN positive ELSE 0 END)::BIGINT AS p3,
    sum(coalesce(n, 0))::BIGINT AS n4, sum(coalesce(positive, 0))::BIGINT AS p4
  FROM titles t LEFT JOIN days d ON d.appid = t.appid GROUP BY t.appid
), summary AS (
  SELECT appid, nullif(n1, 0) AS first_total, nullif(n3, 0) AS third_total,
    CASE WHEN n1 > 0 THEN round_even(100.0::DOUBLE * p1 / n1, 1) END AS positive_pct,
    CASE WHEN n1 > 0 AND n3 > 0 THEN n3::DOUBLE / n1::DOUBLE END AS retention FROM win
)"""

COHORTS = """
reference AS (
  SELECT cohort_year, first_total AS value, count(*)::BIGINT AS n FROM titles JOIN summary USING (appid)
  WHERE launch_type = 'day_one_steam' AND first_total IS NOT NULL GROUP BY ALL
), pooled AS (
  SELECT cohort_year + d AS cohort_year, value, sum(n)::BIGINT AS n FROM reference, (VALUES (-1), (0), (1)) s(d) GROUP BY ALL
), ranked AS (
  SELECT appid, t.cohort_year, s.first_total AS value, coalesce(sum(p.n), 0)::BIGINT AS cohort_size,
    sum(CASE WHEN p.value < s.first_total THEN p.n ELSE 0 END)::BIGINT AS below, sum(CASE WHEN p.value <= s.first_total THEN p.n ELSE 0 END)::BIGINT AS upto
  FROM titles t JOIN summary s USING (appid) LEFT JOIN pooled p ON p.cohort_year = t.cohort_year WHERE s.first_total IS NOT NULL GROUP BY ALL
), percentiles AS (
  SELECT appid, cohort_year, value, cohort_size, CASE WHEN cohort_size >= 8 THEN round_even(100.0::DOUBLE * (below + upto) / (2 * cohort_size), 1) END AS percentile FROM ranked
), rates AS (
  SELECT cohort_year, sum(n)::BIGINT AS n_prices, CASE WHEN sum(n) >= 8 THEN arg_max(value, (n, value)) END::INTEGER AS rate FROM (
    SELECT cohort_year + d AS cohort_year, launch_price_cents AS value, count(*) AS n FROM titles, (VALUES (-1), (0), (1)) s(d)
    WHERE launch_type = 'day_one_steam' AND launch_price_cents > 0 GROUP BY ALL) GROUP BY cohort_year
)"""

BASE = f"WITH {TITLES.strip()},{REVIEWS},{SUMMARY}, {COHORTS.strip()}"


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, as a poll of a tracked title. The raw date text follows the event type."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    raw = F.when(kind == "view", "Nov 12, 2026").when(kind == "click", "Mar 4, 2027").when(kind == "purchase", "Q4 2026").when(kind == "error", F.lit(None).cast("string")).otherwise("Coming soon")
    return e.select(F.col("user_id").alias("appid"), F.col("ts").alias("captured_at"), F.col("event_id").alias("poll_id"), F.floor(F.col("value") * 100).cast("bigint").alias("players"), raw.alias("raw"), kind.alias("kind"), "props")


POLLS = """
polls AS (
  SELECT user_id AS appid, ts AS captured_at, event_id AS poll_id, floor(value * 100)::BIGINT AS players, event_type AS kind, props,
    CASE event_type WHEN 'view' THEN 'Nov 12, 2026' WHEN 'click' THEN 'Mar 4, 2027' WHEN 'purchase' THEN 'Q4 2026' WHEN 'error' THEN NULL ELSE 'Coming soon' END AS raw
  FROM events
)"""
