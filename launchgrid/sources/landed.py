"""Landed JSON payloads as typed tables. Every reader takes a table with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchgrid.functions.dates import is_coarse, loose_date
from launchgrid.functions.measures import to_cents
from launchgrid.functions.text import joined
from launchgrid.schemas import APP_DETAILS, BINDINGS, DRAFT, PLAYERS, REVIEWS, STUDIO, SUPPORT


def app_details(raw: DataFrame, col: str = "payload") -> DataFrame:
    """One row per title whose request succeeded."""
    one = raw.select(F.explode(F.from_json(F.col(col), APP_DETAILS)).alias("key", "entry")).filter("entry.success and entry.data is not null")
    d = one.select(F.col("key").try_cast("bigint").alias("appid"), "entry.data.*")
    named = lambda c: F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<struct<id:string,description:string>>")), lambda x: x["description"]))
    ids = F.coalesce("dlc", F.array().cast("array<bigint>"))
    raw_date = F.col("release_date.date")
    return d.select(
        "appid", "name", "is_free", "short_description", "header_image", joined(F.col("developers")).alias("developers"), joined(F.col("publishers")).alias("publishers"), joined(named(F.col("genres"))).alias("genres"),
        F.col("price_overview.initial").alias("price_initial_cents"), F.col("price_overview.final").alias("price_final_cents"), F.col("price_overview.discount_percent").alias("discount_percent"), F.col("price_overview.currency").alias("price_currency"),
        *(F.coalesce(f"platforms.{p}", F.lit(False)).alias(f"on_{p}") for p in ("windows", "mac", "linux")), F.col("metacritic.score").alias("metacritic_score"), F.col("metacritic.url").alias("metacritic_url"),
        F.array_compact(F.transform(F.coalesce("demos", F.array().cast("array<struct<appid:string>>")), lambda x: x["appid"].try_cast("bigint"))).alias("demo_ids"), ids.alias("dlc_ids"),
        F.exists(named(F.col("categories")), lambda x: x == "In-App Purchases").alias("has_in_app_purchases"),
        F.coalesce("release_date.coming_soon", F.lit(False)).alias("coming_soon"), raw_date.alias("release_date_raw"), loose_date(raw_date).alias("release_date"), is_coarse(raw_date).alias("is_coarse"),
    )


def review_summary(raw: DataFrame, col: str = "payload") -> DataFrame:
    """``raw`` with review totals; all null where the request did not succeed."""
    r = F.from_json(F.col(col), REVIEWS)
    rows = raw.withColumn("_r", r)
    ok = F.coalesce(F.col("_r.success") == 1, F.lit(False))
    return rows.select(*raw.columns, *(F.when(ok, F.col(f"_r.query_summary.{f}")).alias(n) for f, n in (("total_reviews", "review_total"), ("total_positive", "review_positive"), ("total_negative", "review_negative"), ("review_score_desc", "review_score_desc")))).drop(col)


def current_players(raw: DataFrame, col: str = "payload") -> DataFrame:
    p = F.from_json(F.col(col), PLAYERS)["response"]
    return raw.withColumn("concurrent_players", F.when(p["result"] == 1, p["player_count"])).drop(col)


def regional_offers(raw: DataFrame, col: str = "payload") -> DataFrame:
    """(appid, country, available, currency, price_cents). ``raw``: appid, country, fetched, payload.

    A failed request has no row; an unsuccessful answer is a closed market.
    """
    rows = raw.filter("fetched").withColumn("_m", F.element_at(F.map_values(F.from_json(F.col(col), APP_DETAILS)), 1))
    ok = F.coalesce(F.col("_m.success"), F.lit(False))
    return rows.select("appid", "country", ok.alias("available"), F.when(ok, F.col("_m.data.price_overview.currency")).alias("currency"), F.when(ok, F.col("_m.data.price_overview.initial")).alias("price_cents"))


def offers_json(offers: DataFrame) -> DataFrame:
    """(appid, regional_offers): each title's markets as JSON, countries in order; a closed market
    has only ``available``."""
    entry = F.struct("available", F.when(F.col("available"), F.col("currency")).alias("currency"), F.when(F.col("available"), F.col("price_cents")).alias("price_cents"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("country").alias("k"), entry.alias("v"))))
    return offers.groupBy("appid").agg(F.to_json(F.map_from_entries(pairs)).alias("regional_offers"))


def statements(raw: DataFrame, col: str = "payload") -> DataFrame:
    """Knowledge-base bindings as rows: appid, day, precision, rank, award, won, units.

    An id or rank is what follows the last slash or hash of its address.
    """
    b = raw.select(F.explode(F.from_json(F.col(col), BINDINGS)["results"]["bindings"]).alias("b"))
    value = lambda f: F.col(f"b.{f}.value")
    when = F.coalesce(value("date"), value("when"))
    rank = F.lower(F.regexp_replace(F.substring_index(value("rank"), "#", -1), "Rank$", ""))
    rows = b.select(
        value("appid").try_cast("bigint").alias("appid"), F.substring_index(value("item"), "/", -1).alias("item"), F.left(when, F.lit(10)).try_cast("date").alias("day"), value("precision").try_cast("int").alias("precision"),
        rank.alias("rank"), value("award").alias("award"), (F.lower(value("won")) == "true").alias("won"), value("units").try_cast("double").cast("bigint").alias("units"),
    )
    return rows.filter("appid is not null")


def price_history(raw: DataFrame, col: str = "payload") -> DataFrame:
    """(appid, price_cents, day): one row per entry, null where it cannot be read.

    A payload is a list of entries, or an object with one under history, data or prices.
    """
    v = raw.select("appid", F.try_parse_json(col).alias("v"))
    get = lambda c, path, kind="string": F.try_variant_get(c, path, kind)
    lists = F.coalesce(get(F.col("v"), "$", "array<variant>"), *(get(F.col("v"), f"$.{k}", "array<variant>") for k in ("history", "data", "prices")))
    e = v.select("appid", F.explode(lists).alias("e")).select("appid", "e")

    def money(*paths: str) -> Column:
        return F.coalesce(*(to_cents(get(F.col("e"), f"{p}{s}")) for p in paths for s in ("", ".amount", ".amountInt")))

    regular = money(*(f"{d}.{k}" for d in ("$.deal", "$") for k in ("regular", "regular_price", "price_regular")))
    cut = F.coalesce(get(F.col("e"), "$.deal.cut", "double"), get(F.col("e"), "$.cut", "double"), F.lit(0.0))
    plain = F.when(cut == 0, money(*(f"{d}.{k}" for d in ("$.deal", "$") for k in ("price", "price_new", "amount"))))
    day = F.coalesce(*(F.left(get(F.col("e"), f"$.{k}"), F.lit(10)).try_cast("date") for k in ("timestamp", "time", "date", "recorded")))
    return e.select("appid", F.coalesce(regular, plain).alias("price_cents"), day.alias("day"))


def drafts(raw: DataFrame, col: str = "payload") -> DataFrame:
    """(key, draft, error). ``raw``: key, payload, stop_reason. A draft that is not whole, or whose
    values are not in the enumerations, is an error and never a value."""
    d = F.from_json(F.col(col), DRAFT)
    rows = raw.withColumn("_d", d)
    needed = F.array(*(F.col(f"_d.{f.name}").isNull() for f in DRAFT))
    error = (
        F.when(F.col("stop_reason") != "end_turn", F.concat(F.lit("stopped: "), F.col("stop_reason")))
        .when(F.try_parse_json(col).isNull() | F.col("_d").isNull(), "not JSON")
        .when(F.exists(needed, lambda x: x), "a field is missing")
        .when(~F.col("_d.studio_signal").isin(*STUDIO) | ~F.col("_d.support_signal").isin(*SUPPORT) | ~F.col("_d.confidence").isin("high", "medium", "low"), "a value is not allowed")
    )
    return rows.select("key", F.when(error.isNull(), F.col("_d")).alias("draft"), error.alias("error"))
