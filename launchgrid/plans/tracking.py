"""Tracked titles over time: changes, latest rows, rollups, landed JSON, and the stream twins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchgrid.functions.dates import is_stale
from launchgrid.functions.measures import loose_int, next_lifecycle, status_badge
from launchgrid.operators import snapshots
from launchgrid.plans.registry import query
from launchgrid.schemas import Windows
from launchgrid.sources import curated, landed, logical
from launchgrid.sources.logical import POLLS, REVIEWS, TITLES
from launchgrid.sources.shared import new_folder
from launchgrid.streaming import polls as streams
from launchgrid.streaming import upserts

P = f"WITH {POLLS.strip()}"
DAY = "CASE {} WHEN 'Nov 12, 2026' THEN DATE '2026-11-12' WHEN 'Mar 4, 2027' THEN DATE '2027-03-04' WHEN 'Q4 2026' THEN DATE '2026-10-01' END"
CHANGES = f"""{P}, s AS (SELECT appid, captured_at, raw, lag(raw) OVER w AS before FROM polls WINDOW w AS (PARTITION BY appid ORDER BY captured_at)),
c AS (SELECT appid, captured_at AS observed_at, before AS previous_raw, raw AS new_raw, {DAY.format('before')} AS previous_date, {DAY.format('raw')} AS new_date, before IN ('Q4 2026', 'Coming soon') AS coarse FROM s WHERE before IS NOT NULL AND raw IS DISTINCT FROM before),
changes AS (SELECT *, (new_date - previous_date)::INTEGER AS days_moved, coalesce(NOT coarse AND new_date - previous_date > 0, false) AS is_delay FROM c)"""


@query(f"{CHANGES} SELECT appid, observed_at, previous_raw, new_raw, previous_date, new_date, days_moved, coarse, is_delay FROM changes")
def date_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, D6."""
    return snapshots.date_changes(logical.polls(spark, sf_dir))


@query(f"{CHANGES} SELECT appid, count(*)::BIGINT AS changes, count(CASE WHEN is_delay THEN 1 END)::BIGINT AS delay_count, sum(CASE WHEN is_delay THEN days_moved ELSE 0 END)::BIGINT AS total_days_delayed FROM changes GROUP BY appid")
def delay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return snapshots.delay_totals(snapshots.date_changes(logical.polls(spark, sf_dir)))


@query(f"{P} SELECT appid, max(captured_at) AS captured_at, arg_max(players, captured_at) AS players, arg_max(kind, captured_at) AS kind FROM polls GROUP BY appid")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return snapshots.latest(logical.polls(spark, sf_dir).select("appid", "captured_at", "players", "kind"))


@query(f"{P} SELECT * FROM (SELECT appid, captured_at, players, (row_number() OVER (PARTITION BY appid ORDER BY captured_at DESC))::INTEGER AS place FROM polls) WHERE place <= 20")
def recent_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty of each title, as the reader asks."""
    return snapshots.recent(logical.polls(spark, sf_dir).select("appid", "captured_at", "players"), 20)


@query(f"{P} SELECT appid, captured_at::DATE AS day, count(*)::BIGINT AS polls, max(players) AS peak_players, sum(players)::BIGINT AS sum_players, arg_max(players, captured_at) AS last_players FROM polls GROUP BY ALL")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 as a batch job: every day."""
    return snapshots.daily_rollup(logical.polls(spark, sf_dir))


@query(f"{P} SELECT appid, captured_at::DATE AS day, count(*)::BIGINT AS polls, max(players) AS peak_players, sum(players)::BIGINT AS sum_players, arg_max(players, captured_at) AS last_players FROM polls WHERE DATE '2024-02-15' - captured_at::DATE > 30 GROUP BY ALL")
def closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series kept by day, its days of over 30 days ago rolled up, each in a file of its own."""
    series, rollup = new_folder(spark, "series"), new_folder(spark, "rollup")
    snapshots.append_days(logical.polls(spark, sf_dir), series)
    snapshots.roll_up(spark, series, rollup, datetime.date(2024, 2, 15))
    return spark.read.parquet(rollup)


@query(f"{P}, s AS (SELECT appid, captured_at, players, players - lag(players) OVER (PARTITION BY appid ORDER BY captured_at) AS change FROM polls) SELECT * FROM s WHERE change <= -1500")
def sudden_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls of 1500 players or more from one poll to the next."""
    return snapshots.sudden_drops(logical.polls(spark, sf_dir).select("appid", "captured_at", "players"), 1500, "players")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls with whether the title was still to come, and a forecast at some of them."""
    p = logical.polls(spark, sf_dir)
    return p.select("appid", "captured_at", "poll_id", (F.col("kind") != "purchase").alias("coming_soon"), F.when(F.col("poll_id") % 20 == 0, F.concat(F.lit("tier "), (F.col("poll_id") % 3).cast("string"))).alias("predicted"))


@query(f"""{P} SELECT kind, c.state AS current, CASE WHEN c.state IS NULL THEN CASE WHEN kind <> 'purchase' THEN 'pre_launch' ELSE 'tracking' END WHEN c.state = 'pre_launch' AND kind = 'purchase' THEN 'tracking' ELSE c.state END AS next, count(*)::BIGINT AS n
FROM polls JOIN (VALUES (0, NULL), (1, 'pre_launch'), (2, 'tracking'), (3, 'resolved')) c(k, state) ON c.k = poll_id % 4 GROUP BY ALL""")
def lifecycle_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3."""
    k = F.col("poll_id") % 4
    now = F.when(k == 1, "pre_launch").when(k == 2, "tracking").when(k == 3, "resolved")
    p = logical.polls(spark, sf_dir).select("kind", now.alias("current"))
    return p.groupBy("kind", "current", next_lifecycle(F.col("current"), F.col("kind") != "purchase").alias("next")).agg(F.count("*").alias("n"))


@query(f"""{P}, l AS (SELECT appid, arg_max(poll_id, captured_at) AS poll_id, arg_max(kind, captured_at) AS kind FROM polls GROUP BY appid),
g AS (SELECT appid, 'Title ' || appid AS name, CASE WHEN appid % 3 <> 0 THEN DATE '2026-01-01' + (appid % 40)::INTEGER END AS release_date,
  CASE kind WHEN 'view' THEN 'pre_launch' WHEN 'click' THEN 'tracking' WHEN 'purchase' THEN 'failed_to_meet_expectations' WHEN 'error' THEN 'unresolved_insufficient_data' ELSE 'resolved' END AS state, CASE WHEN appid % 2 = 0 THEN 'success' END AS outcome FROM l)
SELECT appid, name, release_date, CASE state WHEN 'pre_launch' THEN 'forecast' WHEN 'tracking' THEN 'tracking' WHEN 'failed_to_meet_expectations' THEN 'provisional' WHEN 'unresolved_insufficient_data' THEN 'unresolved' ELSE 'resolved' END AS kind,
  state IN ('failed_to_meet_expectations', 'unresolved_insufficient_data') AS provisional, CASE WHEN state = 'pre_launch' THEN CASE WHEN outcome IS NULL THEN 'Awaiting forecast' ELSE 'Forecast: Success' END WHEN state = 'tracking' THEN 'Tracking' WHEN state = 'resolved' THEN CASE WHEN outcome IS NULL THEN 'Resolved' ELSE 'Success' END ELSE 'Failed to Meet Expectations' END AS label FROM g""")
def tracked_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated titles last, then by date and name."""
    l = snapshots.latest(logical.polls(spark, sf_dir).select("appid", "captured_at", "kind"))
    k = F.col("appid")
    state = F.when(F.col("kind") == "view", "pre_launch").when(F.col("kind") == "click", "tracking").when(F.col("kind") == "purchase", "failed_to_meet_expectations").when(F.col("kind") == "error", "unresolved_insufficient_data").otherwise("resolved")
    outcome = F.when(k % 2 == 0, "success")
    g = l.select("appid", F.concat(F.lit("Title "), k.cast("string")).alias("name"), F.when(k % 3 != 0, F.date_add(F.lit("2026-01-01").cast("date"), (k % 40).cast("int"))).alias("release_date"), status_badge(state, outcome, outcome).alias("badge"))
    return g.orderBy(F.col("release_date").asc_nulls_last(), "name").select("appid", "name", "release_date", "badge.*")


@query("""SELECT user_id % 3 AS shard, event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(*)::BIGINT AS n, count(CASE WHEN ts < TIMESTAMP '2024-01-17 00:00:00' THEN 1 END)::BIGINT AS stale FROM events GROUP BY ALL""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely typed numbers in JSON, and rows older than a fortnight."""
    e = logical.read(spark, sf_dir, "events")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return e.groupBy((F.col("user_id") % 3).alias("shard"), "event_type").agg(F.sum(loose_int(F.get_json_object("props", "$.k"))).alias("total"), F.count("*").alias("n"), F.count_if(is_stale(F.col("ts"), now)).alias("stale"))


def app_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as store answers; some requests failed."""
    p = logical.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    good = F.format_string(
        '{"%d":{"success":true,"data":{"type":"game","name":"%s","steam_appid":%d,"is_free":false,"developers":["%s"],"publishers":["%s","Other"],"price_overview":{"currency":"USD","initial":%d,"final":%d,"discount_percent":10},'
        '"platforms":{"windows":true,"mac":%s,"linux":false},"genres":[{"id":"1","description":"Action"}],"categories":[{"id":"35","description":"In-App Purchases"}],"dlc":[%d,7],"demos":[{"appid":"%d"}],"release_date":{"coming_soon":%s,"date":"%s"}}}}',
        k, F.col("p_name"), k, F.col("p_brand"), F.col("p_type"), F.floor(F.col("p_retailprice")).cast("bigint"), F.floor(F.col("p_retailprice")).cast("bigint") - 1,
        (k % 2 == 0).cast("string"), k + 1, k + 2, (k % 3 == 0).cast("string"), F.when(k % 3 == 0, "Q4 2026").otherwise("Oct 26, 2018"),
    )
    return p.select(F.when(k % 10 == 9, F.format_string('{"%d":{"success":false}}', k)).otherwise(good).alias("payload"))


@query("""SELECT p_partkey AS appid, p_name AS name, p_brand AS developers, p_type || chr(10) || 'Other' AS publishers, floor(p_retailprice)::INTEGER AS price_initial_cents, p_partkey % 2 = 0 AS on_mac, p_partkey % 3 = 0 AS coming_soon,
  CASE WHEN p_partkey % 3 = 0 THEN DATE '2026-10-01' ELSE DATE '2018-10-26' END AS release_date, p_partkey + 1 AS first_dlc, p_partkey + 2 AS first_demo, true AS has_in_app_purchases FROM part WHERE p_partkey % 10 <> 9""")
def app_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    d = landed.app_details(app_payloads(spark, sf_dir))
    return d.select("appid", "name", "developers", "publishers", "price_initial_cents", "on_mac", "coming_soon", "release_date", F.element_at("dlc_ids", 1).alias("first_dlc"), F.element_at("demo_ids", 1).alias("first_demo"), "has_in_app_purchases")


@query("""SELECT p_partkey AS appid, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT * 10 END AS review_total, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END AS review_positive, CASE WHEN p_partkey % 4 <> 0 THEN p_size::BIGINT * 3 END AS concurrent_players FROM part""")
def review_and_player_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, S4."""
    p = logical.read(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_size")
    rev = F.format_string('{"success":%d,"query_summary":{"total_reviews":%d,"total_positive":%d,"total_negative":%d,"review_score_desc":"Mixed"}}', F.when(k % 5 == 0, 0).otherwise(1), n * 10, n, n * 9)
    cur = F.format_string('{"response":{"player_count":%d,"result":%d}}', n * 3, F.when(k % 4 == 0, 42).otherwise(1))
    r = landed.review_summary(p.select(k.alias("appid"), rev.alias("payload")))
    c = landed.current_players(p.select(k.alias("appid"), cur.alias("payload")))
    return r.join(c, "appid").select("appid", "review_total", "review_positive", "concurrent_players")


@query("""WITH o AS (SELECT p_partkey AS appid, n_name AS country, n_nationkey % 5 <> 0 AS available, floor(p_retailprice)::INTEGER + n_nationkey AS cents FROM part JOIN nation ON n_nationkey < 6 WHERE (p_partkey + n_nationkey) % 11 <> 0)
SELECT appid, '{' || string_agg('"' || country || '":{"available":' || available || CASE WHEN available THEN ',"currency":"USD","price_cents":' || cents ELSE '' END || '}', ',' ORDER BY country) || '}' AS regional_offers FROM o GROUP BY appid""")
def regional_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed request has no market, a closed one only says so."""
    p = logical.read(spark, sf_dir, "part")
    n = logical.read(spark, sf_dir, "nation").filter("n_nationkey < 6").withColumn("one", F.lit(1))
    both = p.withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    cents = F.floor("p_retailprice") + F.col("n_nationkey")
    payload = F.format_string('{"%d":{"success":%s,"data":{"price_overview":{"currency":"USD","initial":%d}}}}', F.col("p_partkey"), (F.col("n_nationkey") % 5 != 0).cast("string"), cents)
    raw = both.select(F.col("p_partkey").alias("appid"), F.col("n_name").alias("country"), ((F.col("p_partkey") + F.col("n_nationkey")) % 11 != 0).alias("fetched"), payload.alias("payload"))
    return landed.offers_json(landed.regional_offers(raw))


@query("""SELECT error, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 13 = 0 THEN 'stopped: max_tokens' WHEN doc_id % 7 = 0 THEN 'not JSON' WHEN doc_id % 5 = 0 THEN 'a field is missing' WHEN doc_id % 3 = 0 THEN 'a value is not allowed' END AS error FROM documents) GROUP BY error""")
def draft_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that are not whole are errors."""
    k = F.col("doc_id")
    whole = F.format_string('{"studio_signal":"%s","support_signal":"sustained","studio_evidence":"e","support_evidence":"e","sources":["s"],"confidence":"high","alternative_reading":"","reviewer_note":"%s"}', F.when(k % 3 == 0, "someday").otherwise("grew"), F.col("lang"))
    payload = F.when(k % 7 == 0, '{"studio_signal": ').when(k % 5 == 0, '{"studio_signal":"grew"}').otherwise(whole)
    d = logical.read(spark, sf_dir, "documents").select(k.alias("key"), payload.alias("payload"), F.when(k % 13 == 0, "max_tokens").otherwise("end_turn").alias("stop_reason"))
    return landed.drafts(d).groupBy("error").agg(F.count("*").alias("n"))


@query(f"""{P}, e AS (SELECT appid, max(captured_at::DATE) AS d FROM polls WHERE kind = 'click' GROUP BY appid), n AS (SELECT appid, CASE WHEN appid % 4 <> 0 THEN DATE '2025-01-01' END AS d, 'new' AS note FROM (SELECT DISTINCT appid FROM polls WHERE appid % 2 = 0 OR appid % 5 = 0))
SELECT coalesce(e.appid, n.appid) AS appid, coalesce(n.d, e.d) AS store_date, CASE WHEN n.appid IS NOT NULL THEN n.note ELSE 'old' END AS note FROM e FULL OUTER JOIN n ON e.appid = n.appid""")
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old; a null date never blanks a stored one."""
    p = logical.polls(spark, sf_dir)
    old = p.filter("kind = 'click'").groupBy("appid").agg(F.max(F.to_date("captured_at")).alias("store_date")).withColumn("note", F.lit("old"))
    new = p.filter((F.col("appid") % 2 == 0) | (F.col("appid") % 5 == 0)).select("appid").distinct().select("appid", F.when(F.col("appid") % 4 != 0, F.lit("2025-01-01").cast("date")).alias("store_date"), F.lit("new").alias("note"))
    return snapshots.upserted(old, new, kept=("store_date",))


@query(f"""{P} SELECT '{{"appid":' || appid || ',"polls":' || count(*) || ',"peak":' || max(players) || '}}' AS json FROM polls GROUP BY appid""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11."""
    return curated.as_json(logical.polls(spark, sf_dir).groupBy("appid").agg(F.count("*").alias("polls"), F.max("players").alias("peak")))


def _stream(spark: SparkSession, sf_dir: str, shaped) -> DataFrame:
    """The events table read as a stream and shaped like ``logical.polls`` rows."""
    plain = logical.read(spark, sf_dir, "events")
    raw = spark.readStream.schema(plain.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return shaped(raw)


def _polls_of(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "view", "Nov 12, 2026").when(kind == "click", "Mar 4, 2027").when(kind == "purchase", "Q4 2026").when(kind == "error", F.lit(None).cast("string")).otherwise("Coming soon")
    return e.select(F.col("user_id").alias("appid"), F.col("ts").alias("captured_at"), F.floor(F.col("value") * 100).cast("bigint").alias("players"), raw.alias("raw"))


@query(f"{CHANGES} SELECT appid, observed_at, previous_raw, new_raw, previous_date, new_date, days_moved, coarse, is_delay FROM changes WHERE epoch_ms(observed_at) < (SELECT epoch_ms(max(captured_at)) - 86400000 FROM polls)")
def stream_date_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: the stream twin of date_change_log, the same rows up to the watermark."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.ROCKSDB)
    try:
        out = new_folder(spark, "changes")
        streams.run_to_table(streams.date_changes(_stream(spark, sf_dir, _polls_of)), f"{out}/rows", f"{out}/state")
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{out}/rows")


@query(f"""{P}, o AS (SELECT appid, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS out, arg_min('tier ' || (poll_id % 3), captured_at) FILTER (WHERE poll_id % 20 = 0) AS predicted FROM polls GROUP BY appid) SELECT appid, CASE WHEN out = 1 THEN 'tracking' ELSE 'pre_launch' END AS state, predicted FROM o""")
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: a forward-only state and a first forecast that never changes."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.ROCKSDB)
    shaped = lambda e: e.select(F.col("user_id").alias("appid"), F.col("ts").alias("captured_at"), (F.col("event_type") != "purchase").alias("coming_soon"), F.when(F.col("event_id") % 20 == 0, F.concat(F.lit("tier "), (F.col("event_id") % 3).cast("string"))).alias("predicted"))
    try:
        out = new_folder(spark, "lifecycle")
        streams.run_to_table(streams.lifecycle(_stream(spark, sf_dir, shaped)), f"{out}/rows", f"{out}/state", "update")
    finally:
        spark.conf.set(key, before)
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    return snapshots.latest(rows.select("appid", "state", "predicted", "epoch"), at="epoch").select("appid", "state", "predicted")


@query(f"{P} SELECT appid, captured_at::DATE AS day, count(*)::BIGINT AS polls, max(players) AS peak_players, sum(players)::BIGINT AS sum_players FROM polls WHERE captured_at::DATE < (SELECT (max(captured_at) - INTERVAL 1 DAY)::DATE FROM polls) GROUP BY ALL")
def stream_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST4: days that the watermark has closed, of polls taken once each."""
    out = new_folder(spark, "rollup")
    stream = _stream(spark, sf_dir, _polls_of)
    stream = stream.withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    days = streams.daily_rollup(streams.distinct_polls(stream), late=None)
    streams.run_to_table(days, f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows")


@query(f"{P} SELECT appid, max(captured_at) AS captured_at, arg_max(players, captured_at) AS players FROM polls GROUP BY appid")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: each title's last row, kept by upserts."""
    out = new_folder(spark, "latest")
    stream = _stream(spark, sf_dir, lambda e: _polls_of(e).select("appid", "captured_at", "players"))
    streams.upsert_latest(stream, f"{out}/rows", f"{out}/state").awaitTermination()
    return upserts.current(spark, f"{out}/rows", stream.schema)


@query(f"""WITH {TITLES.strip()},{REVIEWS}, mark AS (SELECT max(day) - 1 AS day FROM days),
w AS (SELECT t.appid, store_date, {', '.join(f"sum(CASE WHEN day < store_date + {d} THEN n ELSE 0 END)::BIGINT AS n{d}, sum(CASE WHEN day < store_date + {d} THEN positive ELSE 0 END)::BIGINT AS p{d}" for d in (30, 60, 90))}
  FROM titles t LEFT JOIN days d ON d.appid = t.appid AND day >= store_date AND day < store_date + 90 WHERE store_date IS NOT NULL GROUP BY ALL)
SELECT appid, k AS window_key, ends::TIMESTAMP AS window_end, n AS review_total, p AS review_positive FROM (SELECT appid, 'launch_2w' AS k, store_date + 30 AS ends, n30 AS n, p30 AS p FROM w UNION ALL SELECT appid, 'launch_1m', store_date + 60, n60, p60 FROM w UNION ALL SELECT appid, 'launch_3m', store_date + 90, n90, p90 FROM w), mark WHERE ends <= mark.day""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST7: launch windows of 30, 60 and 90 days from a stream of reviews, those of silent titles too, each given when it has elapsed, kept by title and window."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.ROCKSDB)
    try:
        out = new_folder(spark, "windows")
        lines = spark.readStream.schema(logical.read(spark, sf_dir, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
        reviews = lines.select(F.col("l_orderkey").alias("appid"), F.to_date("l_shipdate").cast("timestamp").alias("at"), F.col("l_quantity").cast("bigint").alias("weight"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("bigint")).otherwise(0).alias("positive"))
        starts = logical.titles(spark, sf_dir).select("appid", F.col("store_date").cast("timestamp").alias("start"))
        windows = streams.launch_windows(reviews, starts, Windows(30, 60, 90))
        streams.keep_windows(windows, f"{out}/rows", f"{out}/state").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return upserts.current(spark, f"{out}/rows", windows.schema)
