"""How launched titles score: windows, cohorts, the rubric and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchgrid.functions import rubric
from launchgrid.functions.text import dollars
from launchgrid.operators import cohort, queues, validation, windows
from launchgrid.plans.registry import query
from launchgrid.schemas import DAY_ONE, STUDIO, SUPPORT
from launchgrid.sources import logical
from launchgrid.sources.logical import BASE


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with their launch summary (inner: titles whose first window was observed or not)."""
    t = logical.titles(spark, sf_dir)
    totals = windows.window_totals(t, windows.daily(logical.reviews(spark, sf_dir)), logical.WINDOWS)
    return t.join(windows.launch_summary(totals), "appid")


def ranked(rows: DataFrame) -> DataFrame:
    """``summaries`` with cohort_size and percentile; the reference is day-one titles only."""
    reference = rows.filter(F.col("launch_type") == DAY_ONE).select("cohort_year", F.col("first_total").alias("value"))
    probes = rows.filter("first_total is not null").select("appid", "cohort_year", F.col("first_total").alias("value"))
    found = cohort.percentiles(reference, probes).select("appid", "cohort_size", "percentile")
    return rows.join(found, "appid", "left")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-one titles with an observed first window, and what the rubric says of them."""
    rows = ranked(summaries(spark, sf_dir)).filter((F.col("launch_type") == DAY_ONE) & F.col("first_total").isNotNull())
    verdict = rubric.classify(F.col("percentile"), F.col("positive_pct"), F.col("retention"), F.col("studio"), F.col("support"), F.col("cohort_size") >= 8)
    return rows.withColumn("r", verdict).select("appid", "store_date", "cohort_year", "percentile", "positive_pct", "retention", "studio", "support", F.col("outcome").alias("expected"), F.col("r.outcome").alias("predicted"), F.col("r.confidence").alias("confidence"), F.col("r.met").alias("met"), F.col("r.unresolved").alias("unresolved"), F.col("r.reasons").alias("reasons"))


SCORED = f"""{BASE}, wide AS (
  SELECT t.*, s.first_total, s.positive_pct, s.retention, p.percentile, p.cohort_size
  FROM titles t JOIN summary s USING (appid) JOIN percentiles p USING (appid) WHERE launch_type = 'day_one_steam'
), gated AS (
  SELECT *, CASE WHEN coalesce(retention >= 2.5 AND percentile >= 85, false) THEN true WHEN positive_pct < 78 THEN false WHEN percentile < 35 THEN false ELSE true END AS met FROM wide
), scored AS (
  SELECT *, CASE WHEN percentile IS NULL THEN NULL
      WHEN met THEN CASE WHEN percentile >= 90 OR (percentile >= 80 AND retention >= 2.0) THEN 'breakout' ELSE 'success' END
      WHEN studio = 'unknown' AND support = 'unknown' THEN NULL WHEN studio = 'closed' OR support = 'abandoned' THEN 'flop'
      WHEN studio = 'severe_layoffs' AND support <> 'sustained' THEN 'flop' ELSE 'underperform' END AS predicted,
    outcome AS expected FROM gated
), final AS (
  SELECT *, CASE WHEN percentile IS NULL THEN 'none' WHEN met THEN CASE WHEN support IN ('unknown', 'abandoned') THEN 'low' WHEN predicted = 'breakout' THEN 'high' ELSE 'medium' END
      WHEN predicted IS NULL THEN 'none' WHEN studio = 'closed' OR support = 'abandoned' THEN 'high' WHEN studio = 'severe_layoffs' THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN percentile IS NULL AND cohort_size < 8 THEN 'cohort_too_small' WHEN percentile IS NULL THEN 'no_volume' WHEN NOT met AND studio = 'unknown' AND support = 'unknown' THEN 'shortfall_without_signals' END AS unresolved
  FROM scored
)"""


@query(f"{SCORED} SELECT appid, percentile, positive_pct, retention, predicted, confidence, CASE WHEN percentile IS NOT NULL THEN met END AS met, unresolved FROM final")
def rubric_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship."""
    return scored(spark, sf_dir).select("appid", "percentile", "positive_pct", "retention", "predicted", "confidence", "met", "unresolved")


def _ordinal(x: str) -> str:
    n = f"round_even({x}, 0)::INTEGER"
    return f"({n} || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"


def _whole(x: str) -> str:
    return f"round_even({x}, 0)::INTEGER::VARCHAR"


def _tenth(x: str) -> str:
    return f"printf('%.1f', round_even({x}, 1))"


PCT = _ordinal("percentile")
GATE = f"""CASE WHEN coalesce(retention >= 2.5 AND percentile >= 85, false) THEN 'grew to ' || {_tenth("retention")} || 'x its first window from the ' || {PCT} || ' percentile'
  WHEN positive_pct IS NULL THEN 'no sentiment in the launch window'
  WHEN positive_pct < 78 THEN CASE WHEN round_even(positive_pct, 0) = 78 THEN {_tenth("positive_pct")} ELSE {_whole("positive_pct")} END || '% positive, under the 78% bar'
  WHEN percentile < 35 THEN {_whole("positive_pct")} || '% positive, but ' || CASE WHEN round_even(percentile, 0) = 35 THEN {_tenth("percentile")} || 'th' ELSE {PCT} END || ' percentile volume is under the floor of 35'
  ELSE {_whole("positive_pct")} || '% positive at the ' || {PCT} || ' percentile' END"""
ABOVE = f"""CASE WHEN percentile >= 90 THEN {PCT} || ' percentile volume, top of its cohort' WHEN percentile >= 80 AND retention >= 2.0 THEN {PCT} || ' percentile volume that kept growing to ' || {_tenth("retention")} || 'x'
  ELSE 'met its cohort''s bar without breakout volume' END"""
BELOW = """CASE WHEN studio = 'unknown' AND support = 'unknown' THEN NULL WHEN studio = 'closed' THEN 'the studio closed' WHEN support = 'abandoned' THEN 'support was abandoned'
  WHEN studio = 'severe_layoffs' AND support <> 'sustained' THEN 'severe layoffs and support cut short' WHEN studio = 'severe_layoffs' THEN 'severe layoffs, support as planned' ELSE 'studio ' || studio || ', support ' || support END"""
TOLD = f"CASE WHEN percentile IS NULL THEN '' ELSE concat_ws('; ', {GATE}, CASE WHEN met THEN {ABOVE} ELSE {BELOW} END) END"


@query(f"{SCORED} SELECT appid, predicted, {TOLD} AS reasons FROM final")
def rubric_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates that decided, as text."""
    return scored(spark, sf_dir).select("appid", "predicted", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""{BASE} SELECT appid, k AS window_key, n::BIGINT AS review_total, p::BIGINT AS review_positive, (n - p)::BIGINT AS review_negative FROM (
  SELECT appid, 'launch_2w' AS k, n1 AS n, p1 AS p FROM win UNION ALL SELECT appid, 'launch_1m', n2, p2 FROM win UNION ALL SELECT appid, 'launch_3m', n3, p3 FROM win UNION ALL SELECT appid, 'lifetime', n4, p4 FROM win)""")
def window_review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, J3."""
    return windows.window_totals(logical.titles(spark, sf_dir), windows.daily(logical.reviews(spark, sf_dir)), logical.WINDOWS)


@query(f"""{BASE}, w AS (SELECT t.appid, {', '.join(f"sum(CASE WHEN day - store_date BETWEEN 0 AND {d - 1} THEN n ELSE 0 END)::BIGINT AS n{d}, sum(CASE WHEN day - store_date BETWEEN 0 AND {d - 1} THEN positive ELSE 0 END)::BIGINT AS p{d}" for d in (14, 30, 90))}
  FROM titles t LEFT JOIN days d ON d.appid = t.appid GROUP BY t.appid)
SELECT appid, nullif(n14, 0) AS first_total, nullif(n30, 0) AS second_total, nullif(n90, 0) AS third_total, CASE WHEN n14 > 0 THEN round_even(100.0::DOUBLE * p14 / n14, 1) END AS positive_pct, CASE WHEN n14 > 0 AND n90 > 0 THEN n90::DOUBLE / n14::DOUBLE END AS retention FROM w""")
def store_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, M1, M2 with a store's own windows, of 14, 30 and 90 days."""
    totals = windows.window_totals(logical.titles(spark, sf_dir), windows.daily(logical.reviews(spark, sf_dir)))
    second = totals.filter("window_key = 'launch_1m'").select("appid", F.nullif("review_total", F.lit(0)).alias("second_total"))
    return windows.launch_summary(totals).join(second, "appid").select("appid", "first_total", "second_total", "third_total", "positive_pct", "retention")


@query(f"""{BASE} SELECT k AS window_key, count(*)::BIGINT AS n, sum(v)::BIGINT AS reviews FROM (
  SELECT 'launch_2w' AS k, n1 AS v FROM win JOIN titles USING (appid) WHERE store_date + 365 <= DATE '2001-06-30' UNION ALL SELECT 'launch_1m', n2 FROM win JOIN titles USING (appid) WHERE store_date + 730 <= DATE '2001-06-30'
  UNION ALL SELECT 'launch_3m', n3 FROM win JOIN titles USING (appid) WHERE store_date + 1095 <= DATE '2001-06-30' UNION ALL SELECT 'lifetime', n4 FROM win) GROUP BY k""")
def elapsed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST7 in batch: only windows that have elapsed by a date."""
    w = windows.window_totals(logical.titles(spark, sf_dir), windows.daily(logical.reviews(spark, sf_dir)), logical.WINDOWS, as_of=F.lit("2001-06-30").cast("date"))
    return w.groupBy("window_key").agg(F.count("*").alias("n"), F.sum("review_total").alias("reviews"))


@query(f"""{BASE}, near AS (
  SELECT t.appid, t.store_date - d.day AS b, n FROM titles t JOIN days d USING (appid) WHERE t.store_date - d.day BETWEEN 1 AND 90
), probe AS (
  SELECT appid, sum(CASE WHEN b > 15 THEN n ELSE 0 END)::BIGINT AS e, sum(CASE WHEN b BETWEEN 2 AND 14 THEN n ELSE 0 END)::BIGINT AS h, max(CASE WHEN b <= 14 AND n > 0 THEN b END)::INTEGER AS far FROM near GROUP BY appid
), m AS (
  SELECT t.appid, store_date, coalesce(e, 0)::BIGINT AS e, coalesce(h, 0)::BIGINT AS h, CASE WHEN coalesce(e, 0) < 50 AND coalesce(h, 0) >= 50 THEN coalesce(far, 0) ELSE 0 END::INTEGER AS moved FROM titles t LEFT JOIN probe USING (appid)
) SELECT appid, store_date AS recorded, (store_date - moved)::DATE AS detected, e AS early_total, h AS head_total, moved AS days_earlier,
  CASE WHEN e >= 50 THEN 'sold_before' WHEN h < 50 THEN 'no_head_start' WHEN moved > 7 THEN 'needs_review' WHEN moved > 0 THEN 'shifted' ELSE 'no_head_start' END AS verdict FROM m""")
def launch_start_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, J4."""
    return windows.launch_start(logical.titles(spark, sf_dir), windows.daily(logical.reviews(spark, sf_dir)))


@query(f"{BASE} SELECT appid, first_total::BIGINT AS first_total, third_total::BIGINT AS third_total, positive_pct, retention FROM summary")
def positive_share_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, J2."""
    return summaries(spark, sf_dir).select("appid", "first_total", "third_total", "positive_pct", "retention")


@query(f"{BASE} SELECT appid, cohort_year, value::BIGINT AS value, cohort_size, percentile FROM percentiles")
def cohort_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of every launch type against day-one cohorts."""
    rows = summaries(spark, sf_dir).filter("first_total is not null")
    reference = rows.filter(F.col("launch_type") == DAY_ONE).select("cohort_year", F.col("first_total").alias("value"))
    return cohort.percentiles(reference, rows.select("appid", "cohort_year", F.col("first_total").alias("value")))


@query(f"""{BASE}, expanded AS (SELECT cohort_year, unnest(list_transform(range(n), lambda i: value)) AS value FROM pooled)
SELECT cohort_year, count(*)::BIGINT AS size, count(*) >= 8 AS reliable, floor((quantile_disc(value, 0.5) + list_sort(list(value))[(count(*) // 2 + 1)::BIGINT]) / 2)::BIGINT AS median FROM expanded GROUP BY cohort_year""")
def cohort_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    rows = summaries(spark, sf_dir).filter(F.col("launch_type") == DAY_ONE)
    return cohort.statistics(rows.select("cohort_year", F.col("first_total").alias("value")))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = logical.titles(spark, sf_dir).filter(F.col("launch_type") == DAY_ONE)
    return cohort.going_rates(t.select("cohort_year", F.col("launch_price_cents").alias("value")))


@query(f"{BASE} SELECT cohort_year, n_prices, rate FROM rates")
def going_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, F4."""
    return rates(spark, sf_dir)


@query(f"{BASE} SELECT appid, CASE WHEN launch_price_cents > 0 AND rate > 0 THEN round_even(launch_price_cents / rate::DOUBLE, 3) END AS relative FROM titles LEFT JOIN rates USING (cohort_year)")
def relative_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3."""
    from launchgrid.functions.measures import relative_price as ratio

    t = logical.titles(spark, sf_dir).join(F.broadcast(rates(spark, sf_dir)), "cohort_year", "left")
    return t.select("appid", ratio(F.col("launch_price_cents"), F.col("rate")).alias("relative"))


@query(f"""{BASE}, seq AS (SELECT cohort_year, rate, CASE WHEN rate IS DISTINCT FROM lag(rate) OVER (ORDER BY cohort_year) THEN 1 ELSE 0 END AS new FROM rates WHERE rate IS NOT NULL),
run AS (SELECT *, sum(new) OVER (ORDER BY cohort_year) AS run FROM seq)
SELECT rate, min(cohort_year) AS from_year, max(cohort_year) AS to_year, '$' || (rate // 100)::VARCHAR AS price FROM run GROUP BY run, rate""")
def rate_change_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, T8."""
    return cohort.rate_runs(rates(spark, sf_dir)).withColumn("price", dollars(F.col("rate")))


RANK = "list_position(['flop', 'underperform', 'success', 'breakout'], {})"


@query(f"""{SCORED}, r AS (SELECT {RANK.format('expected')} AS e, {RANK.format('predicted')} AS p, expected, predicted FROM final)
SELECT count(expected)::BIGINT AS scored, count(CASE WHEN e > 0 AND p > 0 THEN 1 END)::BIGINT AS resolved, count(CASE WHEN e > 0 AND predicted IS NULL THEN 1 END)::BIGINT AS unresolved,
  round_even(100.0::DOUBLE * count(CASE WHEN e > 0 AND p > 0 AND e = p THEN 1 END) / count(CASE WHEN e > 0 AND p > 0 THEN 1 END), 1) AS exact_pct,
  round_even(100.0::DOUBLE * count(CASE WHEN e > 0 AND p > 0 AND (e >= 3) = (p >= 3) THEN 1 END) / count(CASE WHEN e > 0 AND p > 0 THEN 1 END), 1) AS met_pct,
  round_even(sum(CASE WHEN e > 0 AND p > 0 THEN abs(e - p) END)::DOUBLE / count(CASE WHEN e > 0 AND p > 0 THEN 1 END), 2) AS mean_distance FROM r""")
def rubric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, M6."""
    return validation.report(scored(spark, sf_dir))


@query(f"""{SCORED} SELECT expected, {', '.join(f"count(CASE WHEN predicted = '{o}' THEN 1 END)::BIGINT AS {o}" for o in ('flop', 'underperform', 'success', 'breakout'))}
FROM final WHERE expected IS NOT NULL AND predicted IS NOT NULL GROUP BY expected""")
def rubric_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return validation.confusion(scored(spark, sf_dir))


@query(f"""{SCORED} SELECT appid, store_date, expected, predicted, abs({RANK.format('expected')} - {RANK.format('predicted')})::INTEGER AS distance FROM final
WHERE expected IS NOT NULL AND predicted IS NOT NULL AND expected <> predicted""")
def rubric_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2."""
    return validation.disagreements(scored(spark, sf_dir))


@query(f"""WITH s AS (SELECT unnest({list(STUDIO)}) AS studio), p AS (SELECT unnest({list(SUPPORT)}) AS support), o AS (SELECT count(*) AS n FROM orders)
SELECT studio, support, CASE WHEN studio = 'unknown' AND support = 'unknown' THEN 'unresolved' WHEN studio = 'closed' OR support = 'abandoned' THEN 'flop'
  WHEN studio = 'severe_layoffs' AND support <> 'sustained' THEN 'flop' ELSE 'underperform' END AS tier, coalesce(t.titles, 0)::BIGINT AS titles
FROM s CROSS JOIN p LEFT JOIN (SELECT studio, support, count(*) AS titles FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'closed' WHEN o_orderstatus = 'F' THEN 'continued' WHEN o_orderstatus = 'O' THEN 'severe_layoffs' ELSE 'unknown' END AS studio,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'sustained' WHEN 'AUTOMOBILE' THEN 'curtailed' WHEN 'MACHINERY' THEN 'abandoned' ELSE 'unknown' END AS support FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY ALL) t USING (studio, support)""")
def tier_from_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pair of signals alone implies, and how many titles have it."""
    every = spark.createDataFrame([(a, b) for a in STUDIO for b in SUPPORT], "studio string, support string")
    have = logical.titles(spark, sf_dir).groupBy("studio", "support").agg(F.count("*").alias("titles"))
    return every.join(have, ["studio", "support"], "left").select("studio", "support", rubric.tier_from_signals(F.col("studio"), F.col("support")).alias("tier"), F.coalesce("titles", F.lit(0)).alias("titles"))


def basis() -> F.Column:
    """Why a title has the outcome that it has."""
    alone = rubric.classify(F.col("percentile"), F.col("positive_pct"), F.col("retention"), F.lit("unknown"), F.lit("unknown"), F.lit(True))["outcome"]
    return F.when(F.col("outcome").isNotNull(), "confirmed").when(F.col("launch_type") != DAY_ONE, "port").when(F.col("percentile").isNull(), "no_data").when(alone.isNotNull(), "auto").otherwise("needs_research")


@query(f"""{BASE}, w AS (SELECT t.*, s.positive_pct, s.retention, p.percentile FROM titles t JOIN summary s USING (appid) LEFT JOIN percentiles p USING (appid))
SELECT appid, CASE WHEN outcome IS NOT NULL THEN 'confirmed' WHEN launch_type <> 'day_one_steam' THEN 'port' WHEN percentile IS NULL THEN 'no_data'
  WHEN coalesce(retention >= 2.5 AND percentile >= 85, false) OR (positive_pct >= 78 AND percentile >= 35) THEN 'auto' ELSE 'needs_research' END AS basis FROM w""")
def corpus_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8."""
    return ranked(summaries(spark, sf_dir)).select("appid", basis().alias("basis"))


@query(f"""{SCORED} SELECT CASE WHEN percentile IS NULL THEN 'not_ranked' ELSE 'fell_short' END AS reason, count(*)::BIGINT AS titles, min(store_date) AS first_date, max(store_date) AS last_date
FROM final WHERE expected IS NULL AND predicted IS NULL GROUP BY ALL""")
def research_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled titles that the rubric leaves open, by reason."""
    rows = scored(spark, sf_dir).filter("expected is null and predicted is null")
    return rows.groupBy(F.when(F.col("percentile").isNull(), "not_ranked").otherwise("fell_short").alias("reason")).agg(F.count("*").alias("titles"), F.min("store_date").alias("first_date"), F.max("store_date").alias("last_date"))


QUEUED = f"{SCORED} SELECT appid, store_date, unresolved AS reason, {TOLD} AS detail FROM final WHERE expected IS NULL AND predicted IS NULL AND first_total IS NOT NULL"


@query(QUEUED)
def research_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue itself, by date, with the reason and the numbers behind it."""
    return queues.research(scored(spark, sf_dir))


@query(f"{QUEUED} ORDER BY store_date, appid LIMIT {queues.SELECTED}")
def research_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first titles of the queue, as a run without arguments takes them."""
    return queues.selected(queues.research(scored(spark, sf_dir)))


@query(f"""{SCORED}, b AS (SELECT *, CASE WHEN positive_pct < 50 THEN '<50' WHEN positive_pct < 60 THEN '50-59' WHEN positive_pct < 70 THEN '60-69' WHEN positive_pct < 78 THEN '70-77' ELSE '78+' END AS band FROM final)
SELECT band, count(*)::BIGINT AS titles, count(predicted)::BIGINT AS resolved FROM b GROUP BY band""")
def coverage_by_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28."""
    p = F.col("positive_pct")
    band = F.when(p < 50, "<50").when(p < 60, "50-59").when(p < 70, "60-69").when(p < 78, "70-77").otherwise("78+")
    return scored(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("titles"), F.count("predicted").alias("resolved"))


@query(f"""{BASE} SELECT studio, support, {', '.join(f"count(CASE WHEN outcome = '{o}' THEN 1 END)::BIGINT AS {o}" for o in ('flop', 'underperform', 'success', 'breakout'))}
FROM titles WHERE outcome IS NOT NULL GROUP BY ALL""")
def signal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27, F2."""
    t = logical.titles(spark, sf_dir).filter("outcome is not null")
    return t.groupBy("studio", "support").pivot("outcome", ["flop", "underperform", "success", "breakout"]).count().na.fill(0)


@query(f"""{BASE}, d AS (SELECT * FROM titles WHERE launch_type = 'day_one_steam'), b AS (SELECT appid, cohort_year, 0 AS none, launch_price_cents // 2000 AS band, developer FROM d)
SELECT 'none' AS axis, sum(n)::BIGINT AS titles, sum(CASE WHEN n >= 8 THEN n ELSE 0 END)::BIGINT AS rankable FROM (SELECT count(*) AS n FROM b GROUP BY cohort_year)
UNION ALL SELECT 'price_band', sum(n)::BIGINT, sum(CASE WHEN n >= 8 THEN n ELSE 0 END)::BIGINT FROM (SELECT count(*) AS n FROM b GROUP BY cohort_year, band)
UNION ALL SELECT 'developer', sum(n)::BIGINT, sum(CASE WHEN n >= 8 THEN n ELSE 0 END)::BIGINT FROM (SELECT count(*) AS n FROM b GROUP BY cohort_year, developer)""")
def segment_rankability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    t = logical.titles(spark, sf_dir).filter(F.col("launch_type") == DAY_ONE).withColumn("price_band", F.floor(F.col("launch_price_cents") / 2000))
    return cohort.segment_rankability(t, ["price_band", "developer"])


@query(f"{BASE} SELECT month(store_date)::INTEGER AS month, count(*)::BIGINT AS titles, count(outcome)::BIGINT AS labelled FROM titles GROUP BY ALL")
def release_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31."""
    return logical.titles(spark, sf_dir).groupBy(F.month("store_date").alias("month")).agg(F.count("*").alias("titles"), F.count("outcome").alias("labelled"))
