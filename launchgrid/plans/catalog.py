"""Launch types, add-ons, prices, knowledge-base statements, curated tables and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchgrid.functions import measures
from launchgrid.functions.dates import is_coarse, loose_date, research_anchor
from launchgrid.functions.text import out_of_scope
from launchgrid.operators import catalog, quality, queues, validation
from launchgrid.plans.registry import query
from launchgrid.schemas import CURATED_COLUMNS, OUT_OF_SCOPE_GENRES
from launchgrid.sources import curated, landed, logical
from launchgrid.sources.logical import TITLES

T = f"WITH {TITLES.strip()}"
GAP = "(store_date - original_date)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a flag for every seventeenth, as the mark of an early access period."""
    return logical.titles(spark, sf_dir).withColumn("early_access", F.col("appid") % 17 == 0)


@query(f"{T} SELECT launch_type, year(store_date)::INTEGER AS year, count(*)::BIGINT AS titles, min({GAP})::INTEGER AS least_gap, max({GAP})::INTEGER AS most_gap FROM titles GROUP BY ALL")
def platform_type_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3."""
    gap = F.date_diff("store_date", "original_date")
    return titles(spark, sf_dir).groupBy("launch_type", F.year("store_date").alias("year")).agg(F.count("*").alias("titles"), F.min(gap).alias("least_gap"), F.max(gap).alias("most_gap"))


VERDICT = f"CASE WHEN abs{GAP} <= 1 THEN 'day_one_steam' WHEN appid % 17 = 0 THEN 'early_access' WHEN {GAP} > 0 AND {GAP} <= 30 THEN 'near_day_one' WHEN {GAP} < 0 THEN 'steam_first' ELSE 'not_day_one' END"


@query(f"{T} SELECT appid, {VERDICT} AS verdict, CASE WHEN abs{GAP} <= 1 THEN 'day_one_steam' ELSE '' END AS proposed, {GAP}::INTEGER AS gap_days FROM titles")
def platform_type_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, F6."""
    return validation.proposals(titles(spark, sf_dir))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived type as the stored one, but for some that are stale, unset or curated."""
    k = F.col("appid")
    stored = F.when(k % 19 == 0, F.lit(None).cast("string")).when(k % 23 == 0, "former_exclusive").otherwise(F.col("launch_type"))
    return titles(spark, sf_dir).select("appid", stored.alias("stored"), F.when(k % 6 == 0, F.col("launch_type")).alias("curated"), "original_date", "store_date", "early_access")


AUDIT = f"""{T}, a AS (SELECT *, CASE WHEN appid % 19 = 0 THEN NULL WHEN appid % 23 = 0 THEN 'former_exclusive' ELSE launch_type END AS stored, CASE WHEN appid % 6 = 0 THEN launch_type END AS curated, {VERDICT} AS verdict, {GAP}::INTEGER AS gap_days FROM titles),
audit AS (SELECT appid, gap_days, verdict, CASE WHEN verdict = 'steam_first' THEN 'conflict' WHEN curated IS NOT NULL AND stored IS DISTINCT FROM curated THEN 'conflict' WHEN stored IS NULL OR stored = 'unknown' THEN 'unset'
  WHEN verdict = 'early_access' THEN CASE WHEN stored = 'day_one_steam' THEN 'ok' ELSE 'conflict' END
  WHEN NOT (stored = launch_type OR (stored = 'former_exclusive' AND launch_type = 'delayed_port')) THEN 'conflict' WHEN curated IS NOT NULL THEN 'ok' ELSE 'derived' END AS agreement FROM a)"""


@query(f"{AUDIT} SELECT appid, agreement, gap_days FROM audit")
def platform_type_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    return validation.audit(audited(spark, sf_dir))


@query(f"{AUDIT} SELECT agreement, count(*)::BIGINT AS titles, max(abs(gap_days))::INTEGER AS furthest FROM audit GROUP BY agreement")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, O3."""
    return validation.audit(audited(spark, sf_dir)).groupBy("agreement").agg(F.count("*").alias("titles"), F.max(F.abs("gap_days")).alias("furthest"))


@query(f"""{T}, d AS (SELECT appid, store_date, CASE WHEN appid % 3 = 0 THEN appid * 10 END AS demo, CASE WHEN appid % 3 = 0 AND appid % 5 <> 0 THEN store_date + ((appid % 21) - 10)::INTEGER END AS demo_date FROM titles)
SELECT appid, demo::BIGINT AS demo, CASE WHEN demo IS NULL THEN 'none_listed' WHEN demo_date IS NULL THEN 'unknown' WHEN demo_date - store_date < -3 THEN 'pre_launch' WHEN demo_date - store_date > 3 THEN 'post_launch' ELSE 'launch_window' END AS timing FROM d""")
def demo_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third title lists two demos; some of the first ones are undated."""
    t, k = titles(spark, sf_dir), F.col("appid")
    listed = t.select("appid", "store_date", F.when(k % 3 == 0, F.array(k * 10, k * 10 + 1)).otherwise(F.array().cast("array<bigint>")).alias("demo_ids"))
    dates = t.filter((k % 3 == 0) & (k % 5 != 0)).select((k * 10).alias("demo"), F.date_add("store_date", ((k % 21) - 10).cast("int")).alias("demo_date"))
    return catalog.demo_timings(listed, dates)


@query(f"""{T}, parts AS (SELECT l_orderkey AS appid, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1) AS pos, l_shipdate::DATE AS day FROM lineitem),
c AS (SELECT appid, count(*)::BIGINT AS n FROM parts GROUP BY appid), g AS (SELECT p.appid, day - store_date AS gap FROM parts p JOIN titles t ON t.appid = p.appid WHERE pos < 12),
s AS (SELECT appid, count(CASE WHEN abs(gap) <= 3 THEN 1 END)::BIGINT AS launch_day, count(CASE WHEN gap > 3 THEN 1 END)::BIGINT AS post_launch, max(CASE WHEN gap > 3 THEN gap END)::INTEGER AS last_days FROM g GROUP BY appid)
SELECT t.appid, coalesce(n, 0)::BIGINT AS dlc_count, coalesce(launch_day, 0)::BIGINT AS launch_day, coalesce(post_launch, 0)::BIGINT AS post_launch, last_days FROM titles t LEFT JOIN c USING (appid) LEFT JOIN s USING (appid)""")
def dlc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a title's add-ons."""
    from pyspark.sql import Window

    i = logical.read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    listed = i.select(F.col("l_orderkey").alias("appid"), (F.row_number().over(order) - 1).alias("pos"), F.to_date("l_shipdate").alias("addon_date"))
    listed = listed.withColumn("addon", F.concat_ws("/", "appid", "pos"))
    return catalog.addon_summary(titles(spark, sf_dir), listed.select("appid", "pos", "addon"), listed.select("addon", "addon_date"))


def two_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Titles as curated rows, and the stored rows: some gone, some with another value."""
    k = F.col("appid")
    rows = titles(spark, sf_dir).select("appid", F.col("studio").alias("studio_signal"), F.col("support").alias("support_signal"), F.col("outcome").alias("resolved_outcome"), F.lit("high").alias("label_confidence"), F.lit("researched").alias("research_status"), F.col("launch_type").alias("platform_launch_type"))
    stored = rows.filter(k % 31 != 0).withColumns({"studio_signal": F.when(k % 29 == 0, "grew").otherwise(F.col("studio_signal")), "resolved_outcome": F.when(k % 37 == 0, F.lit(None).cast("string")).otherwise(F.col("resolved_outcome"))})
    return rows, stored


@query(f"""{T}, r AS (SELECT * FROM titles WHERE outcome IS NOT NULL)
SELECT appid, 'missing_row' AS field, NULL::VARCHAR AS curated, NULL::VARCHAR AS stored FROM r WHERE appid % 31 = 0
UNION ALL SELECT appid, 'studio_signal', studio, 'grew' FROM r WHERE appid % 31 <> 0 AND appid % 29 = 0 AND studio <> 'grew'
UNION ALL SELECT appid, 'resolved_outcome', outcome, NULL FROM r WHERE appid % 31 <> 0 AND appid % 37 = 0""")
def curated_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    return validation.drift(*two_tables(spark, sf_dir))


def curated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as a curated file's text rows, some of them wrong; a line number each."""
    k = F.col("appid")
    t = titles(spark, sf_dir)
    cells = {
        "steam_appid": F.when(k % 101 == 0, "12x").when(k % 103 == 0, F.lit(None).cast("string")).when(k % 97 == 1, (k - 1).cast("string")).otherwise(k.cast("string")),
        "game_name": F.col("game_name"), "original_release_date": F.when(k % 107 == 0, "2020-13-01").otherwise(F.col("original_date").cast("string")),
        "platform_launch_type": F.when(k % 109 == 0, "someday").otherwise(F.col("launch_type")), "budget_tier": F.col("budget_tier"), "launch_price_usd": F.when(k % 113 == 0, "free").otherwise("59.99"),
        "studio_signal": F.col("studio"), "support_signal": F.col("support"), "resolved_outcome": F.col("outcome"), "label_confidence": F.lit("high"),
        "research_status": F.when(F.col("outcome").isNull(), F.when(k % 50 == 0, "researched").otherwise("not_researched")).when(k % 51 == 0, "not_researched").otherwise("researched"),
    }
    return t.select((k + 2).alias("line"), *(cells.get(c, F.lit(None).cast("string")).alias(c) for c in CURATED_COLUMNS))


@query(f"""{T}, c AS (SELECT appid, appid + 2 AS line, CASE WHEN appid % 101 = 0 THEN '12x' WHEN appid % 103 = 0 THEN NULL WHEN appid % 97 = 1 THEN (appid - 1)::VARCHAR ELSE appid::VARCHAR END AS k, outcome FROM titles),
d AS (SELECT k, min(line) AS first FROM c WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)
SELECT rule, count(*)::BIGINT AS n, min(line)::BIGINT AS first_line FROM (
  SELECT 'bad_integer' AS rule, line FROM c WHERE k = '12x' UNION ALL SELECT 'required', line FROM c WHERE k IS NULL UNION ALL SELECT 'bad_date', line FROM c WHERE appid % 107 = 0
  UNION ALL SELECT 'unknown_value', line FROM c WHERE appid % 109 = 0 UNION ALL SELECT 'bad_price', line FROM c WHERE appid % 113 = 0
  UNION ALL SELECT 'label_without_research', line FROM c WHERE outcome IS NOT NULL AND appid % 51 = 0 UNION ALL SELECT 'research_without_label', line FROM c WHERE outcome IS NULL AND appid % 50 = 0
  UNION ALL SELECT 'duplicate', line FROM c JOIN d USING (k) WHERE line > first) GROUP BY rule""")
def curated_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q5, S1."""
    return quality.violations(curated_text(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query(f"""{T}, w AS (SELECT appid, store_date, original_date, appid % 4 * 5 AS dlc, appid % 9 = 0 AS renamed FROM titles)
SELECT warning, count(*)::BIGINT AS n FROM (SELECT 'name_mismatch' AS warning FROM w WHERE renamed UNION ALL SELECT 'many_addons' FROM w WHERE dlc > 12
  UNION ALL SELECT CASE WHEN store_date > DATE '2001-01-01' THEN 'future_date' ELSE 'window_not_elapsed' END FROM w WHERE store_date + 90 > DATE '2001-01-01' UNION ALL SELECT 'store_before_original' FROM w WHERE store_date < original_date) GROUP BY warning""")
def curated_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, Q7, T4."""
    k = F.col("appid")
    t = titles(spark, sf_dir).withColumn("store_name", F.when(k % 9 == 0, "Another name").otherwise(F.upper(F.concat("game_name", F.lit("!"))))).withColumn("dlc_count", k % 4 * 5)
    return quality.warnings(t, F.lit("2001-01-01").cast("date")).groupBy("warning").agg(F.count("*").alias("n"))


@query(f"{T} SELECT appid, store_date FROM titles WHERE launch_type = 'unknown' AND appid % 3 <> 0")
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of unknown launch type, in order of date, without those answered."""
    t = titles(spark, sf_dir)
    queue = t.filter(F.col("launch_type") == "unknown").select("appid", "store_date")
    return quality.pending(queue, t.filter(F.col("appid") % 3 == 0)).orderBy("store_date", "appid")


@query(f"{T} SELECT appid, store_date FROM titles WHERE appid % 12 = 0")
def missing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles without a launch price, by date; every twelfth has none."""
    t = titles(spark, sf_dir).withColumn("launch_price_cents", F.when(F.col("appid") % 12 != 0, F.col("launch_price_cents")))
    return queues.missing_prices(t).select("appid", "store_date")


@query(f"{T} SELECT appid, store_date, studio, support FROM titles WHERE studio <> 'unknown' AND support <> 'unknown'")
def answered_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles whose two signals are both known, by date."""
    return queues.answered(titles(spark, sf_dir)).select("appid", "store_date", "studio", "support")


@query(f"""{T}, d AS (SELECT appid, CASE WHEN appid % 16 <> 0 THEN store_date END AS store_date, launch_type FROM titles)
SELECT false AS include_ports, count(*)::BIGINT AS titles, sum(appid)::BIGINT AS sum_appid FROM d WHERE store_date IS NOT NULL AND launch_type IN ('day_one_steam', 'unknown')
UNION ALL SELECT true, count(*)::BIGINT, sum(appid)::BIGINT FROM d WHERE store_date IS NOT NULL""")
def probe_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: whose launches a probe looks at, with and without ports; every sixteenth title is undated."""
    t = titles(spark, sf_dir).withColumn("store_date", F.when(F.col("appid") % 16 != 0, F.col("store_date")))
    totals = lambda ports: queues.probe_scope(t, ports).agg(F.count("*").alias("titles"), F.sum("appid").alias("sum_appid")).select(F.lit(ports).alias("include_ports"), "titles", "sum_appid")
    return totals(False).unionByName(totals(True))


@query("SELECT l_orderkey AS appid, bool_or(o_orderkey IS NOT NULL) AS present FROM (SELECT l_orderkey + l_suppkey AS l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def requested_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    asked = logical.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_suppkey")).alias("appid"))
    return quality.selection(asked, titles(spark, sf_dir))


def price_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price histories, in the shapes that a price service answers."""
    i = logical.read(spark, sf_dir, "lineitem")
    day, dollars = F.date_format("l_shipdate", "yyyy-MM-dd"), F.floor(F.col("l_extendedprice") / 1000)
    nested = F.format_string('{"timestamp":"%sT00:00:00Z","deal":{"price":{"amount":1.0},"regular":{"amount":%d.99},"cut":50}}', day, dollars)
    flat = F.format_string('{"date":"%s","regular":%d.99,"price":%d.99,"cut":0}', day, dollars, dollars)
    broken = F.format_string('{"date":"%s","label":"%d"}', day, dollars)
    entry = F.when(F.col("l_linenumber") % 5 == 4, broken).when(F.col("l_linenumber") % 2 == 0, nested).otherwise(flat)
    many = i.groupBy(F.col("l_orderkey").alias("appid")).agg(F.array_join(F.collect_list(entry), ",").alias("e"))
    return many.select("appid", F.when(F.col("appid") % 2 == 0, F.concat(F.lit("["), "e", F.lit("]"))).otherwise(F.concat(F.lit('{"history":['), "e", F.lit("]}"))).alias("payload"))


@query(f"""{T}, h AS (SELECT l_orderkey AS appid, l_shipdate::DATE AS day, CASE WHEN l_linenumber % 5 <> 4 THEN (floor(l_extendedprice / 1000) * 100 + 99)::INTEGER END AS cents FROM lineitem),
o AS (SELECT appid, arg_min(cents, (day, cents)) FILTER (WHERE cents IS NOT NULL) AS price_cents, min(day) FILTER (WHERE cents IS NOT NULL) AS observed_on, count(cents)::BIGINT AS parsed, count(*)::BIGINT AS total, max(day) FILTER (WHERE cents IS NOT NULL) AS newest FROM h GROUP BY appid)
SELECT o.*, (observed_on - store_date)::INTEGER AS days_after, (total > 1 AND parsed < total) AS suspect,
  coalesce(NOT (total > 1 AND parsed < total) AND observed_on - store_date BETWEEN -30 AND 60, false) AS is_launch_price,
  CASE WHEN total > 1 AND parsed < total THEN 'suspect' WHEN observed_on IS NULL THEN 'no_release_date' WHEN observed_on - store_date BETWEEN -30 AND -1 THEN 'pre_order' WHEN observed_on - store_date BETWEEN 0 AND 60 THEN 'launch' WHEN observed_on - store_date < 0 THEN 'too_early' ELSE 'too_late' END AS verdict
FROM o JOIN titles t ON t.appid = o.appid""")
def price_history_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, A13, D10, M4."""
    first = catalog.oldest_prices(landed.price_history(price_payloads(spark, sf_dir))).join(titles(spark, sf_dir).select("appid", "store_date"), "appid")
    days = F.date_diff("observed_on", "store_date")
    v = first.withColumn("days_after", days).withColumn("v", catalog.price_verdict(F.col("parsed"), F.col("total"), F.col("days_after")))
    return v.select("appid", "price_cents", "observed_on", "parsed", "total", "newest", "days_after", "v.suspect", "v.is_launch_price", "v.verdict")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dated statements of a knowledge base, read from its answers."""
    i = logical.read(spark, sf_dir, "lineitem")
    value = lambda c: F.struct(c.cast("string").alias("value"))
    rank = F.when(F.col("l_linenumber") % 4 == 0, "PreferredRank").when(F.col("l_linenumber") % 7 == 3, "DeprecatedRank").otherwise("NormalRank")
    binding = F.struct(value(F.col("l_orderkey")).alias("appid"), value(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("date"), value(F.when(F.col("l_linenumber") % 3 == 0, 9).otherwise(11)).alias("precision"), value(F.concat(F.lit("http://wiki/ontology#"), rank)).alias("rank"))
    answers = i.groupBy("l_suppkey").agg(F.to_json(F.struct(F.struct(F.collect_list(binding).alias("bindings")).alias("results"))).alias("payload"))
    return landed.statements(answers).select("appid", "day", "precision", "rank")


@query(f"""{T}, s AS (SELECT l_orderkey AS appid, l_shipdate::DATE AS day, l_linenumber % 4 = 0 AS preferred FROM lineitem WHERE l_linenumber % 3 <> 0 AND NOT (l_linenumber % 7 = 3 AND l_linenumber % 4 <> 0)),
o AS (SELECT appid, coalesce(min(CASE WHEN preferred THEN day END), min(day)) AS found_date FROM s GROUP BY appid)
SELECT t.appid, CASE WHEN found_date IS NULL THEN 'no_match' WHEN store_date - found_date < -7 THEN 'suspect' WHEN store_date - found_date <= 7 THEN 'day_one' ELSE 'port' END AS verdict, original_date, found_date,
  found_date IS NOT NULL AND store_date - found_date >= -7 AND found_date <> original_date AS changes FROM titles t LEFT JOIN o USING (appid)""")
def original_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements' least date against each title's."""
    return catalog.date_updates(titles(spark, sf_dir), catalog.original_dates(statements(spark, sf_dir)))


def nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = logical.read(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("appid"), F.to_date("l_shipdate").alias("when"), F.when(F.col("l_partkey") % 2 == 0, 11).otherwise(9).alias("precision"), (F.col("l_returnflag") == "A").alias("won"), F.concat(F.lit("show "), (F.col("l_suppkey") % 7).cast("string")).alias("award_show"))


NOMINATED = f"""{T}, n AS (SELECT l_orderkey AS appid, l_shipdate::DATE AS d, l_partkey % 2 = 0 AS exact, l_returnflag = 'A' AS won, 'show ' || (l_suppkey % 7) AS award_show FROM lineitem),
early AS (SELECT n.*, t.original_date FROM n JOIN titles t USING (appid) WHERE CASE WHEN exact THEN d < original_date ELSE year(d) < year(original_date) END)"""


@query(f"""{NOMINATED}, c AS (SELECT appid, count(*) AS k, count(CASE WHEN won THEN 1 END) AS w FROM early GROUP BY appid)
SELECT t.appid, CASE WHEN t.appid % 8 <> 0 THEN coalesce(k, 0) END::BIGINT AS nominations, CASE WHEN t.appid % 8 <> 0 THEN coalesce(w, 0) END::BIGINT AS wins FROM titles t LEFT JOIN c USING (appid)""")
def nominations_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null where never looked up, nought where looked up and there are none."""
    t = titles(spark, sf_dir)
    return catalog.nominations_before(t, t.filter(F.col("appid") % 8 != 0), nominations(spark, sf_dir))


@query(f"{NOMINATED} SELECT award_show, count(*)::BIGINT AS nominations, count(CASE WHEN won THEN 1 END)::BIGINT AS wins FROM n GROUP BY award_show")
def nominations_by_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return nominations(spark, sf_dir).groupBy("award_show").agg(F.count("*").alias("nominations"), F.count_if("won").alias("wins")).orderBy(F.desc("nominations"), "award_show")


def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dated sales figures, coarse dates dropped; every item is stated twice."""
    i = logical.read(spark, sf_dir, "lineitem")
    one = i.select(F.col("l_orderkey").alias("appid"), F.when(F.col("l_linenumber") % 3 != 0, F.to_date("l_shipdate")).alias("as_of"), (F.col("l_quantity") * 1000).cast("bigint").alias("units"))
    return one.unionByName(one)


@query(f"""{T}, m AS (SELECT DISTINCT l_orderkey AS appid, CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate::DATE END AS as_of, (l_quantity * 1000)::BIGINT AS units FROM lineitem),
f AS (SELECT t.appid, store_date, count(units)::BIGINT AS figures, min((as_of, units)) FILTER (WHERE as_of >= store_date) AS first FROM titles t LEFT JOIN m USING (appid) GROUP BY ALL)
SELECT appid, figures, first[1]::DATE AS as_of, first[2]::BIGINT AS units, (first[1] - store_date)::INTEGER AS gap_days, coalesce(first[1] - store_date <= 120, false) AS in_window FROM f""")
def sales_first_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, D9, O4, U2."""
    return catalog.first_milestones(titles(spark, sf_dir), milestones(spark, sf_dir))


@query(f"""{T}, m AS (SELECT DISTINCT l_orderkey AS appid, CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate::DATE END AS as_of, (l_quantity * 1000)::BIGINT AS units FROM lineitem),
f AS (SELECT t.appid, count(units) AS figures, min(as_of - store_date) FILTER (WHERE as_of >= store_date) AS gap FROM titles t LEFT JOIN m USING (appid) GROUP BY t.appid)
SELECT count(*)::BIGINT AS looked_up, count(CASE WHEN figures > 0 THEN 1 END)::BIGINT AS any_figure, count(gap)::BIGINT AS after_launch, count(CASE WHEN gap <= 120 THEN 1 END)::BIGINT AS in_window FROM f""")
def sales_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    m = sales_first_after(spark, sf_dir)
    return m.agg(F.count("*").alias("looked_up"), F.count_if(F.col("figures") > 0).alias("any_figure"), F.count("as_of").alias("after_launch"), F.count_if("in_window").alias("in_window"))


def two_opinions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signals of documents from their language and source, and from their labels."""
    d, l = logical.read(spark, sf_dir, "documents"), logical.read(spark, sf_dir, "labels")
    studio = F.when(F.col("lang") == "en", "continued").when(F.col("lang") == "de", "closed").when(F.col("lang") == "fr", "unknown").otherwise("grew")
    drafts = d.select(F.col("doc_id").alias("key"), studio.alias("studio"), F.when(F.col("doc_id") % 3 == 0, "sustained").when(F.col("doc_id") % 3 == 1, "curtailed").otherwise("unknown").alias("support"), F.when(F.col("doc_id") % 10 == 0, "perhaps not").otherwise(" ").alias("alternative"))
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    curated_rows = l.select(F.col("doc_id").alias("key"), F.when(q & t, "severe_layoffs").when(q, "continued").when(t, "closed").otherwise("unknown").alias("studio"), F.when(q, "sustained").otherwise("abandoned").alias("support"))
    return drafts, curated_rows


DRAFTS = """WITH d AS (SELECT doc_id AS key, CASE lang WHEN 'en' THEN 'continued' WHEN 'de' THEN 'closed' WHEN 'fr' THEN 'unknown' ELSE 'grew' END AS ds, CASE doc_id % 3 WHEN 0 THEN 'sustained' WHEN 1 THEN 'curtailed' ELSE 'unknown' END AS dp, doc_id % 10 = 0 AS alt FROM documents),
c AS (SELECT doc_id AS key, CASE WHEN quality = 1 AND toxic = 1 THEN 'severe_layoffs' WHEN quality = 1 THEN 'continued' WHEN toxic = 1 THEN 'closed' ELSE 'unknown' END AS cs, CASE WHEN quality = 1 THEN 'sustained' ELSE 'abandoned' END AS cp FROM labels),
b AS (SELECT key, ds, dp, cs, cp, alt, CASE WHEN cs IS NULL THEN 'draft_only' WHEN ds IS NULL THEN 'curated_only' ELSE 'compared' END AS status FROM d FULL OUTER JOIN c USING (key)),
v AS (SELECT *, CASE WHEN ds = cs THEN 'agrees' WHEN ds = 'unknown' THEN 'refused' WHEN cs IN ('closed', 'severe_layoffs') AND ds IN ('grew', 'continued') THEN 'false_benign' WHEN cs IN ('grew', 'continued') AND ds IN ('closed', 'severe_layoffs') THEN 'false_alarm' ELSE 'differs' END AS verdict,
  CASE WHEN ds = 'unknown' AND dp = 'unknown' THEN 'unresolved' WHEN ds = 'closed' OR dp = 'abandoned' THEN 'flop' WHEN ds = 'severe_layoffs' AND dp <> 'sustained' THEN 'flop' ELSE 'underperform' END AS dt,
  CASE WHEN cs = 'unknown' AND cp = 'unknown' THEN 'unresolved' WHEN cs = 'closed' OR cp = 'abandoned' THEN 'flop' WHEN cs = 'severe_layoffs' AND cp <> 'sustained' THEN 'flop' ELSE 'underperform' END AS ct FROM b)"""


@query(f"{DRAFTS} SELECT key, status, CASE WHEN status = 'compared' THEN verdict END AS verdict, CASE WHEN status = 'compared' THEN CASE WHEN dt = ct THEN 'agrees' WHEN ct = 'flop' THEN 'softer' ELSE 'harsher' END END AS tier_direction FROM v")
def draft_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, A14."""
    return validation.compare_drafts(*two_opinions(spark, sf_dir)).select("key", "status", "verdict", "tier_direction")


@query(f"""{DRAFTS} SELECT count(*)::BIGINT AS compared, count(CASE WHEN ds = cs THEN 1 END)::BIGINT AS studio_agrees, count(CASE WHEN dp = cp THEN 1 END)::BIGINT AS support_agrees, count(CASE WHEN ds = cs AND dp = cp THEN 1 END)::BIGINT AS both_agree,
  {', '.join(f"count(CASE WHEN verdict = '{k}' THEN 1 END)::BIGINT AS {k}" for k in ('false_benign', 'false_alarm', 'refused', 'differs'))},
  count(CASE WHEN dt = ct THEN 1 END)::BIGINT AS tier_agrees, count(CASE WHEN dt <> ct AND ct = 'flop' THEN 1 END)::BIGINT AS tier_softer, count(CASE WHEN dt <> ct AND ct <> 'flop' THEN 1 END)::BIGINT AS tier_harsher, count(CASE WHEN alt THEN 1 END)::BIGINT AS flagged_alternative FROM v WHERE status = 'compared'""")
def draft_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return validation.tally(validation.compare_drafts(*two_opinions(spark, sf_dir)))


@query(f"""{DRAFTS} SELECT key, concat_ws(' ', CASE WHEN ds = 'closed' THEN 'CLOSED-verify' END, CASE WHEN (ds <> 'unknown' OR dp <> 'unknown') AND key % 4 = 0 THEN 'no-sources' END, CASE WHEN key % 6 = 0 THEN 'low-confidence' END, CASE WHEN alt THEN 'alternative' END) AS flags FROM b WHERE ds IS NOT NULL""")
def draft_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5."""
    d, _ = two_opinions(spark, sf_dir)
    none = F.array().cast("array<string>")
    flags = measures.review_flags(F.col("studio"), F.col("support"), F.when(F.col("key") % 4 == 0, none).otherwise(F.array(F.lit("x"))), F.when(F.col("key") % 6 == 0, "low").otherwise("high"), F.col("alternative"))
    return d.select("key", flags.alias("flags"))


@query("""WITH u AS (SELECT role, sum(length(text))::BIGINT AS i, sum(turn)::BIGINT AS o, count(*)::BIGINT AS s, (conv_id % 2 = 0) AS batched FROM conversations GROUP BY ALL)
SELECT role, batched, i AS input_tokens, o AS output_tokens, s AS searches, round(CASE WHEN batched THEN 0.5 ELSE 1.0 END * ((i * 5.0 + o * 25.0) / 1000000) + s * 0.01::DOUBLE, 6)::DOUBLE AS cost FROM u""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as model calls."""
    c = logical.read(spark, sf_dir, "conversations").withColumn("batched", F.col("conv_id") % 2 == 0)
    u = c.groupBy("role", "batched").agg(F.sum(F.char_length("text")).alias("input_tokens"), F.sum("turn").alias("output_tokens"), F.count("*").alias("searches"))
    zero = F.lit(0)
    cost = measures.cost({"input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"), "cache_read_tokens": zero, "cache_write_tokens": zero}, F.col("searches"), F.col("batched"))
    return u.withColumn("cost", F.round(cost, 6))


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles' dates as stores write them, in eight ways."""
    k, d = F.col("appid"), F.col("store_date")
    quarter = F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))
    forms = [F.date_format(d, f) for f in ("MMM d, yyyy", "d MMM, yyyy", "MMMM d, yyyy", "MMM yyyy", "yyyy")] + [quarter, F.lit("Coming soon"), F.concat(F.lit("  "), F.date_format(d, "MMM d, yyyy"))]
    raw = forms[-1]
    for i in range(len(forms) - 2, -1, -1):
        raw = F.when(k % 8 == i, forms[i]).otherwise(raw)
    return titles(spark, sf_dir).select("appid", raw.alias("raw"))


@query(f"""{T} SELECT appid, (CASE WHEN appid % 8 IN (0, 1, 2, 7) THEN store_date WHEN appid % 8 = 3 THEN date_trunc('month', store_date) WHEN appid % 8 = 4 THEN date_trunc('year', store_date) WHEN appid % 8 = 5 THEN date_trunc('quarter', store_date) END)::DATE AS parsed, appid % 8 IN (3, 4, 5, 6) AS coarse FROM titles""")
def loose_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2."""
    return written_dates(spark, sf_dir).select("appid", loose_date(F.col("raw")).alias("parsed"), is_coarse(F.col("raw")).alias("coarse"))


@query(f"{T} SELECT appid, original_date AS anchor, abs{GAP} > 30 AS two_dates, (original_date + INTERVAL 16 MONTH)::DATE AS window_end, coalesce(genres LIKE '%Massively Multiplayer%', false) AS out_of_scope FROM titles")
def research_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, F3."""
    a = research_anchor(F.col("original_date"), F.col("store_date"))
    return titles(spark, sf_dir).withColumn("a", a).select("appid", "a.*", out_of_scope(F.col("genres"), OUT_OF_SCOPE_GENRES).alias("out_of_scope"))


@query(f"""{T} SELECT appid, 'row ' || CASE WHEN appid % 4 = 0 THEN 'new' ELSE 'old' END AS note FROM titles WHERE appid % 2 = 0 OR appid % 4 = 0""")
def proposal_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review file after a run that refreshed half of it."""
    t = titles(spark, sf_dir)
    prior = t.filter(F.col("appid") % 2 == 0).select(F.col("appid"), F.lit("row old").alias("note"))
    return curated.merged_proposals(prior, t.filter(F.col("appid") % 4 == 0).select("appid", F.lit("row new").alias("note")))


@query(f"""{T} SELECT appid AS steam_appid, CASE WHEN appid % 3 = 0 THEN store_date ELSE original_date END AS original_release_date, CASE WHEN appid % 3 <> 0 THEN CASE WHEN appid % 2 = 0 THEN 'press' END WHEN appid % 2 = 0 THEN 'press / knowledge-base' ELSE 'knowledge-base' END AS sources FROM titles""")
def curated_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13."""
    t = titles(spark, sf_dir)
    rows = t.select(F.col("appid").alias("steam_appid"), F.col("original_date").alias("original_release_date"), F.when(F.col("appid") % 2 == 0, "press").alias("sources"))
    return curated.with_dates(rows, t.filter(F.col("appid") % 3 == 0).select(F.col("appid").alias("steam_appid"), F.col("store_date").alias("found_date")))
