"""Company histories, forecasts from rules, feature matrices and model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchgrid.functions.measures import outcome_rank, recombined
from launchgrid.functions.text import companies, title_key
from launchgrid.operators import cohort, forecast, histories, matching, tiers, training
from launchgrid.plans.registry import query
from launchgrid.plans.scoring import ranked, rates, summaries
from launchgrid.schemas import DAY_ONE, OUTCOMES
from launchgrid.sources import logical
from launchgrid.sources.logical import BASE
from launchgrid.sources.shared import new_folder, written

WIDE = f"""{BASE}, wide AS (
  SELECT t.*, s.first_total, s.positive_pct, s.retention, p.percentile FROM titles t JOIN summary s USING (appid) LEFT JOIN percentiles p USING (appid)
)"""
RECORD = """
record AS (
  SELECT w.appid, count(h.appid)::BIGINT AS title_count,
    coalesce(round_even(10.0::DOUBLE * sum((h.percentile * 10)::BIGINT) / count(h.percentile), 0) / 100, 50.0) AS mean_volume_pct,
    coalesce(round_even(10.0::DOUBLE * sum((h.positive_pct * 10)::BIGINT) / count(h.positive_pct), 0) / 100, 75.0) AS mean_positive_pct, count(h.appid) > 0 AS known
  FROM wide w LEFT JOIN wide h ON h.developer = w.developer AND h.store_date < w.store_date GROUP BY w.appid
)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with their launch summaries and percentiles, written once: histories read them several times."""
    return written(ranked(summaries(spark, sf_dir)), "wide")


@query("""SELECT o_orderkey AS appid, c_name AS company, 1::BIGINT AS names, regexp_replace(lower('Title ' || o_orderkey), '[^a-z0-9]', '', 'g') AS title_key FROM orders JOIN customer ON c_custkey = o_custkey""")
def company_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifiers, suffixes and porting houses go; one company is left."""
    t = logical.titles(spark, sf_dir).withColumn("c", companies(F.col("publisher")))
    return t.select("appid", F.array_join("c", "|").alias("company"), F.size("c").cast("bigint").alias("names"), title_key(F.col("game_name")).alias("title_key"))


@query(f"{WIDE}, {RECORD.strip()} SELECT appid, title_count, mean_volume_pct, mean_positive_pct, known FROM record")
def publisher_history_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, W2."""
    return histories.publisher_records(wide(spark, sf_dir))


@query(f"""{WIDE} SELECT developer AS company, count(*)::BIGINT AS title_count, round_even(10.0::DOUBLE * sum((percentile * 10)::BIGINT) / count(percentile), 0) / 100 AS mean_volume_pct,
  round_even(10.0::DOUBLE * sum((positive_pct * 10)::BIGINT) / count(positive_pct), 0) / 100 AS mean_positive_pct, round_even(sum(1 + on_mac::INTEGER + on_linux::INTEGER)::DOUBLE / count(*), 2) AS mean_breadth,
  min(cohort_year)::INTEGER AS first_year, max(cohort_year)::INTEGER AS last_year, (max(cohort_year) - min(cohort_year))::INTEGER AS span_years
FROM wide GROUP BY developer HAVING count(*) >= 2 AND count(percentile) > 0 AND count(positive_pct) > 0""")
def publisher_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, M5."""
    rows = wide(spark, sf_dir).withColumn("platforms", F.col("on_windows").cast("int") + F.col("on_mac").cast("int") + F.col("on_linux").cast("int"))
    return histories.publisher_stats(rows)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical.titles(spark, sf_dir).filter((F.col("launch_type") == DAY_ONE) & F.col("outcome").isNotNull())


OVERLAP = f"""{BASE}, labelled AS (SELECT * FROM titles WHERE launch_type = 'day_one_steam' AND outcome IS NOT NULL),
names AS (SELECT DISTINCT appid, trim(unnest(string_split(developer || chr(10) || publisher, chr(10)))) AS name FROM titles),
pairs AS (SELECT DISTINCT a.appid, b.appid AS other FROM names a JOIN names b USING (name) JOIN labelled l ON l.appid = b.appid WHERE a.appid <> b.appid),
overlap AS (SELECT t.appid, count(other)::BIGINT AS history, {', '.join(f"count(CASE WHEN l.outcome = '{o}' THEN 1 END)::BIGINT AS {o}" for o in OUTCOMES)}
  FROM (SELECT appid FROM titles WHERE appid % 25 = 0) t LEFT JOIN pairs USING (appid) LEFT JOIN labelled l ON l.appid = pairs.other GROUP BY t.appid)"""


@query(OVERLAP.replace(" WHERE appid % 25 = 0", "") + " SELECT * FROM overlap")
def company_overlap_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles, with the porting house's name that a seventh of them share."""
    return histories.overlap_records(logical.titles(spark, sf_dir), labelled(spark, sf_dir))


BASE_RATE = """
base AS (
  SELECT count(*)::BIGINT AS n_labelled, {} FROM titles WHERE launch_type = 'day_one_steam' AND outcome IS NOT NULL
)""".format(", ".join(f"round_even((count(CASE WHEN outcome = '{o}' THEN 1 END) + 1.0::DOUBLE) / (count(*) + 4.0::DOUBLE), 4) AS {o}" for o in OUTCOMES))


@query(f"{BASE}, {BASE_RATE.strip()} SELECT * FROM base")
def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return forecast.base_rate(logical.titles(spark, sf_dir))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of every title from the labelled titles of all its developers and publishers."""
    t = logical.titles(spark, sf_dir)
    return forecast.rule_forecast(t, histories.overlap_records(t, labelled(spark, sf_dir)), forecast.base_rate(t))


FORECAST = f"""{OVERLAP.replace(" WHERE appid % 25 = 0", "")}, {BASE_RATE.strip()}, own AS (
  SELECT t.appid, t.on_mac, t.on_linux, t.outcome, t.launch_type, o.history, {', '.join(f"o.{x}" for x in OUTCOMES)} FROM titles t JOIN overlap o USING (appid)
), weighed AS (
  SELECT own.*, CASE WHEN own.history >= 2 THEN least(0.6::DOUBLE, 0.2::DOUBLE * own.history) ELSE 0.0 END AS weight, {', '.join(f"base.{o} AS b_{o}" for o in OUTCOMES)} FROM own, base
), mixed AS (
  SELECT appid, outcome, launch_type, history, weight, NOT on_mac AND NOT on_linux AS windows_only, {', '.join(f"(CASE WHEN weight > 0 THEN (1 - weight) * b_{o} + weight * round_even(({o} + 0.5::DOUBLE) / (flop + underperform + success + breakout + 2.0::DOUBLE), 4) ELSE b_{o} END)"
  + (" * CASE WHEN NOT on_mac AND NOT on_linux THEN 1.05::DOUBLE ELSE 1.0 END" if o in OUTCOMES[:2] else "") + f" AS w_{o}" for o in OUTCOMES)} FROM weighed
), forecasts AS (
  SELECT appid, outcome, launch_type, history, weight, windows_only, {', '.join(f"round_even(w_{o} / (w_flop + w_underperform + w_success + w_breakout), 4) AS p_{o}" for o in OUTCOMES)} FROM mixed
), said AS (
  SELECT *, greatest(p_flop, p_underperform, p_success, p_breakout) AS probability FROM forecasts
), calls AS (
  SELECT *, CASE probability WHEN p_flop THEN 'flop' WHEN p_underperform THEN 'underperform' WHEN p_success THEN 'success' ELSE 'breakout' END AS predicted FROM said
)"""


@query(f"{FORECAST} SELECT appid, history, weight, {', '.join(f'p_{o}' for o in OUTCOMES)}, predicted, probability FROM calls")
def rule_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, X3, O6."""
    return forecasts(spark, sf_dir).drop("windows_only")


@query(f"""{FORECAST}, told AS (SELECT p.appid, list_sort(list(DISTINCT t.game_name))[:3] AS names FROM pairs p JOIN titles t ON t.appid = p.other GROUP BY p.appid),
words AS (SELECT c.*, t.names, 'leans ' || predicted || ' (' || round_even(100 * probability, 0)::INTEGER || '%), ' AS leans, (SELECT n_labelled FROM base) AS n_labelled FROM calls c LEFT JOIN told t USING (appid))
SELECT appid, predicted, 'low' AS confidence, leans || CASE WHEN history >= 2 THEN 'mostly by how ' || history || ' earlier titles of the team came out' ELSE 'from all labelled titles; the team has no track record' END AS rationale,
  concat_ws('; ', 'base rate of ' || n_labelled || ' labelled titles', CASE WHEN history >= 2 THEN history || ' labelled titles of the team (' || array_to_string(names, ', ') || CASE WHEN history > 3 THEN ', …' ELSE '' END || '), weight ' || round_even(100 * weight, 0)::INTEGER || '%'
    WHEN history > 0 THEN 'a single labelled title of the team, too few to count' ELSE 'no labelled title of the team' END, CASE WHEN windows_only THEN 'on Windows only' END) AS basis FROM words""")
def forecast_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forecast rests on, with the first three names of its history."""
    t, l = logical.titles(spark, sf_dir), labelled(spark, sf_dir)
    return forecast.told(forecasts(spark, sf_dir), histories.first_names(t, l), forecast.base_rate(t)).select("appid", "predicted", "confidence", "rationale", "basis")


@query(f"""{FORECAST}, l AS (SELECT * FROM calls WHERE launch_type = 'day_one_steam' AND outcome IS NOT NULL), m AS (SELECT outcome, count(*) AS n FROM l GROUP BY outcome)
SELECT count(*)::BIGINT AS n, round_even(100.0::DOUBLE * count(CASE WHEN outcome = predicted THEN 1 END) / count(*), 1) AS accuracy, round_even(100.0::DOUBLE * (SELECT max(n) FROM m) / count(*), 1) AS majority FROM l""")
def baseline_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title's own label is left out of its history, but not out of the base rate."""
    l = forecasts(spark, sf_dir).join(labelled(spark, sf_dir).select("appid", "outcome"), "appid")
    top = l.groupBy("outcome").agg(F.count("*").alias("k")).agg(F.max("k").alias("k"))
    one = l.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == F.col("predicted")).alias("hits")).crossJoin(F.broadcast(top))
    return one.select("n", F.bround(100.0 * F.col("hits") / F.col("n"), 1).alias("accuracy"), F.bround(100.0 * F.col("k") / F.col("n"), 1).alias("majority"))


@query(f"""{FORECAST}, r AS (SELECT *, list_position(['flop', 'underperform', 'success', 'breakout'], outcome) AS a, list_position(['flop', 'underperform', 'success', 'breakout'], predicted) AS b FROM calls WHERE outcome IS NOT NULL)
SELECT launch_type, count(*)::BIGINT AS n, count(CASE WHEN a = b THEN 1 END)::BIGINT AS hits, sum(abs(a - b))::BIGINT AS distance FROM r GROUP BY launch_type""")
def forecast_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was forecast against what came of it, by launch type."""
    rows = forecasts(spark, sf_dir).join(logical.titles(spark, sf_dir).select("appid", "outcome", "launch_type"), "appid").filter("outcome is not null")
    a, b = outcome_rank(F.col("outcome")), outcome_rank(F.col("predicted"))
    return rows.groupBy("launch_type").agg(F.count("*").alias("n"), F.count_if(a == b).alias("hits"), F.sum(F.abs(a - b)).alias("distance"))


@query(f"""{WIDE}, {RECORD.strip()} SELECT w.appid, mean_volume_pct AS publisher_mean_volume_pct, mean_positive_pct AS publisher_mean_positive_pct, title_count::DOUBLE AS publisher_title_count, known::INTEGER::DOUBLE AS publisher_known,
  coalesce(round_even(launch_price_cents / rate::DOUBLE, 3), 1.0) AS price_vs_going_rate, launch_price_cents / 100.0::DOUBLE AS launch_price_usd, (budget_tier = 'aaa')::INTEGER::DOUBLE AS budget_tier_aaa, (1 + on_mac::INTEGER + on_linux::INTEGER)::DOUBLE AS platform_count,
  (demo_timing = 'pre_launch')::INTEGER::DOUBLE AS has_prelaunch_demo, coalesce(launch_day_dlc_count, 0)::DOUBLE AS launch_day_dlc_count, month(store_date)::DOUBLE AS release_month, w.cohort_year::DOUBLE AS cohort_year, outcome
FROM wide w JOIN record USING (appid) LEFT JOIN rates r ON r.cohort_year = w.cohort_year WHERE launch_type = 'day_one_steam' AND outcome IS NOT NULL AND NOT coalesce(genres LIKE '%Massively Multiplayer%', false)""")
def training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, F1-F4, F10."""
    rows = wide(spark, sf_dir)
    return forecast.training_matrix(rows, histories.publisher_records(rows), rates(spark, sf_dir))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as the publisher of a title that is not out yet."""
    c = logical.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    date = F.when(k % 3 == 0, F.make_date((1996 + k % 8).cast("int"), (1 + k % 12).cast("int"), F.lit(1)))
    return c.select(k.alias("appid"), F.concat("c_name", F.lit(" LLC")).alias("publisher"), date.alias("release_date"), F.when(k % 4 != 0, (1000 * (1 + k % 5)).cast("int")).alias("price_initial_cents"), F.lit(True).alias("on_windows"), (k % 2 == 0).alias("on_mac"), F.lit(False).alias("on_linux"))


@query(f"""{WIDE}, hist AS (SELECT developer, count(*) AS n, round_even(10.0::DOUBLE * sum((percentile * 10)::BIGINT) / count(percentile), 0) / 100 AS v, round_even(10.0::DOUBLE * sum((positive_pct * 10)::BIGINT) / count(positive_pct), 0) / 100 AS s FROM wide GROUP BY developer),
live AS (SELECT c_custkey AS appid, c_name, CASE WHEN c_custkey % 3 = 0 THEN make_date((1996 + c_custkey % 8)::INTEGER, (1 + c_custkey % 12)::INTEGER, 1) END AS d, CASE WHEN c_custkey % 4 <> 0 THEN 1000 * (1 + c_custkey % 5) END::INTEGER AS cents, c_custkey % 2 = 0 AS mac FROM customer),
dated AS (SELECT *, coalesce(year(d), 2001)::INTEGER AS y FROM live),
recent AS (SELECT d.appid, arg_max(rate, r.cohort_year) AS rate FROM dated d JOIN rates r ON r.cohort_year BETWEEN d.y - 3 AND d.y WHERE rate IS NOT NULL GROUP BY d.appid)
SELECT dated.appid, coalesce(v, 50.0) AS publisher_mean_volume_pct, coalesce(s, 75.0) AS publisher_mean_positive_pct, coalesce(n, 0)::DOUBLE AS publisher_title_count, (n IS NOT NULL)::INTEGER::DOUBLE AS publisher_known,
  coalesce(round_even(cents / rate::DOUBLE, 3), 1.0) AS price_vs_going_rate, coalesce(cents, 0) / 100.0::DOUBLE AS launch_price_usd, 1.0::DOUBLE AS budget_tier_aaa, (1 + mac::INTEGER)::DOUBLE AS platform_count, 0.0::DOUBLE AS has_prelaunch_demo, 0.0::DOUBLE AS launch_day_dlc_count,
  coalesce(month(d), 0)::DOUBLE AS release_month, y::DOUBLE AS cohort_year,
  array_to_string(list_sort(list_filter(['budget_tier_aaa', 'has_prelaunch_demo', 'launch_day_dlc_count', CASE WHEN n IS NULL THEN 'publisher_mean_volume_pct' END, CASE WHEN n IS NULL THEN 'publisher_mean_positive_pct' END, CASE WHEN n IS NULL THEN 'publisher_title_count' END,
    CASE WHEN d IS NULL THEN 'release_month' END, CASE WHEN d IS NULL THEN 'cohort_year' END, CASE WHEN cents IS NULL OR rate IS NULL THEN 'price_vs_going_rate' END, CASE WHEN cents IS NULL THEN 'launch_price_usd' END], lambda x: x IS NOT NULL)), ',') AS imputed
FROM dated LEFT JOIN hist ON developer = c_name LEFT JOIN recent ON recent.appid = dated.appid""")
def live_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles not out yet, against all history."""
    return live_of(spark, sf_dir, wide(spark, sf_dir)).withColumn("imputed", F.array_join("imputed", ","))


def live_of(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The features of titles not out yet, against ``rows`` (wide)."""
    t = tracked(spark, sf_dir)
    years = t.select(F.coalesce(F.year("release_date"), F.lit(2001)).alias("cohort_year"))
    return forecast.live_matrix(t, histories.live_records(t, rows), cohort.recent_rates(years, rates(spark, sf_dir)), 2001)


FOLDS = """
rows AS (
  SELECT appid, outcome, r.repeat::INTEGER AS repeat FROM titles, (SELECT unnest(range(20)) AS repeat) r WHERE launch_type = 'day_one_steam' AND outcome IS NOT NULL
), folds AS (
  SELECT *, ((row_number() OVER (PARTITION BY repeat, outcome ORDER BY md5(appid || ':' || repeat), appid) - 1) % 5)::INTEGER AS fold FROM rows
)"""


@query(f"{BASE}, {FOLDS.strip()} SELECT * FROM folds")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return forecast.folds(labelled(spark, sf_dir))


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows whose prediction is the rule forecast, with each fold's constants."""
    assigned = forecast.folds(labelled(spark, sf_dir))
    said = forecasts(spark, sf_dir).select("appid", outcome_rank(F.col("predicted")).alias("predicted"))
    return assigned.join(forecast.fold_constants(assigned), ["repeat", "fold"]).join(said, "appid").select("appid", "repeat", "fold", outcome_rank(F.col("outcome")).alias("actual"), "predicted", "modal", "median")


HELD = f"""{FORECAST}, {FOLDS.strip()}, ranks AS (SELECT appid, repeat, fold, list_position(['flop', 'underperform', 'success', 'breakout'], outcome) - 1 AS actual FROM folds),
parts AS (SELECT DISTINCT repeat, fold FROM ranks),
counted AS (SELECT p.repeat, p.fold, actual, count(*) AS n FROM parts p JOIN ranks r ON r.repeat = p.repeat AND r.fold <> p.fold GROUP BY ALL),
consts AS (SELECT p.repeat, p.fold, (SELECT actual FROM counted c WHERE c.repeat = p.repeat AND c.fold = p.fold ORDER BY n DESC, actual LIMIT 1)::INTEGER AS modal,
  (SELECT floor(median(actual)) FROM ranks r WHERE r.repeat = p.repeat AND r.fold <> p.fold)::INTEGER AS median FROM parts p),
held AS (SELECT r.appid, r.repeat, r.fold, r.actual::INTEGER AS actual, (list_position(['flop', 'underperform', 'success', 'breakout'], c.predicted) - 1)::INTEGER AS predicted, modal, median FROM ranks r JOIN consts USING (repeat, fold) JOIN calls c ON c.appid = r.appid)"""


@query(f"""{HELD}, v AS (SELECT appid, predicted, row_number() OVER (PARTITION BY appid ORDER BY count(*) DESC, predicted) AS k FROM held GROUP BY appid, predicted)
SELECT appid, actual, avg((predicted = actual)::INTEGER) AS hit_rate, avg((modal = actual)::INTEGER) AS constant_hit_rate, avg(abs(predicted - actual)) AS model_distance, avg(abs(median - actual)) AS constant_distance, v.predicted AS vote
FROM held JOIN v USING (appid) WHERE k = 1 GROUP BY appid, actual, v.predicted""".replace("avg((predicted", "avg((held.predicted").replace("abs(predicted", "abs(held.predicted"))
def heldout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles furthest off first."""
    return training.misses(forecast.held_out_scores(guesses(spark, sf_dir)))


@query(f"""{HELD}, s AS (SELECT appid, avg((predicted = actual)::INTEGER) AS h, avg((modal = actual)::INTEGER) AS c, avg(abs(predicted - actual)) AS m, avg(abs(median - actual)) AS d FROM held GROUP BY appid),
one AS (SELECT count(*)::BIGINT AS n_rows, avg(h) AS accuracy, avg(c) AS constant_accuracy, avg(m) AS distance, avg(d) AS constant_distance, avg(d - m) AS improvement, stddev_samp(d - m) / sqrt(count(*)) AS se FROM s)
SELECT n_rows, round(accuracy, 6) AS accuracy, round(constant_accuracy, 6) AS constant_accuracy, round(distance, 6) AS distance, round(constant_distance, 6) AS constant_distance, round(improvement, 6) AS improvement, round(se, 6) AS improvement_se, round(improvement - 1.96 * se, 6) AS ci_low,
  improvement - 1.96 * se > 0 AND accuracy >= constant_accuracy AS passes, CASE WHEN improvement - 1.96 * se > 0 AND accuracy >= constant_accuracy THEN 'beats the constant' WHEN improvement > 0 THEN 'better than the constant, but inside the noise' ELSE 'does not beat the constant' END AS verdict FROM one""")
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    g = forecast.gate(forecast.held_out_scores(guesses(spark, sf_dir)))
    return g.withColumns({c: F.round(c, 6) for c in ("accuracy", "constant_accuracy", "distance", "constant_distance", "improvement", "improvement_se", "ci_low")})


@query(f"""{BASE}, l AS (SELECT appid, outcome FROM titles WHERE launch_type = 'day_one_steam' AND outcome IS NOT NULL)
SELECT count(*)::BIGINT AS n, count(*) || ':' || left(sha256('[' || string_agg('[' || appid || ', "' || outcome || '"]', ', ' ORDER BY appid, outcome) || ']'), 16) AS fingerprint FROM l""")
def label_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return forecast.label_fingerprint(labelled(spark, sf_dir))


@query(f"""{FORECAST}, c AS (SELECT appid, greatest(1 - p_flop, 0) AS a, greatest(1 - p_flop - p_underperform, 0) AS b, p_breakout AS d FROM calls), p AS (SELECT appid, greatest(1 - a, 1e-9) AS p0, greatest(a - b, 1e-9) AS p1, greatest(b - d, 1e-9) AS p2, greatest(d, 1e-9) AS p3 FROM c)
SELECT appid, round(p0 / (p0 + p1 + p2 + p3), 6) AS p0, round(p3 / (p0 + p1 + p2 + p3), 6) AS p3 FROM p""")
def ordinal_recombine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: tier probabilities from the three P(rank > k)."""
    c = forecasts(spark, sf_dir)
    above = F.array(F.greatest(1 - F.col("p_flop"), F.lit(0.0)), F.greatest(1 - F.col("p_flop") - F.col("p_underperform"), F.lit(0.0)), F.col("p_breakout"))
    p = c.select("appid", recombined(above).alias("p"))
    return p.select("appid", F.round(F.element_at("p", 1), 6).alias("p0"), F.round(F.element_at("p", 4), 6).alias("p3"))


TREES, REPEATS = 20, 2  # of the queries; the operators' own are 150 and 20, see the README


def matrix_of(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return written(forecast.training_matrix(rows, histories.publisher_records(rows), rates(spark, sf_dir)), "matrix")


def gated(matrix: DataFrame) -> DataFrame:
    assigned = forecast.folds(matrix.select("appid", "outcome"), repeats=REPEATS)
    found = training.cross_validated(matrix, assigned, forecast.fold_constants(assigned), trees=TREES)
    return forecast.gate(forecast.held_out_scores(found))


@query()
def gbt_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles not out, by MLlib's trees per cut if the gate lets them into service, else by the rule."""
    rows = wide(spark, sf_dir)
    matrix, service = matrix_of(spark, sf_dir, rows), new_folder(spark, "service")
    gate = written(gated(matrix).withColumn("n_rows", F.col("n_rows").cast("long")), "gate")
    passed = gate.first()
    model = training.OrdinalTrees(trees=TREES).fit(matrix) if passed.passes else None
    facts = training.provenance(gate, forecast.label_fingerprint(labelled(spark, sf_dir)), "1")
    training.write_if_earned(model, passed, facts, service)
    served = training.in_service(spark, service)
    live = live_of(spark, sf_dir, rows) if served else None  # only what is served is worked out
    rule = None if served else forecasts(spark, sf_dir)
    return training.served(live, rule, served[0] if served else None, passed.n_rows)


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 with A20-A22 on all labelled titles."""
    return gated(matrix_of(spark, sf_dir, wide(spark, sf_dir)))


@query()
def kmeans_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers with a tier where the grouping is stable, the highest and largest first."""
    return tiers.ordered(tiers.tier_table(publisher_stats(spark, sf_dir)))


@query(f"""{BASE}, p AS (SELECT outcome AS a, studio AS b FROM titles WHERE outcome IS NOT NULL), cell AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
ra AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM cell GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM cell GROUP BY b)), t AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS n FROM cell)
SELECT t.n::BIGINT AS n, round((t.x - ra.x * rb.x / (t.n * (t.n - 1) / 2)) / ((ra.x + rb.x) / 2 - ra.x * rb.x / (t.n * (t.n - 1) / 2)), 9) AS adjusted_rand FROM t, ra, rb""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    p = logical.titles(spark, sf_dir).filter("outcome is not null").select(F.col("outcome").alias("a"), F.col("studio").alias("b"))
    return tiers.adjusted_rand(p).withColumn("adjusted_rand", F.round("adjusted_rand", 9))


@query(f"""{WIDE.replace('WITH ', 'WITH RECURSIVE ', 1)}, near AS (SELECT appid, cohort_year, positive_pct, percentile < 35 AS short FROM wide WHERE launch_type = 'day_one_steam' AND positive_pct >= 78 AND percentile IS NOT NULL AND cohort_year IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY short, cohort_year, positive_pct ORDER BY appid) AS place FROM near),
cells AS (SELECT short, cohort_year AS y, positive_pct AS s, count(*) AS n, row_number() OVER (PARTITION BY short ORDER BY cohort_year, positive_pct) AS id FROM near GROUP BY short, cohort_year, positive_pct),
ways AS MATERIALIZED (SELECT a.id AS a, b.id AS b, row_number() OVER (ORDER BY round(abs(a.s - b.s), 1) + abs(a.y - b.y), a.y, a.s, b.y, b.s) AS r FROM cells a JOIN cells b ON a.short AND NOT b.short AND abs(a.y - b.y) <= 1 AND round(abs(a.s - b.s), 1) <= 5),
flows AS (SELECT 0::BIGINT AS r, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS n, 0::BIGINT AS upto_a, 0::BIGINT AS upto_b, (SELECT list(n ORDER BY id) FROM cells WHERE short) AS left_a, (SELECT list(n ORDER BY id) FROM cells WHERE NOT short) AS left_b UNION ALL
  SELECT w.r, w.a, w.b, least(left_a[w.a], left_b[w.b]), left_a[w.a], left_b[w.b], list_transform(left_a, lambda x, i: CASE WHEN i = w.a THEN x - least(left_a[w.a], left_b[w.b]) ELSE x END), list_transform(left_b, lambda x, i: CASE WHEN i = w.b THEN x - least(left_a[w.a], left_b[w.b]) ELSE x END)
  FROM flows JOIN ways w ON w.r = flows.r + 1),
pairs AS (SELECT a, b, unnest(range(n)) AS k, upto_a, upto_b FROM flows WHERE n > 0),
ends AS (SELECT c.short, c.id, c.n, p.place, p.appid, p.cohort_year, p.positive_pct FROM placed p JOIN cells c ON c.short = p.short AND c.y = p.cohort_year AND c.s = p.positive_pct)
SELECT t.appid, c.appid AS control, round(abs(t.positive_pct - c.positive_pct), 1) AS gap, abs(t.cohort_year - c.cohort_year)::INTEGER AS years FROM pairs
JOIN ends t ON t.short AND t.id = a AND t.place = t.n - upto_a + k + 1 JOIN ends c ON NOT c.short AND c.id = b AND c.place = c.n - upto_b + k + 1""")
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that fell short, each with the passing title nearest in year and sentiment."""
    rows = wide(spark, sf_dir).filter((F.col("launch_type") == DAY_ONE) & (F.col("positive_pct") >= 78))
    return matching.matched_pairs(rows.filter("percentile < 35"), rows.filter("percentile >= 35"))


@query(f"""{BASE} SELECT a.appid, a.developer AS company, (count(*) - 1)::BIGINT AS nearby FROM titles a JOIN titles b ON a.developer = b.developer AND abs(a.store_date - b.store_date) <= 90 GROUP BY ALL""")
def publisher_dilution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20."""
    return histories.dilution(logical.titles(spark, sf_dir))
