"""Operators on small tables worked out by hand."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from launchgrid.operators import catalog, cohort, forecast, histories, matching, quality, snapshots, tiers, training, windows
from launchgrid.schemas import CURATED_COLUMNS, FEATURES, OUTCOMES
from launchgrid.sources import curated, landed

D = datetime.date


def test_percentiles(spark):
    ref = spark.createDataFrame([(2020, v) for v in range(10, 90, 10)], "cohort_year int, value long")
    probes = spark.createDataFrame([(1, 2020, 5), (2, 2020, 100), (3, 2020, 45), (4, 2030, 5), (5, None, 5)], "appid int, cohort_year int, value long")
    got = {r.appid: r.percentile for r in cohort.percentiles(ref, probes).collect()}
    assert got == {1: 0.0, 2: 100.0, 3: 50.0, 4: None, 5: None}


def test_ties_and_pooling(spark):
    ref = spark.createDataFrame([(y, 10) for y in (2019, 2020, 2021) for _ in range(3)], "cohort_year int, value long")
    probes = spark.createDataFrame([(1, 2020, 10), (2, 2019, 10)], "appid int, cohort_year int, value long")
    got = {r.appid: (r.cohort_size, r.percentile) for r in cohort.percentiles(ref, probes).collect()}
    assert got == {1: (9, 50.0), 2: (6, None)}


def test_going_rate_ties_go_up(spark):
    tie = spark.createDataFrame([(2020, v) for v in [6000] * 4 + [7000] * 4], "cohort_year int, value long")
    assert {r.cohort_year: r.rate for r in cohort.going_rates(tie).collect()}[2020] == 7000


def titles(spark, rows):
    return spark.createDataFrame(rows, "appid int, publisher string, store_date date, percentile double, positive_pct double")


def test_as_of_records(spark):
    t = titles(spark, [(1, "Acme", D(2019, 1, 1), 60.0, 80.0), (2, "Acme (Japan)", D(2024, 1, 1), 95.0, 90.0), (3, "Nobody\nAcme", D(2022, 1, 1), None, None), (4, "Debut", D(2022, 1, 1), 5.0, 5.0), (5, "Acme", D(2019, 1, 1), 10.0, None), (6, "Acme", None, 99.0, 99.0)])
    got = {r.appid: (r.title_count, r.mean_volume_pct, r.mean_positive_pct, r.known) for r in histories.publisher_records(t).collect()}
    assert got[1] == (0, 50.0, 75.0, False) and got[4] == (0, 50.0, 75.0, False)
    assert got[3] == (2, 35.0, 80.0, True)
    assert got[2] == (3, 35.0, 80.0, True)
    assert got[6][0] == 4


def test_shuffled_input_gives_the_same(spark):
    rows = [(i, f"Co {i % 3}", D(2020, 1 + i % 12, 1), float(i), 50.0) for i in range(40)]
    a, b = (sorted(map(tuple, histories.publisher_records(titles(spark, r)).collect())) for r in (rows, rows[::-1]))
    assert a == b


def test_overlaps_of_titles_with_several_names(spark):
    rows = [(1, "A", "A\nPort", "flop"), (2, "A", "B\nPort", "success"), (3, "C", "Port", None), (4, "B", "B", "flop"), (5, "D", "D", "flop"), (6, "A", "B\nPort", "breakout")]
    t = spark.createDataFrame(rows, "appid int, developer string, publisher string, outcome string")
    found = histories.overlap_records(t, t.filter("outcome is not null"))
    got = {r.appid: (r.history, r.flop, r.underperform, r.success, r.breakout) for r in found.collect()}
    assert got == {1: (2, 0, 0, 1, 1), 2: (3, 2, 0, 0, 1), 3: (3, 1, 0, 1, 1), 4: (2, 0, 0, 1, 1), 5: (0,) * 5, 6: (3, 2, 0, 1, 0)}


def test_overlap_query_has_every_title_and_nominations_every_line(spark):
    from compare import SF

    from launchgrid.plans import catalog as plans
    from launchgrid.plans import histories as _registers  # noqa: F401
    from launchgrid.plans.registry import QUERIES

    assert QUERIES["company_overlap_history"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert plans.nominations(spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_launch_start(spark):
    day = D(2024, 9, 9)
    rel = spark.createDataFrame([(i, day) for i in range(1, 5)], "appid int, store_date date")
    before = lambda n: day - datetime.timedelta(n)
    rows = [(1, before(k), 5000, 0) for k in range(1, 5)] + [(2, before(k), 100, 0) for k in range(20, 60)] + [(3, before(3), 10, 0)] + [(4, before(k), 100, 0) for k in range(1, 12)]
    got = {r.appid: (r.verdict, r.days_earlier) for r in windows.launch_start(rel, spark.createDataFrame(rows, "appid int, day date, n long, positive long")).collect()}
    assert got == {1: ("shifted", 4), 2: ("sold_before", 0), 3: ("no_head_start", 0), 4: ("needs_review", 11)}


def test_date_changes(spark):
    t = datetime.datetime
    rows = [(1, t(2026, 1, 1), "Nov 12, 2026"), (1, t(2026, 2, 1), "Mar 4, 2027"), (1, t(2026, 3, 1), "Sep 9, 2027"), (2, t(2026, 1, 1), "Q4 2026"), (2, t(2026, 2, 1), "Nov 12, 2026"), (3, t(2026, 1, 1), None), (3, t(2026, 2, 1), "2027"), (3, t(2026, 3, 1), None)]
    changes = snapshots.date_changes(spark.createDataFrame(rows, "appid int, captured_at timestamp, raw string"))
    got = sorted((r.appid, r.days_moved, r.coarse, r.is_delay) for r in changes.filter("appid < 3").collect())
    assert got == [(1, 112, False, True), (1, 189, False, True), (2, 42, True, False)]
    assert changes.filter("appid = 3").count() == 1
    assert [(r.appid, r.delay_count, r.total_days_delayed) for r in snapshots.delay_totals(changes).orderBy("appid").limit(1).collect()] == [(1, 2, 301)]


def test_price_history_shapes(spark):
    nested = [{"timestamp": "2023-10-05T00:00:00Z", "deal": {"price": {"amount": 29.99}, "regular": {"amount": 59.99}, "cut": 50}}]
    flat = [{"date": "2023-10-05", "regular": 59.99, "price": 59.99, "cut": 0}, {"date": "2024-01-01", "regular": 39.99}]
    rows = [(1, json.dumps(nested)), (2, json.dumps({"history": flat})), (3, json.dumps([{"date": "2023-10-05", "label": "?"}])), (4, "not json")]
    got = {r.appid: (r.price_cents, r.observed_on, r.parsed, r.total) for r in catalog.oldest_prices(landed.price_history(spark.createDataFrame(rows, "appid int, payload string"))).collect()}
    assert got == {1: (5999, D(2023, 10, 5), 1, 1), 2: (5999, D(2023, 10, 5), 2, 2), 3: (None, None, 0, 1)}


@pytest.mark.parametrize(("days", "ok"), [(0, True), (60, True), (61, False), (1500, False), (-1, True), (-30, True), (-31, False), (None, False)])
def test_launch_price_window(spark, days, ok):
    df = spark.createDataFrame([(1, 1, days)], "p int, t int, d int")
    assert df.select(catalog.price_verdict(F.col("p"), F.col("t"), F.col("d"))["is_launch_price"]).first()[0] is ok


def test_folds_refuse_thin_labels(spark):
    few = spark.createDataFrame([(i, "flop") for i in range(6)], "appid int, outcome string")
    one = spark.createDataFrame([(i, "flop" if i else "success") for i in range(12)], "appid int, outcome string")
    for df in (few, one):
        with pytest.raises(ValueError):
            forecast.folds(df)


def test_gate(spark):
    noisy = spark.createDataFrame([(i, 0, 1.0, 0.0, 0.0, float(i % 2)) for i in range(40)], "appid int, actual int, hit_rate double, constant_hit_rate double, model_distance double, constant_distance double")
    assert forecast.gate(noisy).first().passes
    assert not forecast.gate(noisy.withColumn("hit_rate", F.lit(-1.0))).first().passes
    assert not forecast.gate(noisy.limit(0)).first().passes


def test_label_fingerprint(spark):
    a = spark.createDataFrame([(1, "flop"), (2, "success")], "appid int, outcome string")
    f = lambda df: forecast.label_fingerprint(df).first().fingerprint
    assert f(a) == f(a.orderBy(F.desc("appid"))) != f(a.withColumn("outcome", F.lit("flop")))


def test_matched_pairs_are_one_to_one(spark):
    a = spark.createDataFrame([(i, 2020, 80.0 + i % 7) for i in range(20)], "appid int, cohort_year int, positive_pct double")
    b = spark.createDataFrame([(100 + i, 2020, 80.0 + i % 5) for i in range(15)], "appid int, cohort_year int, positive_pct double")
    got = matching.matched_pairs(a, b).collect()
    assert len({r.appid for r in got}) == len({r.control for r in got}) == len(got) == 15


def test_clusters_are_ordered_by_scale(spark):
    rows = [(f"s{i}", 0, 1, 10.0) for i in range(5)] + [(f"b{i}", 1, 40, 95.0) for i in range(5)]
    got = tiers.by_scale(spark.createDataFrame(rows, "company string, label int, title_count long, mean_volume_pct double")).collect()
    assert {r.label: r.tier for r in got} == {0: 1, 1: 2}


def test_silhouette_in_blocks(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(str(i), int(i >= 10), Vectors.dense([float(i >= 10) * 5 + (i % 10) * 0.1, 0.0])) for i in range(20)]
    df = spark.createDataFrame(rows, ["company", "label", "features"]).withColumn("label", F.col("label").cast("int"))
    a, b = tiers.silhouette(df).first(), tiers.silhouette(df, block=4).first()
    assert a.n == b.n == 20 and a.silhouette == pytest.approx(b.silhouette) and a.silhouette > 0.8


def test_curated_files(spark, tmp_path):
    good = dict.fromkeys(CURATED_COLUMNS, "") | {"steam_appid": "1", "game_name": "A", "launch_price_usd": "59.99", "resolved_outcome": "flop", "research_status": "researched"}

    def save(name, rows, columns=CURATED_COLUMNS):
        path = tmp_path / name
        path.write_text("\n".join([",".join(columns), *(",".join(r[c] for c in columns) for r in rows)]) + "\n")
        return str(path)

    row = curated.load(spark, save("a.csv", [good])).first()
    assert (row.steam_appid, row.launch_price_cents, row.studio_signal, row.budget_tier) == (1, 5999, "unknown", "unknown")
    with pytest.raises(ValueError, match="line 3: duplicate first on line 2"):
        curated.load(spark, save("b.csv", [good, good]))
    with pytest.raises(ValueError, match="unknown_value budget_tier=huge"):
        curated.load(spark, save("c.csv", [good | {"budget_tier": "huge"}]))
    with pytest.raises(ValueError, match="missing columns: sources"):
        curated.load(spark, save("d.csv", [good], CURATED_COLUMNS[:-1]))


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert quality.duplicate_keys(df, "k").count() == 2


def test_sanity_cap(spark):
    assert quality.capped(spark.range(60)).count() == 60
    with pytest.raises(ValueError):
        quality.capped(spark.range(61))


def matrix(spark, noise):
    """Titles whose first feature is their rank, give or take."""
    rows = [(i, *[float(i % 4) + noise * ((i * 7919) % 13 / 13 - 0.5), *([0.0] * (len(FEATURES) - 1))], OUTCOMES[i % 4]) for i in range(80)]
    return spark.createDataFrame(rows, ["appid", *FEATURES, "outcome"])


def test_cross_validation_tells_signal_from_noise(spark):
    good = matrix(spark, 0.5)
    noise = good.withColumn(FEATURES[0], F.col("appid") * 7919 % 101 / 101.0)
    got = []
    for m in (good, noise):
        assigned = forecast.folds(m.select("appid", "outcome"), repeats=2)
        found = training.cross_validated(m, assigned, forecast.fold_constants(assigned), trees=30)
        got.append(forecast.gate(forecast.held_out_scores(found)).first())
    assert got[0].passes and got[0].accuracy > 0.9 and got[0].distance < 0.2
    assert not got[1].passes


def test_no_fold_of_a_cross_validation_sits_in_one_task(spark):
    m = matrix(spark, 0.5)
    assigned = forecast.folds(m.select("appid", "outcome"), repeats=1)
    found = training.cross_validated(m, assigned, forecast.fold_constants(assigned), trees=1)
    assert found.count() == 80 and "InPandas" not in found._jdf.queryExecution().toString()


def test_predictions_of_all_folds_are_one_scan_and_large_fits_run_alone(spark):
    m = matrix(spark, 0.5).withColumn("appid", F.concat(F.lit("t"), F.col("appid").cast("string")))
    assigned = forecast.folds(m.select("appid", "outcome"), repeats=1)
    found = training.cross_validated(m, assigned, forecast.fold_constants(assigned), trees=1)
    assert "Union" not in found._jdf.queryExecution().toString()
    assert {(r.appid, r.fold) for r in found.collect()} == {(r.appid, r.fold) for r in assigned.collect()}
    assert [training.side_by_side(m.repartition(k)) for k in (1, 4, 8, 50)] == [4, 2, 1, 1]  # of four cores


def test_cross_validation_takes_titles_of_all_years(spark, monkeypatch):
    from compare import SF

    from launchgrid.plans import histories as plans

    seen = []
    monkeypatch.setattr(plans.training, "cross_validated", lambda m, assigned, constants, trees: seen.append(m) or plans.guesses(spark, SF))
    plans.cross_validation(spark, SF)
    assert seen[0].select("cohort_year").distinct().count() > 1


def test_models_are_served_and_kept_only_when_earned(spark, tmp_path):
    m = matrix(spark, 0.2)
    model = training.OrdinalTrees(trees=2).fit(m)
    rule = m.select("appid", F.lit("flop").alias("predicted"), F.lit(0.4).alias("probability"))
    live = m.drop("outcome").withColumn("imputed", F.array().cast("array<string>"))
    by_model, by_rule = training.served(live, rule, model, 80).collect(), training.served(live, rule, None, 80).collect()
    assert {r.method for r in by_model} == {"model"} and sum(r.predicted == r.appid % 4 for r in by_model) >= 60
    assert {(r.method, r.predicted, r.confidence) for r in by_rule} == {("rule", 0, "low")}
    facts = spark.createDataFrame([(80,)], "n_rows int")
    row = spark.createDataFrame([(False,), (True,)], "passes boolean").collect()
    path = str(tmp_path / "m")
    assert not training.write_if_earned(model, row[0], facts, path) and training.in_service(spark, path) is None
    assert training.write_if_earned(model, row[1], facts, path)
    again, told = training.in_service(spark, path)
    assert told.n_rows == 80 and sorted(map(str, again.transform(m).collect())) == sorted(map(str, model.transform(m).collect()))
    constant = training.OrdinalTrees(trees=1).fit(m.filter("outcome = 'flop'"))
    assert training.write_if_earned(constant, row[1], facts, path) and training.in_service(spark, path)[0].cuts == [0.0, 0.0, 0.0]
    # A run that fails midway leaves the model before it in service.
    with pytest.raises(Exception, match="no_such_column"):
        training.write_if_earned(model, row[1], facts.select("no_such_column"), path)
    broken = facts.select(F.raise_error(F.lit("no_such_column")).alias("n_rows"))
    with pytest.raises(Exception, match="no_such_column"):
        training.write_if_earned(model, row[1], broken, path)
    assert training.in_service(spark, path)[0].cuts == [0.0, 0.0, 0.0]
    # A refused run leaves no stale model in service, and folders do not pile up.
    assert not training.write_if_earned(model, row[0], facts, path) and training.in_service(spark, path) is None


def test_label_fingerprint_is_that_of_the_sorted_pairs(spark):
    import hashlib
    import json

    labels = [(30, "flop"), (4, "success"), (100, "breakout"), (7, "flop")]
    want = f"4:{hashlib.sha256(json.dumps(sorted(labels)).encode()).hexdigest()[:16]}"
    df = spark.createDataFrame(labels, "appid long, outcome string")
    assert forecast.label_fingerprint(df).first() == (4, want)
    many = [(k * 7919 % 100_003, "flop" if k % 3 else "success") for k in range(20_000)]
    want = f"20000:{hashlib.sha256(json.dumps(sorted(many)).encode()).hexdigest()[:16]}"
    df = spark.createDataFrame(many, "appid long, outcome string")
    assert {forecast.label_fingerprint(x).first() for x in (df, df.repartition(7), df.orderBy("outcome"))} == {(20000, want)}
    assert forecast.label_fingerprint(df.limit(0)).first() == (0, f"0:{hashlib.sha256(b'[]').hexdigest()[:16]}")


def test_folds_are_even_and_follow_the_key(spark):
    rows = spark.range(400).select(F.col("id").alias("appid"), F.element_at(F.array(*map(F.lit, ("flop", "underperform", "success", "breakout"))), (F.col("id") % 4 + 1).cast("int")).alias("outcome"))
    got = forecast.folds(rows, repeats=3)
    assert got.groupBy("repeat", "outcome", "fold").count().filter("count <> 20").count() == 0 and got.count() == 1200
    import hashlib

    by = sorted(range(0, 400, 4), key=lambda i: hashlib.md5(f"{i}:1".encode()).hexdigest())
    assert {r.appid: r.fold for r in got.filter("repeat = 1 and outcome = 'flop'").collect()} == {i: k % 5 for k, i in enumerate(by)}


def test_relational_tables_are_written_and_read_in_parallel(spark):
    from launchgrid.sources import curated

    url = "jdbc:derby:memory:launches;create=true"
    df = spark.createDataFrame([(i, f"Title {i}", None if i % 3 else i * 1.5) for i in range(50)], "appid long, name string, price double")
    curated.write_table(df, url, "titles", "overwrite")
    curated.write_table(df.filter("appid < 5").withColumn("appid", F.col("appid") + 100), url, "titles")
    whole, parts = curated.read_table(spark, url, "titles"), curated.read_table(spark, url, "titles", "appid", 0, 110, 4)
    assert whole.count() == 55 and parts.rdd.getNumPartitions() == 4
    low = lambda d: sorted(tuple(r) for r in d.toDF("appid", "name", "price").filter("price is not null").collect())
    assert low(whole) == low(parts) and len(low(parts)) == 19


def test_queues(spark):
    from launchgrid.operators import queues

    rows = [(1, "2020-05-01", None, "day_one_steam", "closed", "sustained"), (2, "2020-01-01", 999, "delayed_port", "unknown", "sustained"), (3, None, None, "unknown", "grew", "curtailed"), (4, "2019-01-01", None, "unknown", "grew", "unknown")]
    t = spark.createDataFrame(rows, "appid long, store_date string, launch_price_cents int, launch_type string, studio string, support string").withColumn("store_date", F.to_date("store_date"))
    ids = lambda d: [r.appid for r in d.collect()]
    assert ids(queues.missing_prices(t)) == [3, 4, 1] and ids(queues.answered(t)) == [3, 1]
    assert sorted(ids(queues.probe_scope(t))) == [1, 4] and sorted(ids(queues.probe_scope(t, True))) == [1, 2, 4] and ids(queues.probe_scope(t, True, t.filter("appid = 2"))) == [2]
    assert ids(queues.selected(t, 2)) == [3, 4] and len(ids(queues.selected(t, None))) == 4 and sorted(ids(queues.selected(t, 1, t.filter("appid in (1, 2, 9)")))) == [1, 2]


def test_controls_are_the_nearest(spark):
    from launchgrid.operators import matching

    near = matching.Nearness()
    cols = "appid long, cohort_year int, positive_pct double"
    frame = lambda rows: spark.createDataFrame(rows, cols)
    got = matching.matched_pairs(frame([(1, 2020, 78.9)]), frame([(2, 2020, 78.0), (3, 2020, 78.9)]))
    assert [tuple(r) for r in got.collect()] == [(1, 3, 0.0, 0)]

    rng, sides, want = random.Random(7), ([], []), set()
    for case in range(200):  # cases lie ten years apart, so none reaches another
        make = lambda side: [(case * 100 + side * 50 + k, 10 * case + rng.randrange(3), 80 + rng.randrange(40) / 10 + rng.choice((0, 0, 9))) for k in range(rng.randrange(0, 9))]  # noqa: B023, E731
        treated, controls = make(0), make(1)
        sides[0].extend(treated)
        sides[1].extend(controls)
        ways = []
        for a, y, s in treated:
            for b, z, t in controls:
                gap = abs(round(10 * s) - round(10 * t))
                if gap <= 50 and abs(y - z) <= 1:
                    ways.append((gap + 10 * abs(y - z), y, s, z, t, a, b))
        used = set()
        for gap, y, s, z, t, a, b in sorted(ways):
            if not used & {a, -b - 1}:
                used |= {a, -b - 1}
                want.add((a, b, round(abs(round(10 * s) - round(10 * t)) / 10, 1), abs(y - z)))
    found = {tuple(r) for r in matching.matched_pairs(frame(sides[0] + [(-1, None, 80.0), (-2, 2020, None)]), frame(sides[1]), near).collect()}
    assert found == want and len(want) > 300


def test_places_in_a_cell_run_over_blocks(spark, monkeypatch):
    from launchgrid.operators import matching

    monkeypatch.setattr(matching, "PLACE_BITS", 2)
    side = lambda ids: spark.createDataFrame([(i, 2020, 90.0) for i in ids], "appid long, cohort_year int, positive_pct double")
    got = {(r.appid, r.control) for r in matching.matched_pairs(side(range(0, 60, 3)), side(range(1, 60, 4))).collect()}
    assert got == set(zip(range(0, 60, 3), range(1, 60, 4)))


def test_cohort_sums_run_in_two_levels(spark, monkeypatch):
    from launchgrid.operators import cohort

    rng = random.Random(3)
    rows = [(2000 + rng.randrange(5), rng.choice((rng.randrange(300), rng.randrange(40)))) for _ in range(3000)]
    reference = spark.createDataFrame(rows, "cohort_year int, value long")
    probes = reference.withColumn("appid", F.monotonically_increasing_id())
    both = lambda: (sorted(map(str, cohort.percentiles(reference, probes).collect())), sorted(map(str, cohort.statistics(reference).collect())))
    whole = both()
    monkeypatch.setattr(cohort, "WIDTH", 8)
    monkeypatch.setattr(cohort.in_order, "__defaults__", (8,))
    assert both() == whole
    parts = cohort.pooled(reference).groupBy("cohort_year", F.floor(F.col("value") / 8)).count()
    year = {r.cohort_year: r.n for r in cohort.pooled(reference).groupBy("cohort_year").agg(F.count("*").alias("n")).collect()}
    assert all(10 * r["count"] <= year[r.cohort_year] for r in parts.collect())  # what one window holds
    plan = cohort.percentiles(reference, probes)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_part" in x.split("], [")[1] or "_sum" in x for x in windows)


def test_overlaps_with_many_names_and_a_name_on_half_of_all(spark):
    from launchgrid.operators import histories

    rng = random.Random(2)
    outcomes = ("flop", "underperform", "success", "breakout")
    names = [f"studio {k}" for k in range(30)]
    rows = []
    for i in range(400):
        own = rng.sample(names, rng.randrange(1, 4)) + (["everywhere"] if i % 2 else []) + (["half of those"] if i % 4 == 1 else [])
        rows.append((i, "\n".join(own[:2]), "\n".join(own[2:]), rng.choice(outcomes)))
    rows += [(1000, "\n".join(names * 2), "\n".join(f"other {k}" for k in range(30)), "flop"), (1001, "", None, "flop"), (1002, None, "other 3", "success")]
    df = spark.createDataFrame(rows, "appid long, developer string, publisher string, outcome string")
    sets = {r[0]: {x.strip() for part in r[1:3] for x in (part or "").split("\n")} - {""} for r in rows}
    for heavy in (10, 100_000):
        got = {r.appid: tuple(r)[1:] for r in histories.overlap_records(df, df.filter("appid % 5 <> 0"), heavy).collect()}
        for i, *_ in rows:
            met = [r[3] for r in rows if r[0] % 5 and r[0] != i and sets[r[0]] & sets[i]]
            assert got[i] == (len(met), *(met.count(o) for o in outcomes))


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    import csv

    from launchgrid.schemas import CURATED_COLUMNS
    from launchgrid.sources import curated

    folder = tmp_path / "curated"
    folder.mkdir()
    want = {}
    for name, n in (("a.csv", 120), ("b.csv", 7)):
        with open(folder / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(CURATED_COLUMNS)
            for k in range(n):
                cells = dict.fromkeys(CURATED_COLUMNS, "")
                cells |= {"steam_appid": str(k), "game_name": f"{name} {k}", "notes": 'two\nlines, "quoted"\n\nand a third' if k % 3 == 0 else " plain "}
                w.writerow([cells[c] for c in CURATED_COLUMNS])
                want[f"{name} {k}"] = k + 2
                if k % 10 == 0:
                    f.write("\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str((folder / "a.csv").stat().st_size // 5 + 1))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = curated.read_text(spark, str(folder)).collect()
        assert spark.read.text(str(folder)).rdd.getNumPartitions() >= 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.game_name: r.line for r in got} == want and len(got) == 127
    assert {r.notes for r in got} == {'two\nlines, "quoted"\n\nand a third', "plain"}
    with pytest.raises(ValueError, match="missing columns"):
        (tmp_path / "c.csv").write_text("steam_appid,game_name\n1,x\n")
        curated.read_text(spark, str(tmp_path / "c.csv"))


def test_closed_days_are_rolled_up_once(spark, tmp_path):
    import datetime as d

    from launchgrid.operators import snapshots

    series, rollup = str(tmp_path / "series"), str(tmp_path / "rollup")
    rows = lambda xs: spark.createDataFrame([(i, d.datetime(2026, 1, day, h), n) for i, day, h, n in xs], "appid long, captured_at timestamp, players long")
    snapshots.append_days(rows([(i, day, h, 10 * h) for i in (1, 2) for day in (1, 2, 20) for h in (3, 9)]), series)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "rollup").rglob("day=*/*.parquet")}
    days = lambda today: [x.day for x in snapshots.roll_up(spark, series, rollup, today)]
    assert days(d.date(2026, 2, 3)) == [1, 2]  # the 20th isn't 30 days old
    first = files()
    assert days(d.date(2026, 2, 3)) == [] and files() == first
    snapshots.append_days(rows([(1, 2, 12, 500)]), series)  # late
    assert days(d.date(2026, 2, 4)) == [2]
    second = files()
    assert {p for p in first if second.get(p) == first[p]} == {p for p in first if "day=2026-01-01" in str(p)}
    got = {(r.appid, r.day.day): (r.polls, r.peak_players, r.last_players) for r in spark.read.parquet(rollup).collect()}
    assert got == {(1, 1): (2, 90, 90), (2, 1): (2, 90, 90), (1, 2): (3, 500, 500), (2, 2): (2, 90, 90)}
    assert days(d.date(2026, 2, 8)) == [] and not (tmp_path / "series" / "day=2026-01-01").exists() and (tmp_path / "series" / "day=2026-01-02").exists()
    snapshots.append_days(rows([(1, 1, 5, 7)]), series)
    assert days(d.date(2026, 2, 8)) == [] and not (tmp_path / "series" / "day=2026-01-01").exists()  # a removed day stays as it is
    plan = snapshots.recent(spark.read.parquet(series), 5, since=d.date(2026, 1, 20))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_sampled_silhouette_decides_as_the_exact_one(spark):
    from pyspark.ml.functions import array_to_vector

    from launchgrid.operators import tiers

    rng = random.Random(4)
    for apart in (0.6, 6.0):
        rows = [(f"c{k}", k % 3, [rng.gauss(apart * (k % 3), 1.0), rng.gauss(0, 1.0)]) for k in range(900)]
        df = spark.createDataFrame(rows, "company string, label int, v array<double>").select("company", "label", array_to_vector("v").alias("features"))
        exact = tiers.silhouette(df).first().silhouette
        mean, error, n = tiers.sampled_silhouette(df, 200)
        assert n == 900 and abs(mean - exact) < 4 * error
        assert tiers.sampled_silhouette(df, 900)[:2] == (pytest.approx(exact), 0.0)
        passes, _, used = tiers.clears(df, sample=100)
        assert passes == (exact >= tiers.SILHOUETTE_BAR) and used <= 900
