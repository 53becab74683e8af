"""Rule forecasts, feature matrices, folds and the scoring of held-out predictions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchgrid.functions.measures import breadth, likeliest, outcome_rank, relative_price
from launchgrid.functions.text import out_of_scope
from launchgrid.schemas import DAY_ONE, FEATURES, OUT_OF_SCOPE_GENRES, OUTCOMES, POST_LAUNCH

LEAST_HISTORY, MOST_WEIGHT, TITLE_WEIGHT, WINDOWS_ONLY = 2, 0.6, 0.2, 1.05
FOLDS, REPEATS, LEAST_ROWS = 5, 20, 8
HEAD = 3  # characters of a fold key within which places are counted
PIECE_BITS = 12  # of an appid, for pieces of a fingerprint's text


def smoothed(counts: list[Column], add: float) -> list[Column]:
    """Shares of counts with ``add`` for each, to four decimals."""
    total = sum(counts, F.lit(0.0)) + add * len(counts)
    return [F.bround((c + F.lit(add)) / total, 4) for c in counts]


def base_rate(labelled: DataFrame) -> DataFrame:
    """One row: n_labelled and the smoothed share of each outcome among day-one titles."""
    one = labelled.filter((F.col("launch_type") == DAY_ONE) & F.col("outcome").isNotNull()).agg(F.count("*").alias("n_labelled"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    return one.select("n_labelled", *(c.alias(o) for c, o in zip(smoothed([F.col(o) for o in OUTCOMES], 1.0), OUTCOMES, strict=True)))


def rule_forecast(targets: DataFrame, histories: DataFrame, base: DataFrame) -> DataFrame:
    """(appid, history, weight, p_<outcome>, predicted, probability, windows_only) for each target.

    ``targets``: appid and on_windows, on_mac, on_linux; ``histories``: overlap_records;
    ``base``: base_rate, one row, so it is broadcast.
    """
    rows = targets.select("appid", "on_windows", "on_mac", "on_linux").join(histories, "appid").crossJoin(F.broadcast(base.select(*(F.col(o).alias(f"b_{o}") for o in OUTCOMES))))
    rows = rows.withColumn("weight", F.when(F.col("history") >= LEAST_HISTORY, F.least(F.lit(MOST_WEIGHT), F.lit(TITLE_WEIGHT) * F.col("history"))).otherwise(0.0))
    record = smoothed([F.col(o) for o in OUTCOMES], 0.5)
    only = F.col("on_windows") & ~F.col("on_mac") & ~F.col("on_linux")
    mixed = []
    for o, r in zip(OUTCOMES, record, strict=True):
        w = F.when(F.col("weight") > 0, (1 - F.col("weight")) * F.col(f"b_{o}") + F.col("weight") * r).otherwise(F.col(f"b_{o}"))
        mixed.append(F.when(only, w * WINDOWS_ONLY).otherwise(w) if o in OUTCOMES[:2] else w)
    rows = rows.withColumns({f"w_{o}": m for o, m in zip(OUTCOMES, mixed, strict=True)})
    total = sum((F.col(f"w_{o}") for o in OUTCOMES), F.lit(0.0))
    rows = rows.withColumns({f"p_{o}": F.bround(F.col(f"w_{o}") / total, 4) for o in OUTCOMES})
    ps = F.array(*(F.col(f"p_{o}") for o in OUTCOMES))
    names = F.array(*(F.lit(o) for o in OUTCOMES))
    return rows.select("appid", "history", "weight", *(f"p_{o}" for o in OUTCOMES), F.element_at(names, likeliest(ps) + 1).alias("predicted"), F.array_max(ps).alias("probability"), only.alias("windows_only"))


def told(forecasts: DataFrame, names: DataFrame, base: DataFrame) -> DataFrame:
    """``forecasts`` with confidence (low: a prior is never more), rationale and basis, as text.

    ``names``: first_names of the same targets; ``base``: base_rate, one row, so it is broadcast.
    """
    rows = forecasts.join(names, "appid", "left").crossJoin(F.broadcast(base.select("n_labelled")))
    text = lambda c: F.col(c).cast("string")
    percent = lambda c: F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))
    leans = F.concat(F.lit("leans "), "predicted", F.lit(" ("), percent(F.col("probability")), F.lit("), "))
    more = F.when(F.col("history") > 3, ", …").otherwise("")
    rationale = F.when(F.col("history") >= LEAST_HISTORY, F.concat(leans, F.lit("mostly by how "), text("history"), F.lit(" earlier titles of the team came out"))).otherwise(F.concat(leans, F.lit("from all labelled titles; the team has no track record")))
    record = (
        F.when(F.col("history") >= LEAST_HISTORY, F.concat(text("history"), F.lit(" labelled titles of the team ("), F.array_join("names", ", "), more, F.lit("), weight "), percent(F.col("weight"))))
        .when(F.col("history") > 0, "a single labelled title of the team, too few to count")
        .otherwise("no labelled title of the team")
    )
    basis = F.concat_ws("; ", F.concat(F.lit("base rate of "), text("n_labelled"), F.lit(" labelled titles")), record, F.when(F.col("windows_only"), "on Windows only"))
    return rows.select(*(c for c in forecasts.columns if c != "windows_only"), F.lit("low").alias("confidence"), rationale.alias("rationale"), basis.alias("basis"))


def assert_no_leakage(names: list[str]) -> None:
    """Raise if any name is of something known only after launch."""
    leaked = sorted(POST_LAUNCH & set(names))
    if leaked:
        raise AssertionError(f"known only after launch, so not for a forecast: {', '.join(leaked)}")


def training_matrix(titles: DataFrame, records: DataFrame, rates: DataFrame, labelled_only: bool = True) -> DataFrame:
    """(appid, the twelve FEATURES, outcome) of day-one titles in scope."""
    assert_no_leakage(list(FEATURES))
    rows = titles.filter((F.col("launch_type") == DAY_ONE) & ~out_of_scope(F.col("genres"), OUT_OF_SCOPE_GENRES))
    if labelled_only:
        rows = rows.filter(F.col("outcome").isNotNull())
    rows = rows.join(records, "appid", "left").join(F.broadcast(rates.select("cohort_year", "rate")), "cohort_year", "left")
    cents = F.col("launch_price_cents")
    values = [
        F.col("mean_volume_pct"), F.col("mean_positive_pct"), F.col("title_count"), F.col("known"),
        F.coalesce(relative_price(cents, F.col("rate")), F.lit(1.0)), F.coalesce(cents, F.lit(0)) / 100.0, F.col("budget_tier") == "aaa",
        breadth(F.col("on_windows"), F.col("on_mac"), F.col("on_linux")), F.col("demo_timing") == "pre_launch",
        F.coalesce("launch_day_dlc_count", F.lit(0)), F.coalesce(F.month("store_date"), F.lit(0)), F.coalesce("cohort_year", F.lit(0)),
    ]
    return rows.select("appid", *(v.cast("double").alias(n) for v, n in zip(values, FEATURES, strict=True)), "outcome")


def live_matrix(tracked: DataFrame, records: DataFrame, recent: DataFrame, this_year: int) -> DataFrame:
    """The same features for titles not out yet, with the sorted names of what was assumed.

    ``recent``: recent_rates, a row a year. An undated title counts as of ``this_year``.
    """
    rows = tracked.withColumn("cohort_year", F.coalesce(F.year("release_date"), F.lit(this_year))).join(records, "appid", "left").join(F.broadcast(recent), "cohort_year", "left")
    cents = F.col("price_initial_cents")
    relative = relative_price(cents, F.col("rate"))
    values = [
        F.col("mean_volume_pct"), F.col("mean_positive_pct"), F.col("title_count"), F.col("known"), F.coalesce(relative, F.lit(1.0)), F.coalesce(cents, F.lit(0)) / 100.0, F.lit(1.0),
        breadth(F.col("on_windows"), F.col("on_mac"), F.col("on_linux")), F.lit(0.0), F.lit(0.0), F.coalesce(F.month("release_date"), F.lit(0)), F.col("cohort_year"),
    ]
    some = lambda c, *names: F.when(c, F.array(*(F.lit(n) for n in names))).otherwise(F.array().cast("array<string>"))
    assumed = F.concat(
        some(~F.col("known"), *FEATURES[:3]), some(F.col("release_date").isNull(), "release_month", "cohort_year"), some(relative.isNull(), "price_vs_going_rate"),
        some(F.coalesce(cents, F.lit(0)) == 0, "launch_price_usd"), F.array(*(F.lit(n) for n in ("budget_tier_aaa", "has_prelaunch_demo", "launch_day_dlc_count"))),
    )
    return rows.select("appid", *(v.cast("double").alias(n) for v, n in zip(values, FEATURES, strict=True)), F.array_sort(F.array_distinct(assumed)).alias("imputed"))


def folds(labelled: DataFrame, repeats: int = REPEATS, key=lambda appid, repeat: F.md5(F.concat_ws(":", appid.cast("string"), repeat.cast("string")))) -> DataFrame:
    """(appid, outcome, repeat, fold): stratified folds, the same on every run.

    As many folds as the smallest outcome has titles, five at most. Fewer than eight titles,
    or an outcome with one, raise. ``key`` is a text whose order is the shuffle: places are counted
    within equal first characters, and those counts are summed up, so no outcome is one task.
    """
    sizes = [r.n for r in labelled.groupBy("outcome").agg(F.count("*").alias("n")).collect()]
    if sum(sizes) < LEAST_ROWS or min(sizes, default=0) < 2:
        raise ValueError("too few labelled titles, or an outcome with a single one")
    rows = labelled.select("appid", "outcome", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).withColumn("key", key(F.col("appid"), F.col("repeat")))
    rows = rows.withColumn("head", F.substring("key", 1, HEAD))
    heads = ["repeat", "outcome", "head"]
    before = Window.partitionBy("repeat", "outcome").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*heads).agg(F.count("*").alias("n")).select(*heads, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*heads).orderBy("key", "appid")) - 1
    fold = F.pmod(F.col("before") + F.col("place"), F.lit(min(FOLDS, *sizes))).cast("int")
    return rows.withColumn("place", place).join(counts, heads).select("appid", "outcome", "repeat", fold.alias("fold"))


def fold_constants(assigned: DataFrame) -> DataFrame:
    """(repeat, fold, modal, median): trivial guesses from each fold's training part.

    Training counts are a repeat's counts less the fold's own.
    """
    rank = outcome_rank(F.col("outcome"))
    per = lambda keys: assigned.groupBy(*keys).agg(*(F.count_if(rank == k).alias(f"c{k}") for k in range(4)))
    whole = per(["repeat"]).select("repeat", *(F.col(f"c{k}").alias(f"all{k}") for k in range(4)))
    left = per(["repeat", "fold"]).join(whole, "repeat").select("repeat", "fold", F.array(*(F.col(f"all{k}") - F.col(f"c{k}") for k in range(4))).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)
    upto = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.aggregate(F.slice("n", 1, i), F.lit(0).cast("bigint"), lambda s, x: s + x))
    at = lambda k: F.size(F.filter(upto, lambda u: u < k))
    median = F.floor((at(F.floor((total + 1) / 2)) + at(F.floor(total / 2) + 1)) / 2)
    return left.select("repeat", "fold", likeliest(F.col("n")).alias("modal"), median.cast("int").alias("median"))


def held_out_scores(predictions: DataFrame) -> DataFrame:
    """Per title over its repeats: hit rate, mean distances of model and constant, modal vote.

    ``predictions``: appid, repeat, actual, predicted, modal, median (ranks).
    """
    votes = [F.count_if(F.col("predicted") == k) for k in range(4)]
    return predictions.groupBy("appid", "actual").agg(
        F.avg((F.col("predicted") == F.col("actual")).cast("int")).alias("hit_rate"), F.avg((F.col("modal") == F.col("actual")).cast("int")).alias("constant_hit_rate"),
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("model_distance"), F.avg(F.abs(F.col("median") - F.col("actual"))).alias("constant_distance"), likeliest(F.array(*votes)).alias("vote"),
    )


def gate(scores: DataFrame) -> DataFrame:
    """One row: whether the model earns its place. Improvement must clear its own 95 % interval,
    and accuracy must not fall below the constant guess."""
    gain = F.col("constant_distance") - F.col("model_distance")
    one = scores.agg(
        F.count("*").alias("n_rows"), F.avg("hit_rate").alias("accuracy"), F.avg("constant_hit_rate").alias("constant_accuracy"), F.avg("model_distance").alias("distance"), F.avg("constant_distance").alias("constant_distance"),
        F.avg(gain).alias("improvement"), F.coalesce(F.stddev_samp(gain) / F.sqrt(F.count("*")), F.lit(0.0)).alias("improvement_se"),
    ).withColumn("ci_low", F.col("improvement") - 1.96 * F.col("improvement_se"))
    passes = (F.col("n_rows") > 0) & (F.col("ci_low") > 0) & (F.col("accuracy") >= F.col("constant_accuracy"))
    verdict = F.when(passes, "beats the constant").when(F.col("improvement") > 0, "better than the constant, but inside the noise").otherwise("does not beat the constant")
    return one.select("*", F.coalesce(passes, F.lit(False)).alias("passes"), verdict.alias("verdict"))


def label_fingerprint(labelled: DataFrame) -> DataFrame:
    """One row (n, fingerprint): n and the first 16 digits of the SHA-256 of the sorted (appid, outcome) pairs as JSON.

    One form for any number of labels. The text is put together in parallel, in pieces of neighbouring appids; as such a
    digest is worked out from its start to its end, one task then reads the pieces in order and holds one batch of them.
    """
    pair = F.struct(F.col("appid").cast("long").alias("appid"), F.col("outcome"))
    told = F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat(F.lit("["), x["appid"].cast("string"), F.lit(', "'), x["outcome"], F.lit('"]')))
    pieces = labelled.groupBy(F.shiftright(F.col("appid").cast("long"), PIECE_BITS).alias("piece")).agg(F.count("*").alias("n"), F.array_join(told, ", ").alias("text"))
    start = labelled.sparkSession.range(1).select(F.lit(None).cast("long").alias("piece"), F.lit(0).cast("long").alias("n"), F.lit("").alias("text"))  # so no labels have a digest too
    return pieces.unionByName(start).repartition(1).sortWithinPartitions("piece").mapInArrow(_digested, "n long, fingerprint string")


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, n = hashlib.sha256(b"["), 0
    for batch in batches:
        for count, text in zip(batch.column("n").to_pylist(), batch.column("text").to_pylist(), strict=True):
            digest.update((", " if n and count else "").encode() + text.encode())
            n += count
    digest.update(b"]")
    yield pa.RecordBatch.from_pydict({"n": [n], "fingerprint": [f"{n}:{digest.hexdigest()[:16]}"]})
