"""Scores against labels, drift between tables, and the audit of launch types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchgrid.functions.dates import launch_type, proposal
from launchgrid.functions.measures import outcome_rank, tier_distance
from launchgrid.functions.rubric import tier_from_signals
from launchgrid.schemas import OUTCOMES

LABEL_FIELDS = ("studio_signal", "support_signal", "resolved_outcome", "label_confidence", "research_status", "platform_launch_type")
NEGATIVE_STUDIO, BENIGN_STUDIO = ("closed", "severe_layoffs"), ("grew", "continued")


def report(scored: DataFrame) -> DataFrame:
    """One row over ``scored`` (expected, predicted, unresolved): counts and agreements."""
    both = F.col("predicted").isNotNull() & F.col("expected").isNotNull()
    exact, met = F.col("expected") == F.col("predicted"), (outcome_rank(F.col("expected")) >= 2) == (outcome_rank(F.col("predicted")) >= 2)
    share = lambda c: F.bround(100.0 * F.count_if(both & c) / F.nullif(F.count_if(both), F.lit(0)), 1)
    return scored.agg(
        F.count_if(F.col("expected").isNotNull()).alias("scored"), F.count_if(both).alias("resolved"), F.count_if(F.col("expected").isNotNull() & F.col("predicted").isNull()).alias("unresolved"),
        share(exact).alias("exact_pct"), share(met).alias("met_pct"), F.bround(F.sum(F.when(both, tier_distance(F.col("expected"), F.col("predicted")))) / F.nullif(F.count_if(both), F.lit(0)).cast("double"), 2).alias("mean_distance"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    """Expected by predicted outcome."""
    return scored.filter("expected is not null and predicted is not null").groupBy("expected").pivot("predicted", list(OUTCOMES)).count().na.fill(0)


def disagreements(scored: DataFrame) -> DataFrame:
    """Titles whose outcomes differ, furthest apart first."""
    rows = scored.withColumn("distance", tier_distance(F.col("expected"), F.col("predicted"))).filter("distance > 0")
    return rows.orderBy(F.desc("distance"), "store_date", "appid").select("appid", "store_date", "expected", "predicted", "distance")


def drift(curated: DataFrame, stored: DataFrame, fields: tuple[str, ...] = LABEL_FIELDS) -> DataFrame:
    """(appid, field, curated, stored) of labelled titles whose fields differ; a missing stored
    row differs as ``missing_row``. Both tables have appid and ``fields``."""
    there = stored.select("appid", F.lit(True).alias("_there"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = curated.filter("resolved_outcome is not null").join(there, "appid", "left")
    cells = [F.when(F.col("_there").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), F.col(f).alias("curated"), F.col(f"_{f}").alias("stored"))) for f in fields]
    gone = F.when(F.col("_there").isNull(), F.struct(F.lit("missing_row").alias("field"), F.lit(None).cast("string").alias("curated"), F.lit(None).cast("string").alias("stored")))
    return both.select("appid", F.explode(F.array_compact(F.array(gone, *cells))).alias("d")).select("appid", "d.*")


def proposals(titles: DataFrame) -> DataFrame:
    """(appid, verdict, proposed, gap_days) for every title; ``early_access`` is a flag column."""
    return titles.select("appid", proposal(F.col("original_date"), F.col("store_date"), F.col("early_access")).alias("p")).select("appid", "p.*")


def audit(titles: DataFrame) -> DataFrame:
    """(appid, agreement, gap_days): the stored launch type against the dates and the curated value.

    ``titles``: appid, stored, curated, original_date, store_date, early_access.
    """
    p = proposal(F.col("original_date"), F.col("store_date"), F.col("early_access"))
    rows = titles.withColumn("p", p).withColumn("expected", launch_type(F.col("store_date"), F.col("original_date")))
    stored, curated = F.col("stored"), F.col("curated")
    fits = (stored == F.col("expected")) | ((stored == "former_exclusive") & (F.col("expected") == "delayed_port"))
    agreement = (
        F.when(F.col("p.verdict") == "no_date", "undecidable")
        .when(F.col("p.verdict") == "steam_first", "conflict")
        .when(curated.isNotNull() & ~stored.eqNullSafe(curated), "conflict")
        .when(stored.isNull() | (stored == "unknown"), "unset")
        .when(F.col("p.verdict") == "early_access", F.when(stored == "day_one_steam", "ok").otherwise("conflict"))
        .when(~fits, "conflict")
        .when(curated.isNotNull(), "ok")
        .otherwise("derived")
    )
    return rows.select("appid", agreement.alias("agreement"), F.col("p.gap_days").alias("gap_days"))


def compare_drafts(drafts: DataFrame, curated: DataFrame) -> DataFrame:
    """Drafts joined to curated rows by key, with verdict and tier direction; unmatched rows of
    either side are kept, told apart by ``status``."""
    d = drafts.select("key", F.col("studio").alias("drafted_studio"), F.col("support").alias("drafted_support"), "alternative")
    c = curated.select("key", F.col("studio").alias("curated_studio"), F.col("support").alias("curated_support"))
    both = d.join(c, "key", "full_outer")
    ds, cs = F.col("drafted_studio"), F.col("curated_studio")
    status = F.when(cs.isNull(), "draft_only").when(ds.isNull(), "curated_only").otherwise("compared")
    verdict = F.when(ds == cs, "agrees").when(ds == "unknown", "refused").when(cs.isin(*NEGATIVE_STUDIO) & ds.isin(*BENIGN_STUDIO), "false_benign").when(cs.isin(*BENIGN_STUDIO) & ds.isin(*NEGATIVE_STUDIO), "false_alarm").otherwise("differs")
    tiers = both.withColumns({"drafted_tier": tier_from_signals(ds, F.col("drafted_support")), "curated_tier": tier_from_signals(cs, F.col("curated_support"))})
    direction = F.when(F.col("drafted_tier") == F.col("curated_tier"), "agrees").when(F.col("curated_tier") == "flop", "softer").otherwise("harsher")
    done = F.col("status") == "compared"
    return tiers.withColumn("status", status).withColumns({"verdict": F.when(done, verdict), "tier_direction": F.when(done, direction)})


def tally(compared: DataFrame) -> DataFrame:
    """One row of counts over compare_drafts."""
    rows = compared.filter("status = 'compared'")
    studio, support = F.col("drafted_studio") == F.col("curated_studio"), F.col("drafted_support") == F.col("curated_support")
    is_ = lambda col, v: F.count_if(F.col(col) == v)
    return rows.agg(
        F.count("*").alias("compared"), F.count_if(studio).alias("studio_agrees"), F.count_if(support).alias("support_agrees"), F.count_if(studio & support).alias("both_agree"),
        *(is_("verdict", v).alias(v) for v in ("false_benign", "false_alarm", "refused", "differs")),
        is_("tier_direction", "agrees").alias("tier_agrees"), is_("tier_direction", "softer").alias("tier_softer"), is_("tier_direction", "harsher").alias("tier_harsher"), F.count_if(F.trim("alternative") != "").alias("flagged_alternative"),
    )
