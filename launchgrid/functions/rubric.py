"""The outcome rules as Column expressions over one wide row per title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from launchgrid.functions.text import ordinal, percent, tenth, whole
from launchgrid.schemas import Rubric


def met_expectations(pct: Column, sentiment: Column, retention: Column, bars: Rubric = Rubric()) -> Column:
    """Whether a launch met what its budget tier leads one to expect."""
    momentum = F.coalesce((retention >= bars.retention_strong) & (pct >= bars.momentum_volume), F.lit(False))
    return F.when(momentum, True).when(sentiment.isNull(), F.coalesce(pct >= bars.momentum_volume, F.lit(False))).when(sentiment < bars.sentiment, False).when(pct < bars.volume_floor, False).otherwise(True)


def upper(pct: Column, retention: Column, bars: Rubric = Rubric()) -> Column:
    sustained = (pct >= bars.breakout_with_momentum) & (retention >= bars.retention_sustained)
    return F.when((pct >= bars.breakout) | sustained, "breakout").otherwise("success")


def lower(studio: Column, support: Column) -> Column:
    """(outcome, confidence) of a launch that fell short; a null outcome if nothing is known."""
    pair = lambda o, c: F.struct(F.lit(o).alias("outcome"), F.lit(c).alias("confidence"))
    return (
        F.when((studio == "unknown") & (support == "unknown"), F.struct(F.lit(None).cast("string").alias("outcome"), F.lit("none").alias("confidence")))
        .when((studio == "closed") | (support == "abandoned"), pair("flop", "high"))
        .when((studio == "severe_layoffs") & (support != "sustained"), pair("flop", "medium"))
        .when(studio == "severe_layoffs", pair("underperform", "medium"))
        .otherwise(pair("underperform", "high"))
    )


def upper_confidence(outcome: Column, support: Column) -> Column:
    return F.when(support.isin("unknown", "abandoned"), "low").when(outcome == "breakout", "high").otherwise("medium")


def unresolved_reason(pct: Column, reliable: Column, studio: Column, support: Column, met: Column) -> Column:
    """Why no outcome is given; null where one is."""
    silent = (studio == "unknown") & (support == "unknown")
    return F.when(pct.isNull() & ~reliable, "cohort_too_small").when(pct.isNull(), "no_volume").when(~met & silent, "shortfall_without_signals")


def reasons(pct: Column, sentiment: Column, retention: Column, studio: Column, support: Column, bars: Rubric = Rubric()) -> Column:
    """The gates that decided, with their numbers, in the order they were passed."""
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    momentum = F.coalesce((retention >= bars.retention_strong) & (pct >= bars.momentum_volume), F.lit(False))
    first = (
        F.when(momentum, say("grew to ", tenth(retention), "x its first window from the ", ordinal(pct), " percentile"))
        .when(sentiment.isNull(), "no sentiment in the launch window")
        .when(sentiment < bars.sentiment, say(percent(sentiment, bars.sentiment), f"% positive, under the {bars.sentiment:.0f}% bar"))
        .when(pct < bars.volume_floor, say(whole(sentiment), "% positive, but ", ordinal(pct, bars.volume_floor), f" percentile volume is under the floor of {bars.volume_floor:.0f}"))
        .when(pct.isNull(), say(whole(sentiment), "% positive"))
        .otherwise(say(whole(sentiment), "% positive at the ", ordinal(pct), " percentile"))
    )
    met = met_expectations(pct, sentiment, retention, bars)
    sustained = (pct >= bars.breakout_with_momentum) & (retention >= bars.retention_sustained)
    above = F.when(pct >= bars.breakout, say(ordinal(pct), " percentile volume, top of its cohort")).when(sustained, say(ordinal(pct), " percentile volume that kept growing to ", tenth(retention), "x")).otherwise("met its cohort's bar without breakout volume")
    below = (
        F.when((studio == "unknown") & (support == "unknown"), F.lit(None).cast("string"))
        .when(studio == "closed", "the studio closed")
        .when(support == "abandoned", "support was abandoned")
        .when((studio == "severe_layoffs") & (support != "sustained"), "severe layoffs and support cut short")
        .when(studio == "severe_layoffs", "severe layoffs, support as planned")
        .otherwise(say("studio ", studio, ", support ", support))
    )
    return F.array_compact(F.array(first, F.when(met, above).otherwise(below)))


def classify(pct: Column, sentiment: Column, retention: Column, studio: Column, support: Column, reliable: Column, bars: Rubric = Rubric()) -> Column:
    """(outcome, confidence, met, unresolved, reasons). Without a percentile nothing is decided."""
    met = met_expectations(pct, sentiment, retention, bars)
    top, bottom = upper(pct, retention, bars), lower(studio, support)
    outcome = F.when(pct.isNull(), F.lit(None).cast("string")).when(met, top).otherwise(bottom["outcome"])
    confidence = F.when(pct.isNull(), "none").when(met, upper_confidence(top, support)).otherwise(bottom["confidence"])
    told = F.when(pct.isNull(), F.array().cast("array<string>")).otherwise(reasons(pct, sentiment, retention, studio, support, bars))
    return F.struct(outcome.alias("outcome"), confidence.alias("confidence"), F.when(pct.isNotNull(), met).alias("met"), unresolved_reason(pct, reliable, studio, support, met).alias("unresolved"), told.alias("reasons"))


def tier_from_signals(studio: Column, support: Column) -> Column:
    """The tier that two signals alone imply for a launch that fell short."""
    return F.coalesce(lower(studio, support)["outcome"], F.lit("unresolved"))
