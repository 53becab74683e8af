"""Column functions for shares, ratios, ranks, money and loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from launchgrid.schemas import OUTCOMES

# Dollars per million tokens, per search, and the batch discount on tokens.
RATES = {"input_tokens": 5.0, "output_tokens": 25.0, "cache_read_tokens": 0.5, "cache_write_tokens": 6.25}
SEARCH_RATE, BATCH_DISCOUNT = 0.01, 0.5


def positive_share(positive: Column, total: Column) -> Column:
    """Percent of reviews that are positive, to one decimal; null without reviews."""
    return F.when(total > 0, F.bround(100.0 * F.coalesce(positive, F.lit(0)) / total, 1))


def retention(late: Column, first: Column) -> Column:
    """Late total over first total; null when either is null or zero."""
    return F.try_divide(F.nullif(late, F.lit(0)).cast("double"), F.nullif(first, F.lit(0)).cast("double"))


def relative_price(cents: Column, rate: Column) -> Column:
    return F.when((cents > 0) & (rate > 0), F.bround(cents / rate.cast("double"), 3))


def to_cents(amount: Column) -> Column:
    """Dollars as whole cents, half to even."""
    return F.bround(amount.try_cast("double") * 100, 0).cast("int")


def breadth(windows: Column, mac: Column, linux: Column) -> Column:
    return windows.cast("int") + mac.cast("int") + linux.cast("int")


def outcome_rank(outcome: Column) -> Column:
    """0 to 3; null for an outcome that is not one of the four."""
    place = F.array_position(F.array(*(F.lit(o) for o in OUTCOMES)), outcome)
    return F.when(place > 0, (place - 1).cast("int"))


def tier_distance(a: Column, b: Column) -> Column:
    return F.abs(outcome_rank(a) - outcome_rank(b))


def recombined(above: Column, least: float = 1e-9) -> Column:
    """Tier probabilities from P(rank > k), k = 0, 1, 2: differences, clipped and made to sum to one."""
    edges = F.concat(F.array(F.lit(1.0)), above, F.array(F.lit(0.0)))
    parts = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.greatest(F.element_at(edges, i) - F.element_at(edges, i + 1), F.lit(least)))
    return F.element_at(F.transform(F.array(parts), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda s, y: s + y))), 1)


def likeliest(probabilities: Column) -> Column:
    """The rank of the greatest probability; the lowest of ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def cost(usage: dict[str, Column], searches: Column, batched: Column) -> Column:
    """Dollars of a run's tokens and searches."""
    tokens = sum((usage[k] * rate for k, rate in RATES.items()), F.lit(0.0)) / 1_000_000
    return tokens * F.when(batched, BATCH_DISCOUNT).otherwise(1.0) + searches * SEARCH_RATE


def loose_int(value: Column) -> Column:
    """An integer written as digits, with a sign perhaps; else null."""
    return F.when(value.rlike(r"^-?\d+$"), value.try_cast("int"))


def next_lifecycle(current: Column, coming_soon: Column) -> Column:
    """A title's state after a poll: it only moves forward."""
    return F.when(current.isNull(), F.when(coming_soon, "pre_launch").otherwise("tracking")).when((current == "pre_launch") & ~coming_soon, "tracking").otherwise(current)


def status_badge(lifecycle: Column, predicted: Column, resolved: Column) -> Column:
    """(kind, provisional, label) that a listing shows."""
    kind = F.when(lifecycle == "pre_launch", "forecast").when(lifecycle == "tracking", "tracking").when(lifecycle == "failed_to_meet_expectations", "provisional").when(lifecycle == "unresolved_insufficient_data", "unresolved").otherwise("resolved")
    label = (
        F.when(kind == "forecast", F.when(predicted.isNull(), "Awaiting forecast").otherwise(F.concat(F.lit("Forecast: "), F.initcap(predicted))))
        .when(kind == "tracking", "Tracking")
        .when(kind.isin("provisional", "unresolved"), "Failed to Meet Expectations")
        .otherwise(F.initcap(F.coalesce(resolved, F.lit("resolved"))))
    )
    return F.struct(kind.alias("kind"), kind.isin("provisional", "unresolved").alias("provisional"), label.alias("label"))


def review_flags(studio: Column, support: Column, sources: Column, confidence: Column, alternative: Column) -> Column:
    """Why a reviewer should look at a draft first; empty for no reason."""
    claims = (studio != "unknown") | (support != "unknown")
    flags = F.array(
        F.when(studio == "closed", "CLOSED-verify"),
        F.when(claims & (F.size(F.coalesce(sources, F.array().cast("array<string>"))) == 0), "no-sources"),
        F.when(confidence == "low", "low-confidence"),
        F.when(F.trim(alternative) != "", "alternative"),
    )
    return F.array_join(F.array_compact(flags), " ")
