"""Column functions on loosely written dates and on gaps between dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from launchgrid.functions.text import stripped

# Date formats in the order they are tried, and what is too coarse to be a day.
FORMATS = ("MMM d, yyyy", "d MMM, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM yyyy", "MMMM yyyy", "yyyy")
COARSE = r"(?i)^(Q[1-4]\s+\d{4}|\d{4}|[A-Za-z]+\s+\d{4}|coming soon|to be announced|tba|tbd)$"
DAY_ONE_DAYS, TIMEZONE_DAYS, PORT_DAYS = 7, 1, 30


def loose_date(raw: Column) -> Column:
    """A date as stores write them; a quarter, month or year is its first day; else null."""
    text = stripped(F.regexp_replace(raw, " ", " "))
    quarter = F.regexp_extract(text, r"^[Qq]([1-4])\s+(\d{4})$", 1)
    year = F.regexp_extract(text, r"^[Qq]([1-4])\s+(\d{4})$", 2)
    first = F.make_date(year.try_cast("int"), (quarter.try_cast("int") - 1) * 3 + 1, F.lit(1))
    return F.coalesce(F.when(quarter != "", first), *(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in FORMATS))


def is_coarse(raw: Column) -> Column:
    """Whether a date's text names no day."""
    return F.coalesce(stripped(raw).rlike(COARSE), F.lit(False))


def launch_type(store: Column, original: Column, curated: Column | None = None, days: int = DAY_ONE_DAYS) -> Column:
    """Day one, port or unknown from the two dates; a curated value wins."""
    gap = F.date_diff(store, original)
    derived = F.when(gap.isNull() | (gap < -days), "unknown").when(gap > days, "delayed_port").otherwise("day_one_steam")
    return derived if curated is None else F.coalesce(curated, derived)


def demo_timing(game: Column, demo: Column, has_demo: Column, days: int = 3) -> Column:
    gap = F.date_diff(demo, game)
    return F.when(~has_demo, "none_listed").when(gap.isNull(), "unknown").when(gap < -days, "pre_launch").when(gap > days, "post_launch").otherwise("launch_window")


def proposal(original: Column, store: Column, early_access: Column) -> Column:
    """(verdict, proposed, gap_days) for a launch type that the dates may settle."""
    gap = F.date_diff(store, original)
    verdict = (
        F.when(gap.isNull(), "no_date")
        .when(F.abs(gap) <= TIMEZONE_DAYS, "day_one_steam")
        .when(early_access, "early_access")
        .when((gap > 0) & (gap <= PORT_DAYS), "near_day_one")
        .when(gap < 0, "steam_first")
        .otherwise("not_day_one")
    )
    return F.struct(verdict.alias("verdict"), F.when(verdict == "day_one_steam", "day_one_steam").otherwise("").alias("proposed"), gap.alias("gap_days"))


def enrichment(original: Column, store: Column) -> Column:
    """What a looked-up original date says about a title."""
    gap = F.date_diff(store, original)
    return F.when(store.isNull(), "not_backfilled").when(gap < -DAY_ONE_DAYS, "suspect").when(gap <= DAY_ONE_DAYS, "day_one").otherwise("port")


def precedes(when: Column, precision: Column, cutoff: Column) -> Column:
    """Whether a dated statement is surely before the cutoff: by day if it names one, else by year."""
    return F.coalesce(F.when(precision >= 11, when < cutoff).otherwise(F.year(when) < F.year(cutoff)), F.lit(False))


def is_stale(at: Column, now: Column, days: int = 14) -> Column:
    return at.isNull() | (at < now - F.make_dt_interval(F.lit(days)))


def research_anchor(original: Column, store: Column, months: int = 16, days: int = PORT_DAYS) -> Column:
    """(anchor, two_dates, window_end) of the period in which signals are looked for."""
    anchor = F.coalesce(original, store)
    return F.struct(anchor.alias("anchor"), F.coalesce(F.abs(F.date_diff(store, original)) > days, F.lit(False)).alias("two_dates"), F.add_months(anchor, months).alias("window_end"))
