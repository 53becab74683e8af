"""Table schemas, ordered enumerations and rule parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The enumerations, in order where there is one.
OUTCOMES = ("flop", "underperform", "success", "breakout")
LAUNCH_TYPES = ("day_one_steam", "delayed_port", "former_exclusive", "unknown")
BUDGETS = ("aaa", "aa_leaning_aaa", "unknown")
CONFIDENCES = ("high", "medium", "low")
RESEARCH = ("not_researched", "researched", "unresolvable")
STUDIO = ("grew", "continued", "severe_layoffs", "closed", "unknown")
SUPPORT = ("sustained", "curtailed", "abandoned", "unknown")
DEMO_TIMINGS = ("pre_launch", "launch_window", "post_launch", "none_listed", "unknown")
LIFECYCLES = ("pre_launch", "tracking", "failed_to_meet_expectations", "resolved", "unresolved_insufficient_data")
WINDOW_KEYS = ("launch_2w", "launch_1m", "launch_3m", "lifetime")
OUT_OF_SCOPE_GENRES = ("Massively Multiplayer",)
DAY_ONE = LAUNCH_TYPES[0]

# The model's inputs, in order, and what may never be one.
FEATURES = (
    "publisher_mean_volume_pct", "publisher_mean_positive_pct", "publisher_title_count", "publisher_known",
    "price_vs_going_rate", "launch_price_usd", "budget_tier_aaa", "platform_count", "has_prelaunch_demo",
    "launch_day_dlc_count", "release_month", "cohort_year",
)
POST_LAUNCH = frozenset((
    "review_total", "review_positive", "review_negative", "positive_pct", "review_score_desc", "volume_percentile", "retention_ratio",
    "peak_concurrent_players", "studio_signal", "support_signal", "studio_outcome", "post_launch_support", "post_launch_dlc_count",
    "last_dlc_days_after_launch", "resolved_outcome", "label_confidence", "metacritic_score",
))

# The columns of a curated file, in order.
CURATED_COLUMNS = (
    "steam_appid", "game_name", "original_release_date", "platform_launch_type", "platform_reach", "budget_tier",
    "launch_price_usd", "post_launch_support", "studio_outcome", "studio_signal", "support_signal",
    "resolved_outcome", "label_confidence", "research_status", "notes", "sources",
)


@dataclass(frozen=True)
class Rubric:
    """Bars of the outcome rules."""

    sentiment: float = 78.0
    volume_floor: float = 35.0
    retention_strong: float = 2.5
    retention_sustained: float = 2.0
    momentum_volume: float = 85.0
    breakout: float = 90.0
    breakout_with_momentum: float = 80.0


@dataclass(frozen=True)
class Cohort:
    """Years pooled on each side, and the fewest members of a reliable cohort."""

    span: int = 1
    least: int = 8


@dataclass(frozen=True)
class Windows:
    """Days after launch of the three windows."""

    first: int = 14
    second: int = 30
    third: int = 90


_OFFER = T.StructType([T.StructField("currency", T.StringType()), T.StructField("initial", T.IntegerType()), T.StructField("final", T.IntegerType()), T.StructField("discount_percent", T.IntegerType())])
_NAMED = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("description", T.StringType())]))
APP_DATA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("steam_appid", T.LongType()), T.StructField("is_free", T.BooleanType()),
    T.StructField("short_description", T.StringType()), T.StructField("header_image", T.StringType()),
    T.StructField("developers", T.ArrayType(T.StringType())), T.StructField("publishers", T.ArrayType(T.StringType())), T.StructField("price_overview", _OFFER),
    T.StructField("platforms", T.StructType([T.StructField(p, T.BooleanType()) for p in ("windows", "mac", "linux")])),
    T.StructField("metacritic", T.StructType([T.StructField("score", T.IntegerType()), T.StructField("url", T.StringType())])),
    T.StructField("genres", _NAMED), T.StructField("categories", _NAMED), T.StructField("dlc", T.ArrayType(T.LongType())),
    T.StructField("demos", T.ArrayType(T.StructType([T.StructField("appid", T.StringType())]))),
    T.StructField("release_date", T.StructType([T.StructField("coming_soon", T.BooleanType()), T.StructField("date", T.StringType())])),
])
APP_DETAILS = T.MapType(T.StringType(), T.StructType([T.StructField("success", T.BooleanType()), T.StructField("data", APP_DATA)]))
REVIEWS = T.StructType([T.StructField("success", T.IntegerType()), T.StructField("query_summary", T.StructType([T.StructField(f, T.LongType()) for f in ("total_reviews", "total_positive", "total_negative")] + [T.StructField("review_score_desc", T.StringType())]))])
PLAYERS = T.StructType([T.StructField("response", T.StructType([T.StructField("player_count", T.LongType()), T.StructField("result", T.IntegerType())]))])
_VALUE = T.StructType([T.StructField("value", T.StringType())])
BINDINGS = T.StructType([T.StructField("results", T.StructType([T.StructField("bindings", T.ArrayType(T.StructType([T.StructField(f, _VALUE) for f in ("appid", "item", "date", "precision", "rank", "award", "when", "won", "units")])))]))])
DRAFT = T.StructType([T.StructField(f, T.StringType()) for f in ("studio_signal", "support_signal", "studio_evidence", "support_evidence")] + [T.StructField("sources", T.ArrayType(T.StringType()))] + [T.StructField(f, T.StringType()) for f in ("confidence", "alternative_reading", "reviewer_note")])
