"""One-to-one matched controls."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchgrid.operators.running import running

PLACE_BITS = 12
FLOWS = "flow int, appid_year int, appid_tenths int, control_year int, control_tenths int, n long, appid_from long, control_from long"


@dataclass(frozen=True)
class Nearness:
    """How far a control may be, and how many points of sentiment a year counts for."""

    most_points: float = 5.0
    most_years: int = 1
    points_a_year: float = 1.0


def flows(cells: pd.DataFrame, near: Nearness) -> pd.DataFrame:
    """How many titles of which cell are paired with which: the closest cells first, as many as both still have.

    ``cells``: side (0 treated, 1 control), year, tenths, n. Equally close ones go by treated year and sentiment, then
    control year and sentiment.
    """
    left = {side: {(r.year, r.tenths): r.n for r in cells[cells.side == side].itertuples()} for side in (0, 1)}
    by_year: dict[int, list[int]] = {}
    for year, tenths in sorted(left[1]):
        by_year.setdefault(year, []).append(tenths)
    reach, year_cost = round(10 * near.most_points), round(10 * near.points_a_year)
    ways = [
        (abs(t - c) + year_cost * abs(year - other), year, t, other, c)
        for year, t in left[0]
        for other in range(year - near.most_years, year + near.most_years + 1)
        for c in by_year.get(other, ())
        if abs(t - c) <= reach
    ]
    used: tuple[dict, dict] = ({}, {})
    out = []
    for _, *key in sorted(ways):
        a, b = tuple(key[:2]), tuple(key[2:])
        n = min(left[0][a] - used[0].get(a, 0), left[1][b] - used[1].get(b, 0))
        if n > 0:
            out.append((len(out), *key, n, used[0].get(a, 0), used[1].get(b, 0)))
            used[0][a], used[1][b] = used[0].get(a, 0) + n, used[1].get(b, 0) + n
    return pd.DataFrame(out, columns=[x.split()[0] for x in FLOWS.split(", ")])


def matched_pairs(treated: DataFrame, controls: DataFrame, near: Nearness = Nearness()) -> DataFrame:
    """(appid, control, gap, years): each treated title with a control nearest in sentiment and year, one to one.

    Both sides: appid, cohort_year, positive_pct (to one decimal). Of all pairs within reach the closest is taken, then the closest of
    what is left, and so on; ties go by treated year and sentiment, control year and sentiment, and within these by
    appid. No pair of a treated title and a control is closer than the pairs that both are in. Titles without a year or
    a sentiment, and those for which nothing is left within reach, have no row.

    Titles of one year and sentiment are alike, so the matching is worked out on their counts: at most 1,001 cells
    a year and side. Each title's place in its cell (counted in two levels) then tells its flow and its partner; no candidate
    pairs of titles are made.
    """
    side = lambda df, name: df.filter("cohort_year is not null and positive_pct is not null").select(F.col("appid").cast("long").alias(name), F.col("cohort_year").cast("int").alias("year"), F.round(F.col("positive_pct") * 10).cast("int").alias("tenths"))
    left, right = side(treated, "appid"), side(controls, "control")
    counts = [df.groupBy("year", "tenths").agg(F.count("*").alias("n")).withColumn("side", F.lit(k)) for k, df in enumerate((left, right))]

    def planned(_: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        return flows(cells, near)

    plan = F.broadcast(counts[0].unionByName(counts[1]).groupBy(F.lit(0).alias("all")).applyInPandas(planned, FLOWS))  # fewer flows than cells

    def placed(df: DataFrame, name: str) -> DataFrame:
        place = running(df, ["year", "tenths"], name, F.shiftright(name, PLACE_BITS), F.lit(1)).withColumn("place", F.col("upto") - 1)
        own = plan.select("flow", F.col(f"{name}_year").alias("year"), F.col(f"{name}_tenths").alias("tenths"), "n", F.col(f"{name}_from").alias("first"))
        inside = (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n"))
        return place.join(own, ["year", "tenths"]).filter(inside).select("flow", (F.col("place") - F.col("first")).alias("k"), name, "year", "tenths")

    a, b = placed(left, "appid"), placed(right, "control").withColumnsRenamed({"year": "other_year", "tenths": "other"})
    pairs = a.join(b, ["flow", "k"])
    return pairs.select("appid", "control", (F.abs(F.col("tenths") - F.col("other")) / 10.0).alias("gap"), F.abs(F.col("year") - F.col("other_year")).alias("years"))
