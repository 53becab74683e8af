"""Column functions on cases worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from launchgrid.functions import dates, measures, rubric, text
from launchgrid.operators.forecast import assert_no_leakage
from launchgrid.schemas import FEATURES

D = datetime.date


def values(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").select("x").collect()]


def test_company_names(spark):
    given = ["SEGA (Japan)", "CAPCOM Co., Ltd.", "FromSoftware, Inc.", "PlayStation Publishing LLC (excluding China)", "WB Games", "Ubisoft Entertainment", "Feral Interactive (Mac)", "Aspyr (Linux)", "Nixxes Software", "", "(Japan)", None]
    want = ["SEGA", "CAPCOM", "FromSoftware", "PlayStation Publishing", "Warner Bros. Games", "Ubisoft", None, None, None, None, None, None]
    assert values(spark, text.company(F.col("n")), given, "n string") == want


def test_company_lists(spark):
    assert values(spark, text.companies(F.col("n")), ["SEGA\nSEGA (Japan)\nFeral Interactive (Mac)", None, ""], "n string") == [["SEGA"], [], []]


def test_loose_dates(spark):
    given = ["Oct 26, 2018", "26 Oct, 2018", "October 26, 2018", "Nov 2026", "2026", "Q1 2027", "Q4 2026", "Coming soon", "To be announced", "", None]
    want = [D(2018, 10, 26)] * 3 + [D(2026, 11, 1), D(2026, 1, 1), D(2027, 1, 1), D(2026, 10, 1), None, None, None, None]
    assert values(spark, dates.loose_date(F.col("r")), given, "r string") == want


def test_launch_types(spark):
    base = D(2020, 6, 15)
    gaps = [0, 2, 7, 8, 13, -3, -365, None]
    rows = [(base + datetime.timedelta(g), base) if g is not None else (None, base) for g in gaps]
    got = values(spark, dates.launch_type(F.col("s"), F.col("o")), rows, "s date, o date")
    assert got == ["day_one_steam"] * 3 + ["delayed_port"] * 2 + ["day_one_steam", "unknown", "unknown"]


def test_shares_and_ratios(spark):
    assert values(spark, measures.positive_share(F.col("p"), F.col("t")), [(84213, 96257), (0, 0), (None, 5), (1, None)], "p long, t long") == [87.5, None, 0.0, None]
    assert values(spark, measures.retention(F.col("l"), F.col("f")), [(30, 10), (0, 10), (5, 0), (None, 5)], "l long, f long") == [3.0, None, None, None]
    assert values(spark, measures.relative_price(F.col("c"), F.col("r")), [(7000, 7000), (4000, 7000), (8000, 7000), (0, 7000), (None, 7000)], "c int, r int") == [1.0, 0.571, 1.143, None, None]


def test_ordinals_do_not_round_onto_the_floor(spark):
    assert values(spark, text.ordinal(F.col("v"), 35.0), [22.0, 13.0, 1.0, 34.6, 102.0, 3.4], "v double") == ["22nd", "13th", "1st", "34.6th", "102nd", "3rd"]
    assert values(spark, text.percent(F.col("v"), 78.0), [77.6, 60.2], "v double") == ["77.6", "60"]


BASE = (60.0, 85.0, 1.5, "continued", "sustained")


@pytest.mark.parametrize(
    ("change", "outcome", "confidence"),
    [
        ({}, "success", "medium"), ({0: 95.0}, "breakout", "high"), ({0: 85.0, 2: 2.0}, "breakout", "high"), ({4: "unknown"}, "success", "low"), ({4: "abandoned"}, "success", "low"),
        ({1: 70.0}, "underperform", "high"), ({1: 70.0, 3: "closed"}, "flop", "high"), ({1: 70.0, 4: "abandoned"}, "flop", "high"), ({1: 70.0, 3: "severe_layoffs", 4: "curtailed"}, "flop", "medium"),
        ({1: 70.0, 3: "severe_layoffs"}, "underperform", "medium"), ({1: 70.0, 3: "unknown", 4: "unknown"}, None, "none"), ({0: 20.0}, "underperform", "high"), ({0: 86.0, 1: 75.0, 2: 2.6}, "breakout", "high"),
        ({1: None}, "underperform", "high"), ({0: None}, None, "none"),
    ],
)
def test_rubric(spark, change, outcome, confidence):
    row = tuple(change.get(i, v) for i, v in enumerate(BASE))
    c = rubric.classify(*(F.col(n) for n in "psrud"), F.lit(True))
    got = values(spark, c, [row], "p double, s double, r double, u string, d string")[0]
    assert (got.outcome, got.confidence) == (outcome, confidence)
    assert (len(got.reasons) == 2) == (outcome is not None)


def test_recombination_sums_to_one(spark):
    got = values(spark, measures.recombined(F.col("a")), [[0.9, 0.5, 0.2], [0.2, 0.5, 0.9]], "a array<double>")
    assert got[0] == pytest.approx([0.1, 0.4, 0.3, 0.2])
    assert sum(got[1]) == pytest.approx(1) and min(got[1]) > 0


def test_lifecycle_only_moves_forward(spark):
    rows = [(None, True), (None, False), ("pre_launch", False), ("tracking", True), ("resolved", True)]
    assert values(spark, measures.next_lifecycle(F.col("s"), F.col("c")), rows, "s string, c boolean") == ["pre_launch", "tracking", "tracking", "tracking", "resolved"]


def test_leakage_guard():
    assert_no_leakage(list(FEATURES))
    with pytest.raises(AssertionError, match="metacritic_score, review_total"):
        assert_no_leakage(["review_total", "release_month", "metacritic_score"])
