"""Every registered query of the core against its SQL, on the smallest tables."""

import compare
import pytest
from compare import SF
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from launchgrid.plans import histories
from launchgrid.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    return compare.database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, db, name):
    assert compare.differences(QUERIES[name](spark, SF), db, ORACLES[name]) == []


def test_forecasts_are_served_by_what_the_gate_passed(spark, monkeypatch):
    monkeypatch.setattr(histories, "TREES", 4)  # for the test's run time
    gate = QUERIES["cross_validation"](spark, SF).first()
    rows = QUERIES["gbt_ordinal"](spark, SF).collect()
    assert gate.n_rows > 0 and 0 <= gate.accuracy <= 1 and gate.ci_low <= gate.improvement
    assert rows and {r.method for r in rows} == {"model" if gate.passes else "rule"} and all(0 <= r.predicted <= 3 and 0 < r.probability <= 1 for r in rows)


def test_only_what_is_served_is_worked_out(spark, monkeypatch):
    calls = []
    for name in ("wide", "forecasts"):
        monkeypatch.setattr(histories, name, lambda *a, name=name, f=getattr(histories, name): calls.append(name) or f(*a))
    monkeypatch.setattr(histories, "TREES", 1)
    for passes in (True, False):
        monkeypatch.setattr(histories, "gated", lambda m, passes=passes: m.agg(F.count("*").alias("n_rows"), F.lit(passes).alias("passes")))
        rows = QUERIES["gbt_ordinal"](spark, SF).collect()
        assert rows and {r.method for r in rows} == {"model" if passes else "rule"}
    assert calls == ["wide", "wide", "forecasts"]


def test_tiers_are_all_or_none(spark):
    rows, stats = QUERIES["kmeans_tiers"](spark, SF).collect(), QUERIES["publisher_stats"](spark, SF).collect()
    assert {r.company for r in rows} == {r.company for r in stats}
    assert {r.tier for r in rows} in ({None}, {1, 2, 3})
