"""Small helpers that every operator here shares, and where intermediate tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from launchgrid.sources.shared import written as written

TEXTS_PER_BATCH = 1000


def bounded_batches(spark: SparkSession, rows: int = TEXTS_PER_BATCH) -> None:
    """Let at most ``rows`` texts be in one Arrow batch, so a run of long ones fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
