"""Curated files and plain tables: strict reading, resumable review files, JSON reports."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchgrid.functions.measures import to_cents
from launchgrid.operators.quality import missing_columns, violations
from launchgrid.schemas import CURATED_COLUMNS

PROVENANCE = "knowledge-base"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A curated table's columns as trimmed text, null where empty, with its file and the row's number in it.

    ``path`` may be a file, a folder or a pattern; each file has a header. Raises if one lacks columns. As a reader of one
    file numbers them, the first row after the header is 2 and blank lines don't count; cells may hold line ends.

    Files are read in splits, as text. A line opens a row if the quotes before it in its file are even; quotes and
    rows are counted in each split, and the few splits of a file summed up in order, so numbers hold for any splits.
    """
    at = F.monotonically_increasing_id().alias("at")  # grows within a split
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), at)
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "split").orderBy("at")
    sums = lines.groupBy("file", "split").agg(F.sum("quotes").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("open"))
    earlier = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("own", earlier).join(sums, ["file", "split"]).withColumn("even", (F.col("own") + F.col("open")) % 2 == 0)
    lines = lines.filter(~F.col("even") | (F.trim("value") != "")).withColumn("opens", F.col("even").cast("long"))
    starts = lines.groupBy("file", "split").agg(F.sum("opens").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows"))
    own = F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.withColumn("own", own).join(starts, ["file", "split"]).withColumn("line", F.col("own") + F.col("rows"))
    told = F.array_sort(F.collect_list(F.struct("split", "at", "value")))
    rows = numbered.groupBy("file", "line").agg(F.array_join(F.transform(told, lambda x: x["value"]), "\n").alias("text"))
    heads = rows.filter("line = 1").select("file", "text").collect()  # one a file
    out = None
    for header, files in _by_header(heads).items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        if missing := missing_columns(spark.createDataFrame([], schema)):
            raise ValueError(f"missing columns: {', '.join(missing)}")
        parsed = rows.filter((F.col("line") > 1) & F.col("file").isin(*files)).select("file", "line", F.from_csv("text", F.lit(schema.simpleString()), {"quote": '"', "escape": '"'}).alias("r"))
        cells = [F.nullif(F.trim(F.col(f"r.{c}")), F.lit("")).alias(c) for c in CURATED_COLUMNS]
        part = parsed.select(*cells, "line", "file")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"missing columns: {', '.join(CURATED_COLUMNS)}")
    return out


def _by_header(heads: list) -> dict[tuple[str, ...], list[str]]:
    """The files of each header, as the same CSV rules read it."""
    out: dict[tuple[str, ...], list[str]] = {}
    for r in heads:
        cells = next(csv.reader([r.text.removeprefix("\ufeff")]))
        out.setdefault(tuple(c.strip() for c in cells), []).append(r.file)
    return out


def load(spark: SparkSession, path: str) -> DataFrame:
    """The typed curated table; raises with the first violations if there are any."""
    text = read_text(spark, path)
    wrong = violations(text).orderBy("line", "rule").limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"line {w.line}: {w.rule} {w.detail}" for w in wrong))
    filled = {"budget_tier": "unknown", "studio_signal": "unknown", "support_signal": "unknown", "research_status": "not_researched"}
    typed = text.select(
        F.col("steam_appid").cast("bigint").alias("steam_appid"), "game_name", F.to_date("original_release_date").alias("original_release_date"), to_cents(F.col("launch_price_usd")).alias("launch_price_cents"),
        *(F.coalesce(c, F.lit(filled[c])).alias(c) if c in filled else F.col(c) for c in CURATED_COLUMNS if c not in ("steam_appid", "game_name", "original_release_date", "launch_price_usd")),
    )
    return typed


def merged_proposals(prior: DataFrame, new: DataFrame, key: str = "appid") -> DataFrame:
    """Rows of a review file after a run: new rows replace those of their key, others stay; rows
    without a whole-number key are left out; in order of the key."""
    both = prior.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    usable = both.filter(F.col(key).cast("string").try_cast("bigint").isNotNull())
    ranked = usable.withColumn("_k", F.row_number().over(Window.partitionBy(F.col(key).cast("string").try_cast("bigint")).orderBy("_age")))
    return ranked.filter("_k = 1").drop("_age", "_k").orderBy(F.col(key).cast("string").try_cast("bigint"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file, by one task: review files are read by people, so they have some thousand rows at most."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def with_dates(curated: DataFrame, updates: DataFrame, tag: str = PROVENANCE) -> DataFrame:
    """Curated rows with looked-up original dates and where they come from; other columns stay.

    ``updates``: steam_appid, found_date.
    """
    both = curated.join(updates.select("steam_appid", "found_date"), "steam_appid", "left")
    had = F.coalesce("sources", F.lit(""))
    tagged = F.when(F.col("found_date").isNull() | F.contains(had, F.lit(tag)), F.col("sources")).otherwise(F.concat_ws(" / ", F.nullif(had, F.lit("")), F.lit(tag)))
    return both.withColumn("sources", tagged).withColumn("original_release_date", F.coalesce("found_date", "original_release_date")).select(*curated.columns)


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8) -> DataFrame:
    """A relational table, in parallel by ranges of a whole-number key if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000) -> None:
    """Rows put into a relational table, a connection a partition."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).mode(mode).save()


def as_json(report: DataFrame) -> DataFrame:
    """Each row of a report as one JSON text."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` cast to ``schema``'s columns in order; missing ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
