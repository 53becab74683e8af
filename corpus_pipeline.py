"""From raw documents to packed training sequences, as a chain of tables.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a table
that is written as Parquet and read again as the next stage's docs. All but the last return
the columns of documents; other columns go.

Defined results: an empty table stays empty. A null or empty text is scored like any other;
what has no words is nobody's near copy; redaction leaves a null text null; packing makes it the
end id alone. Repeated rows of an id are kept or dropped together. A row whose id is null is
judged by its text, is nobody's near copy and stays, redacted and packed like the others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchgrid.llm import neardup, packing, pii, quality
from launchgrid.llm.storage import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SIMILAR = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.7 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.train(docs, labels.filter(~quality.held_out()))
    return quality.kept(docs, machine).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (0.8 of their five-word runs)."""
    return neardup.deduplicated(docs, SIMILAR).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars counted again."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_tokens),
]

#: Learnt scores, signatures and packing have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
