"""Small tables with what operators must bear: nulls, empties, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

TEXTS = ["plain words here and there and so on", None, "", "   \n\t ", "one", "Émile's 12 naïve 😀 cafés!!", "a" * 3000, "word " * 4000, "plain words here and there and so on"]


def odd_documents(spark):
    """Columns beside doc_id and text carry names that operators use for their own."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "   \n\t "), (None, "no id at all, yet some text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "ids", "score", "spans", "keys", "n", "rep", "band", "lang", "source", "v", "label", "_id", "same")})


def no_documents(spark):
    return odd_documents(spark).limit(0)
