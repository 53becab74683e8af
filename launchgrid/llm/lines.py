"""Line deduplication over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by the 128-bit hash of a line's key: how many documents
of its batches hold the key, and the largest id among them. A new batch is summed by
hash once, merge-anti-joins every run (bucket by bucket, so no run is moved again) and becomes a run
itself, of keys that no run has (``fresh``) and of further counts for keys that one has. Two runs of
one level are merged into one of the next, so n batches leave at most log2(n) + 1 runs and a
hash is rewritten as often at most.

Batches may come in any order and on different days: ``Runs`` on a named folder goes on
where an earlier session stopped.

A key is a line without white space at both ends, A-Z lower-cased. Defined results: a null or
empty text is one empty line; a row without an id counts for nothing and keeps all its lines;
rows of one id are one document, each row loses the lines that the document loses; an empty table gives
no rows. Columns of the input stay, whatever their names.
"""

from __future__ import annotations

import json
import string
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchgrid.llm.storage import bounded_batches, fresh, written
from launchgrid.sources.shared import new_folder, remove

BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
BATCHES = 4


def line_key(line: F.Column) -> F.Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def hashed(docs: DataFrame, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tid, pos, h1, h2) of each line whose key has ``least_chars`` code points, of rows with an id.

    ``tid`` is the text's hash, ``pos`` the line's place from 0.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text"))
    lines = rows.select("id", "tid", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("id", "tid", "pos", line_key(F.col("line")).alias("key"))
    return lines.filter(F.char_length("key") >= least_chars).select("id", "tid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """The levelled runs of one folder (a new one unless named).

    ``levels`` is a list of levels, each a list of run names. The manifest, one JSON file a version, is
    written after the run it names, so a session that fails in between leaves the runs as they were.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_folder(spark, "line_runs")
        self.levels: list[list[str]] = []
        self.version, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        try:
            last = spark.read.schema("version long, state string").json(f"{self.folder}/manifest").orderBy(F.desc("version")).first() if folder else None
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last:
            state = json.loads(last.state)
            self.version, self.levels, self.buckets = last.version, state["levels"], state["buckets"]

    def table(self, name: str) -> DataFrame:
        """A run; its table is declared anew where this session has not seen it."""
        if not self.spark.catalog.tableExists(name):
            columns = "h1 BIGINT, h2 BIGINT, n BIGINT, keeper BIGINT, fresh BOOLEAN"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.select("h1", "h2", "n", "keeper", "fresh").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def add(self, lines: DataFrame) -> None:
        """One batch of (id, h1, h2): anti-joined to the runs, then one of them."""
        own = lines.groupBy(*KEY).agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper"))
        seen = F.lit(False)
        for k, name in enumerate(name for level in self.levels for name in level):
            known = self.table(name).filter("fresh").select(*KEY, F.lit(True).alias(f"in{k}"))
            own, seen = own.join(known.hint("merge"), KEY, "left"), seen | F.coalesce(F.col(f"in{k}"), F.lit(False))
        added, spent, level = self._write(own.withColumn("fresh", ~seen)), [], 0
        while level < len(self.levels) and self.levels[level]:
            older = self.levels[level].pop()
            merged = self._write(self._merged(self.table(older), self.table(added)))
            spent += [older, added]
            added, level = merged, level + 1
        self.levels += [[]] * (level + 1 - len(self.levels))
        self.levels[level] = [added]
        self._commit()
        for name in spent:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{self.folder}/{name}")

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.alias("a").join(b.alias("b").hint("merge"), KEY, "full")
        total = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        return both.select(*KEY, total.alias("n"), F.greatest("a.keeper", "b.keeper").alias("keeper"), (F.coalesce("a.fresh", F.lit(False)) | F.coalesce("b.fresh", F.lit(False))).alias("fresh"))

    def _commit(self) -> None:
        self.version += 1
        state = json.dumps({"levels": self.levels, "buckets": self.buckets})
        self.spark.createDataFrame([(self.version, state)], "version long, state string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def frequent(self, at_least: int) -> DataFrame:
        """(h1, h2, keeper) of keys that ``at_least`` documents hold. An id counts once a batch that has it."""
        names = [name for level in self.levels for name in level]
        rows = self.table(names[0]) if names else self.spark.createDataFrame([], "h1 long, h2 long, n long, keeper long, fresh boolean")
        for name in names[1:]:
            rows = self._merged(rows, self.table(name))
        return rows.filter(F.col("n") >= at_least).select(*KEY, "keeper")


def batches(lines: DataFrame, n: int) -> list[DataFrame]:
    """``lines`` by ranges of ids, the largest ids first, so that few later lines move a keeper."""
    cuts = sorted(set(lines.approxQuantile("id", [k / n for k in range(1, n)], 0.01)), reverse=True)
    out, above = [], None
    for cut in cuts:
        out.append(lines.filter(F.col("id") > cut if above is None else (F.col("id") > cut) & (F.col("id") <= above)))
        above = cut
    return [*out, lines if above is None else lines.filter(F.col("id") <= above)]


def repeated(docs: DataFrame, at_least: int = 5, least_chars: int = 40, n_batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tid, places): the lines that each text loses. A line is read once; then only hashes move."""
    lines = written(hashed(docs, least_chars, id_col, text_col), "lines")
    runs = Runs(docs.sparkSession)
    for batch in batches(lines, n_batches):
        runs.add(batch)
    frequent = written(runs.frequent(at_least), "frequent_lines")
    hits = lines.join(frequent, KEY).filter("id < keeper")
    return hits.select("id", "tid", "pos").distinct().groupBy("id", "tid").agg(F.collect_list("pos").alias("places"))


def _keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last four columns are text, places, and room for the two counts."""
    for batch in batches:
        *own, text, places, all_lines, gone = range(batch.num_columns)
        kept, n, dropped = [], [], []
        for t, out in zip(batch.column(text).to_pylist(), batch.column(places).to_pylist(), strict=True):
            split, out = (t or "").split("\n"), set(out or ())
            n.append(len(split))
            dropped.append(len(out))
            kept.append("\n".join(line for k, line in enumerate(split) if k not in out) if out else t)
        columns = [*(batch.column(k) for k in own), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[k] for k in own), *(batch.schema.names[k] for k in (text, all_lines, gone))])


def deduplicated(docs: DataFrame, at_least: int = 5, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without lines that ``at_least`` documents hold, but in the largest id of these; n_lines, n_dropped beside."""
    bounded_batches(docs.sparkSession)
    drops = written(repeated(docs, at_least, least_chars, id_col=id_col, text_col=text_col), "line_places")
    gid, gtid, places, n_lines, n_dropped = fresh(docs, "line_id", "line_tid", "places", "n_lines", "n_dropped")
    drops = drops.select(F.col("id").alias(gid), F.col("tid").alias(gtid), F.col("places").alias(places))
    both = docs.join(drops, (F.col(id_col).cast("long") == F.col(gid)) & (F.xxhash64(text_col) == F.col(gtid)), "left")
    rest = [c for c in docs.columns if c != text_col]
    asked = both.select(*rest, text_col, places, F.lit(0).alias(n_lines), F.lit(0).alias(n_dropped))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*rest, text_col])
    return asked.mapInArrow(_keep, f"{kinds}, `{n_lines}` long, `{n_dropped}` long")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: lines, how many of them went, and the digest of the rest."""
    kept = deduplicated(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
