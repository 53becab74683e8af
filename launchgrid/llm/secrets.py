"""Secrets in every version of every document, each distinct blob scanned once per rule set.

The ledger is keyed by content: a version's blob id is the SHA-256 of its bytes. A run
scans the blobs that the ledger has not seen under the current rule version, once
however many paths hold them, adds what it found (also "nothing") to the ledger, and joins
findings back to all paths. The rule version is a digest of the rules themselves.

A ledger lives in a folder that outlasts the run: the one the session names in
``launchgrid.secrets.ledger``, or given to ``ledger_findings``. Runs append to it; two runs at once may
both scan a blob, which changes no result. Without one, a run starts from nothing.

Base kinds are those of the fixed patterns below. The added kinds: ``pem`` (private key
blocks), ``jwt`` (three base64url parts), ``url`` (a password in a connection address).

Defined results: a null text is the empty blob, with no findings; repeated rows are paths of
one blob; rows with a null id have their findings as all others; an empty table gives no rows.
Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchgrid.llm.storage import bounded_batches, written

# The base patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

# The added kinds.
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}")
URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:([^\s:/@]{3,200})@")
KINDS = ("assign", "access", "hex", "pem", "jwt", "url")
RULE_VERSION = hashlib.sha256(repr([KINDS, LEAST, *((p.pattern, p.flags) for p in (ASSIGN, ACCESS, HEX, PEM, JWT, URL))]).encode()).hexdigest()[:16]
LEDGER = "launchgrid.secrets.ledger"
LEDGER_ROWS = "blob string, rule_version string, findings array<struct<kind: string, start: long, end: long>>"

_HINT = re.compile(r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|-----BEGIN|eyJ|://")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each finding, by start and then kind as listed; code points."""
    if not _HINT.search(text):
        return []
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    for kind, pattern in (("pem", PEM), ("jwt", JWT), ("url", URL)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan_blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), f, strict=True)) for f in scan(t.as_py() or "")] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], names=["blob", "findings"])


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, findings) for what ``ledger`` lacks.

    ``versions`` has path (or null), blob and text. The first path of each unseen blob
    stands for it, null where it has no other; texts move once, dealt by path and blob, so no
    blob's copies meet in one task, and neither do the rows without a path.
    """
    first = versions.groupBy("blob").agg(F.min("path").alias("first"))
    if ledger is not None:
        first = first.join(ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    asked = versions.join(first.select("first", F.col("blob").alias("of")).hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("of")), "left_semi")
    found = asked.select("blob", "text").mapInArrow(_scan_blobs, "blob string, findings array<struct<kind: string, start: long, end: long>>")
    return found.dropDuplicates(["blob"]).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def _joined(versions: DataFrame, whole: DataFrame, rule_version: str, id_col: str) -> DataFrame:
    """Each path's findings under a rule version, from the whole ledger."""
    hits = whole.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).dropDuplicates(["blob"]).select("blob", "findings")
    out = versions.select("path", "blob").join(hits, "blob", "left")
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    return out.select(F.col("path").alias(id_col), "blob", F.coalesce("findings", none).alias("findings"))


def secrets(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings per row: id, blob, findings; the whole ledger after this run)."""
    versions = _versions(docs, id_col, text_col)
    new = written(scan_unseen(versions, ledger, rule_version), "ledger")
    whole = new if ledger is None else new.unionByName(ledger.select("blob", "rule_version", "findings"))
    return _joined(versions, whole, rule_version, id_col), whole


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None where no run has written one yet."""
    try:
        return spark.read.schema(LEDGER_ROWS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def ledger_findings(docs: DataFrame, path: str, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(findings per row, how many blobs this run had to scan), with the ledger kept at ``path``."""
    spark = docs.sparkSession
    versions = _versions(docs, id_col, text_col)
    new = written(scan_unseen(versions, read_ledger(spark, path), rule_version), "unseen")
    scanned = new.count()
    new.write.mode("append").parquet(path)
    return _joined(versions, read_ledger(spark, path), rule_version, id_col), scanned


def span_text(spans: F.Column) -> F.Column:
    """kind:start:end joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of base spans, and all spans."""
    path = docs.sparkSession.conf.get(LEDGER, None)
    found = ledger_findings(docs, path)[0] if path else secrets(docs)[0]
    base = F.filter("findings", lambda s: s["kind"].isin(*LEAST))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in LEAST]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"))
