"""A table of each key's last row, kept as a log that is merged when it's read.

A batch appends one delta with its own rows and nothing else. The keys' hashes are dealt into SLOTS slots, and the
table into buckets of neighbouring slots. When what deltas hold for a bucket outgrows the bucket, it is compacted: its rows and
its deltas' rows are written as a new bucket, or as several where it has grown over ``limit`` rows, so buckets split with the table.
FAN deltas of one level are folded into one of the next, so few are live at a time. A delta goes when
all buckets that it has rows of were compacted after it.

Which files are live is a small state text, put in place in one step after all files are written: a batch that
fails leaves the table as it was, a batch that runs again changes nothing. Files are removed one put after they were
superseded, for readers who have just looked.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchgrid.sources.shared import last_state, put_state, remove

SLOTS, FAN = 4096, 8
LIMIT, LEAST = 1_000_000, 10_000


def _latest(rows: DataFrame, state: dict) -> DataFrame:
    """Each key's row of the greatest ``at``, then of the last put."""
    keys = state["keys"]
    order = F.struct(state["at"], "_put") if state["at"] else F.col("_put")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def _read(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> DataFrame:
    kind = T.StructType([*schema, T.StructField("_put", T.LongType()), T.StructField("_slot", T.IntegerType())])
    return spark.read.schema(kind).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], kind)


def _counts(rows: DataFrame, by: str) -> dict[int, int]:
    """Rows by slot or bucket: at most SLOTS numbers."""
    return {r[0]: r[1] for r in rows.groupBy(by).count().collect()}


def _slots(slots) -> str:
    return hex(sum(1 << s for s in slots))


def put(rows: DataFrame, path: str, epoch: int | None, key: str, at: str | None = None, also: tuple[str, ...] = (), writer: str = "stream", limit: int = LIMIT, least: int = LEAST) -> None:
    """Put ``rows`` over the table at ``path``: a key's (and ``also``'s) row of the greatest ``at`` stays, or the one put last.

    ``epoch`` numbers a writer's batches: one that is there already is left out. One put at a time. A bucket is compacted
    when its deltas have more rows than it, and over ``least``.
    """
    spark, schema = rows.sparkSession, rows.schema
    told = last_state(spark, f"{path}/state")
    first = {"put": 0, "keys": [key, *also], "at": at, "epochs": {}, "buckets": [{"lo": 0, "hi": SLOTS, "folder": None, "rows": 0, "pending": 0, "merged": -1}], "deltas": [], "old": []}
    state = json.loads(told[1]) if told else first
    if epoch is not None and epoch <= state["epochs"].get(writer, -1):
        return
    superseded, state["old"] = state["old"], []
    state["put"] += 1
    if epoch is not None:
        state["epochs"][writer] = epoch

    name = f"delta-{uuid.uuid4().hex}"
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    own = _latest(rows.withColumns({"_put": F.lit(state["put"]).cast("long"), "_slot": slot}), state)
    own.select(*schema.names, "_put", "_slot").sortWithinPartitions("_slot").write.parquet(f"{path}/{name}")
    counts = _counts(_read(spark, path, [name], schema), "_slot")
    if counts:
        state["deltas"].append({"folder": name, "put": state["put"], "level": 0, "slots": _slots(counts)})
        for b in state["buckets"]:
            b["pending"] += sum(n for s, n in counts.items() if b["lo"] <= s < b["hi"])
    else:
        state["old"].append(name)

    _fold(spark, path, schema, state)
    _compact(spark, path, schema, state, limit, least)
    put_state(spark, f"{path}/state", json.dumps(state))
    for folder in superseded:
        remove(spark, f"{path}/{folder}")


def _fold(spark: SparkSession, path: str, schema: T.StructType, state: dict) -> None:
    level = 0
    while len(same := [d for d in state["deltas"] if d["level"] == level]) >= FAN:
        name = f"delta-{uuid.uuid4().hex}"
        _latest(_read(spark, path, [d["folder"] for d in same], schema), state).select(*schema.names, "_put", "_slot").sortWithinPartitions("_slot").write.parquet(f"{path}/{name}")
        slots = 0
        for d in same:
            slots |= int(d["slots"], 16)
        state["deltas"] = [d for d in state["deltas"] if d not in same] + [{"folder": name, "put": max(d["put"] for d in same), "level": level + 1, "slots": hex(slots)}]
        state["old"] += [d["folder"] for d in same]
        level += 1


def _compact(spark: SparkSession, path: str, schema: T.StructType, state: dict, limit: int, least: int) -> None:
    due = [b for b in state["buckets"] if b["pending"] > max(b["rows"], least)]
    if due:
        name, placed, made = f"bucket-{uuid.uuid4().hex}", [], []
        for b in due:
            parts = 1
            while parts < b["hi"] - b["lo"] and b["rows"] + b["pending"] > parts * limit:
                parts *= 2
            width = -(-(b["hi"] - b["lo"]) // parts)
            for lo in range(b["lo"], b["hi"], width):
                made.append((lo, min(lo + width, b["hi"])))
                placed += [(s, lo) for s in range(*made[-1])]
        rows = _read(spark, path, [b["folder"] for b in due if b["folder"]] + [d["folder"] for d in state["deltas"]], schema)
        where = F.broadcast(spark.createDataFrame(placed, "_slot int, _bucket int"))  # at most SLOTS rows
        whole = _latest(rows.join(where, "_slot"), state)
        whole.select(*schema.names, "_put", "_slot", "_bucket").repartition("_bucket").sortWithinPartitions("_slot").write.partitionBy("_bucket").parquet(f"{path}/{name}")
        counts = _counts(spark.read.parquet(f"{path}/{name}"), "_bucket")
        state["old"] += [b["folder"] for b in due if b["folder"]]
        new = [{"lo": lo, "hi": hi, "folder": f"{name}/_bucket={lo}" if lo in counts else None, "rows": counts.get(lo, 0), "pending": 0, "merged": state["put"]} for lo, hi in made]
        state["buckets"] = sorted([b for b in state["buckets"] if b not in due] + new, key=lambda b: b["lo"])
    live = []
    for d in state["deltas"]:
        slots = int(d["slots"], 16)
        behind = any(b["merged"] < d["put"] and slots >> b["lo"] & ((1 << b["hi"] - b["lo"]) - 1) for b in state["buckets"])
        (live if behind else state["old"]).append(d if behind else d["folder"])
    state["deltas"] = live


def current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``put`` keeps, as of the newest state: buckets, with the live deltas put over them."""
    told = last_state(spark, f"{path}/state")
    if told is None:
        return spark.createDataFrame([], schema)
    state = json.loads(told[1])
    rows = _read(spark, path, [b["folder"] for b in state["buckets"] if b["folder"]] + [d["folder"] for d in state["deltas"]], schema)
    return (_latest(rows, state) if state["deltas"] else rows).select(*schema.names)
