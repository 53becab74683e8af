"""Where intermediate tables go."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on one
    machine, as in tests, a new temporary folder is made and set as checkpoint folder.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"name a folder that all executors share in {CHECKPOINT_DIR}")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: later jobs read files that outlive any executor. The table stays
    until the folder is cleared, like a checkpoint without a cleaner.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder in any store that Spark can write; whether it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def put_state(spark: SparkSession, folder: str, text: str) -> int:
    """Put a small text in place as the folder's newest state, in one step; its number.

    States are numbered files that are never changed. One is written beside and then renamed, which a reader sees
    wholly or not at all. Of two writers at once one fails, as a number is given once.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(top)
    number = max([-1, *_states(store, top)]) + 1
    beside = hadoop.Path(top, f"_writing-{uuid.uuid4().hex}")
    out = store.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not store.rename(beside, hadoop.Path(top, f"{number:012d}")):
        store.delete(beside, False)
        raise RuntimeError(f"state {number} of {folder} is there already")
    return number


def last_state(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(number, text) of the newest state; None where there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(top) or not (numbers := _states(store, top)):
        return None
    number = max(numbers)
    return number, spark.read.text(f"{folder}/{number:012d}", wholetext=True).first().value


def _states(store, top) -> list[int]:
    return [int(f.getPath().getName()) for f in store.listStatus(top) if f.getPath().getName().isdigit()]


def partitions(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """The values of a table's one partition column, each with a mark that changes when its files do; no data is read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for folder in store.listStatus(top) if store.exists(top) else ():
        name, _, value = folder.getPath().getName().partition("=")
        if name == column:
            files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(folder.getPath()))
            out[value] = hashlib.sha256(repr(files).encode()).hexdigest()[:16]
    return out
