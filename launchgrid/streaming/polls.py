"""Tracked titles as a stream: deduplicated polls, date changes, lifecycle, rollups, upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from launchgrid.operators.snapshots import described_changes
from launchgrid.schemas import WINDOW_KEYS, Windows
from launchgrid.sources.shared import new_folder
from launchgrid.streaming.upserts import put

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_polls(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files that a poller lands, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def distinct_polls(polls: DataFrame, late: str = "1 day") -> DataFrame:
    """One row per title and capture time, however often it was landed, within ``late``."""
    return polls.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["appid", "captured_at"])


def _changes(key: tuple, polls: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds a title's polls back until the watermark has passed them, then compares them in order of capture.

    State: the waiting polls, one a capture time (microseconds), and the last poll that was let through, with its text. It is read and
    written once a batch, and wakes up for the earliest waiting poll.
    """
    at, raw, last, before = state.get if state.exists else ([], [], None, None)
    waiting = dict(zip(at, raw, strict=True))
    for batch in polls:
        for t, text in zip(batch["captured_at"].astype("datetime64[us]").astype("int64"), batch["raw"], strict=True):
            if last is None or t > last:  # else the same poll again
                waiting[int(t)] = None if pd.isna(text) else text
    mark, out = state.getCurrentWatermarkMs(), []
    for t in sorted(t for t in waiting if t // 1000 < mark):
        text = waiting.pop(t)
        if before is not None and text != before:
            out.append((key[0], t, before, text))
        last, before = t, text
    state.update((list(waiting), list(waiting.values()), last, before))
    if waiting:
        state.setTimeoutTimestamp(max(1, min(waiting) // 1000))
    if out:
        events = pd.DataFrame(out, columns=["appid", "observed_at", "previous_raw", "new_raw"])
        yield events.assign(observed_at=pd.to_datetime(events.observed_at, unit="us"))


def date_changes(polls: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream twin of snapshots.date_changes: one event per change of the announced date.

    Polls may land in any order within ``late``: a title's are held until the watermark has passed them, and then
    compared in order of capture, so events are those of the batch job up to the watermark. A later poll than ``late``
    still counts until a newer one of its title is let through; then it is dropped. Needs UTC as the session's time zone; with the
    RocksDB state store provider (ROCKSDB) state needn't fit the memory.
    """
    slim = polls.select("appid", F.col("captured_at").cast("timestamp").alias("captured_at"), "raw").withWatermark("captured_at", late)
    kinds = "appid long, observed_at timestamp, previous_raw string, new_raw string", "at array<long>, raw array<string>, last long, before string"
    changes = slim.groupBy("appid").applyInPandasWithState(_changes, *kinds, outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)
    return described_changes(changes)


class _Lifecycle(StatefulProcessor):
    """Keeps each title's state, which only moves forward, and its first prediction."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, predicted string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, predicted = self.now.get() if self.now.exists() else (None, None)
        out, earliest = state is not None and state != "pre_launch", None
        for batch in rows:  # of a batch only what it leads to is kept
            out = out or not batch.coming_soon.all()
            if predicted is None and len(told := batch.dropna(subset="predicted")):
                first = told.loc[told.captured_at.idxmin()]
                if earliest is None or first.captured_at < earliest[0]:
                    earliest = (first.captured_at, first.predicted)
        state = (state or "tracking" if state != "pre_launch" else "tracking") if out else "pre_launch"
        predicted = earliest[1] if earliest else predicted
        self.now.update((state, predicted))
        yield pd.DataFrame({"appid": [key[0]], "state": [state], "predicted": [predicted]})

    def close(self) -> None:
        pass


def lifecycle(polls: DataFrame) -> DataFrame:
    """(appid, state, predicted) after each batch that has polls of the title.

    ``polls``: appid, captured_at, coming_soon, predicted (null but when a forecast is made).
    """
    slim = polls.select("appid", "captured_at", "coming_soon", "predicted")
    return slim.groupBy("appid").transformWithStateInPandas(_Lifecycle(), outputStructType="appid long, state string, predicted string", outputMode="Update", timeMode="None")


def daily_rollup(polls: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Closed days only: (appid, day, polls, peak_players, sum_players).

    ``late`` is None for a stream that has its watermark already.
    """
    w = F.window("captured_at", "1 day")
    marked = polls.withWatermark("captured_at", late) if late else polls
    out = marked.groupBy(w, "appid").agg(F.count("*").alias("polls"), F.max("players").alias("peak_players"), F.sum("players").alias("sum_players"))
    return out.select("appid", F.to_date("window.start").alias("day"), "polls", "peak_players", "sum_players")


WINDOW_ROW = "appid long, window_key string, window_end timestamp, review_total long, review_positive long"


def launch_windows(reviews: DataFrame, starts: DataFrame, windows: Windows = Windows(), late: str = "1 day") -> DataFrame:
    """(appid, window_key, window_end, review_total, review_positive): each title's launch windows, each
    given once, when it has fully elapsed; never a window that still runs. A title without reviews has windows of nought.

    ``reviews``: appid, at, weight, positive (weight of the positive ones), a stream; ``starts``: appid, start (timestamp, one
    a title), a static table. A review opens a session that lasts until its window's end, so a title's reviews of a window are one
    session, which goes out when the watermark has passed that end. The starts are written once and read as a stream of
    reviews without weight, so silent titles have sessions too; a run that goes on reads its starts anew, which adds nought, and
    takes in those announced since. State is a row of sums per title and window that still runs; reviews outside the longest
    window are left out before. Reviews of a window that was given are late: replaced_windows makes good for them, and
    for windows that had elapsed when their start was announced. Needs UTC as the session's time zone; with the RocksDB
    state store provider (ROCKSDB) state needn't fit the memory.
    """
    spark, folder = reviews.sparkSession, new_folder(reviews.sparkSession, "starts")
    starts.filter("appid is not null and start is not null").select("appid", "start").write.parquet(folder)
    starts = spark.read.parquet(folder)
    begun = spark.readStream.schema(starts.schema).parquet(folder).select("appid", F.col("start").alias("at"), "start", F.lit(0).alias("weight"), F.lit(0).alias("positive"))
    given = reviews.withWatermark("at", late).join(starts, "appid").select("appid", "at", "start", "weight", "positive")
    ends = F.array(*(F.col("start") + F.make_dt_interval(F.lit(days)) for days in (windows.first, windows.second, windows.third)))
    rows = given.unionByName(begun).select("*", F.posexplode(ends).alias("k", "end")).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    left = F.concat((F.unix_micros("end") - F.unix_micros("at")).cast("string"), F.lit(" microseconds"))
    sums = rows.groupBy(F.session_window("at", left).alias("session"), "appid", "k").agg(F.sum("weight").cast("bigint").alias("review_total"), F.sum("positive").cast("bigint").alias("review_positive"))
    name = F.element_at(F.array(*(F.lit(k) for k in WINDOW_KEYS)), F.col("k") + 1)
    return sums.select("appid", name.alias("window_key"), F.col("session.end").alias("window_end"), "review_total", "review_positive")


def upsert_latest(polls: DataFrame, path: str, checkpoint: str, key: str = "appid", at: str = "captured_at") -> StreamingQuery:
    """Keep each title's last row in a table at ``path``, which upserts.current reads."""
    return polls.writeStream.foreachBatch(lambda batch, epoch: put(batch, path, epoch, key, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep launch_windows' rows in a table at ``path``, one a title and window."""
    return windows.writeStream.foreachBatch(lambda batch, epoch: put(batch, path, epoch, "appid", also=("window_key",))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replaced_windows(recomputed: DataFrame, path: str) -> None:
    """Put windows that a batch run worked out anew, late reviews included, over those at ``path``."""
    put(recomputed, path, None, "appid", also=("window_key",), writer="batch")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, to Parquet files (append) or by batch (update)."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        sink: Callable[[DataFrame, int], None] = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
