"""Streams fed file by file against their batch twins."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from launchgrid.operators import snapshots
from launchgrid.streaming import polls, upserts

T = datetime.datetime


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, polls.ROCKSDB)
    yield
    spark.conf.set(key, before)


def land(spark, tmp_path, rows, schema, files=3):
    """The rows in some files, in order."""
    path = str(tmp_path / "in")
    for i in range(files):
        spark.createDataFrame(rows[i::files] if files == 1 else rows[len(rows) * i // files : len(rows) * (i + 1) // files], schema).coalesce(1).write.mode("append").parquet(path)
    return path


FLUSH = T(2026, 3, 1)


def changes(spark, tmp_path, batches, schema, late="1 day"):
    """date_changes over files that are landed one after the other; a poll far on lets out what waits."""
    path = str(tmp_path / "in")
    for k, rows in enumerate([*batches, [(-1, FLUSH, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    stream = polls.read_polls(spark, f"{path}/*", spark.createDataFrame([], schema).schema, 1)
    polls.run_to_table(polls.date_changes(stream, late), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_polls_landed_out_of_order_give_the_batch_log(spark, tmp_path, rocksdb):
    rng, texts = random.Random(5), ["Nov 12, 2026", None, "Mar 4, 2027", "Mar 4, 2027", "Q4 2026"]
    rows = [(k % 3, T(2026, 1, 1) + datetime.timedelta(hours=k), texts[(k * k) % 5]) for k in range(60)]
    schema = "appid long, captured_at timestamp, raw string"
    landed = sorted(rows, key=lambda r: r[1] + datetime.timedelta(hours=rng.uniform(0, 20)))  # up to 20 hours behind
    assert landed != rows
    got = changes(spark, tmp_path, [landed[k : k + 12] + landed[k : k + 2] for k in range(0, 60, 12)], schema)
    want = snapshots.date_changes(spark.createDataFrame(rows, schema))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 10


def test_polls_landed_twice_count_once(spark, tmp_path):
    rows = [(1, T(2026, 1, 1, h), 10 * h) for h in (1, 5, 5, 9)] + [(1, T(2026, 1, 2, 3), 7), (1, T(2026, 1, 9), 1), (1, T(2026, 1, 12), 1)]
    schema = "appid long, captured_at timestamp, players long"
    stream = polls.read_polls(spark, land(spark, tmp_path, rows, schema, 1), spark.createDataFrame([], schema).schema)
    polls.run_to_table(polls.daily_rollup(polls.distinct_polls(stream), None), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {str(r.day): (r.polls, r.peak_players, r.sum_players) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2026-01-01": (3, 90, 150), "2026-01-02": (1, 7, 7), "2026-01-09": (1, 1, 1)}


def test_a_batch_reads_and_writes_a_titles_state_once():
    import pandas as pd

    class Held:
        exists, get, mark, writes, wakes = False, None, 0, 0, []
        getCurrentWatermarkMs = lambda self: self.mark
        setTimeoutTimestamp = lambda self, at: self.wakes.append(at)

        def update(self, now):
            self.exists, self.get, self.writes = True, now, self.writes + 1

    state, texts = Held(), ["a", "a", None, "b", "c"]
    rows = pd.DataFrame({"captured_at": pd.to_datetime([1000 + k for k in range(500)], unit="ms"), "raw": [texts[k % 5] for k in range(500)]})
    assert list(polls._changes((7,), iter([rows[250:], rows[:250]]), state)) == [] and state.writes == 1 and state.wakes == [1000]
    state.mark = 1007  # seven polls are behind it, one stands at it
    out = pd.concat(polls._changes((7,), iter([]), state))
    assert list(out.itertuples(index=False, name=None)) == [(7, pd.Timestamp(1002, unit="ms"), "a", None), (7, pd.Timestamp(1004, unit="ms"), "b", "c"), (7, pd.Timestamp(1005, unit="ms"), "c", "a")]
    assert state.writes == 2 and state.wakes == [1000, 1007]


def test_the_first_forecast_stays(spark, tmp_path, rocksdb):
    rows = [(1, T(2026, 1, 1), True, None), (1, T(2026, 1, 2), True, "success"), (1, T(2026, 1, 3), False, "flop"), (1, T(2026, 1, 4), True, None)]
    schema = "appid long, captured_at timestamp, coming_soon boolean, predicted string"
    stream = polls.read_polls(spark, land(spark, tmp_path, rows, schema, 2), spark.createDataFrame([], schema).schema, 1)
    polls.run_to_table(polls.lifecycle(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    got = snapshots.latest(spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).select("appid", "state", "predicted", "epoch"), at="epoch").first()
    assert (got.state, got.predicted) == ("tracking", "success")


def test_polls_behind_one_let_through_change_nothing(spark, tmp_path, rocksdb):
    day = lambda d: T(2026, 1, d)
    schema = "appid long, captured_at timestamp, raw string"
    batches = [[(1, day(1), "Nov 12, 2026")], [(1, day(9), "Mar 4, 2027")], [(2, day(12), "Q4 2026")], [(2, day(13), "Q4 2026")], [(1, day(3), "Q4 2026")], [(1, day(14), "Mar 4, 2027")]]
    got = [(r.appid, r.observed_at.day, r.previous_raw, r.new_raw) for r in changes(spark, tmp_path, batches, schema).collect()]
    assert got == [(1, 9, "Nov 12, 2026", "Mar 4, 2027")]


def test_launch_windows_go_out_once_when_elapsed_and_are_replaced_by_a_rerun(spark, tmp_path, rocksdb):
    schema = "appid long, at timestamp, weight long, positive long"
    starts = spark.createDataFrame([(1, T(2026, 1, 1)), (2, T(2026, 1, 20)), (3, T(2026, 1, 19)), (4, T(2026, 6, 1)), (5, None)], "appid long, start timestamp")
    path, table = str(tmp_path / "in"), str(tmp_path / "table")
    kind = spark.createDataFrame([], schema).schema
    seen = []
    for k, days in enumerate([(2, 10), (16, 18), (25, 40), (100,)]):
        rows = [(1, T(2026, 1, 1) + datetime.timedelta(days=d), 10, 4) for d in days] + [(2, T(2026, 1, 21), 1, 1)] * (k == 2)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        windows = polls.launch_windows(polls.read_polls(spark, path, kind), starts)
        polls.keep_windows(windows, table, str(tmp_path / "state")).awaitTermination()
        now = upserts.current(spark, table, windows.schema)
        seen.append({(r.appid, r.window_key): (r.review_total, r.review_positive) for r in now.collect()})
    assert seen[0] == {} and seen[1] == {(1, "launch_2w"): (20, 8)}
    assert seen[2] == seen[1] | {(1, "launch_1m"): (50, 20), (2, "launch_2w"): (1, 1), (3, "launch_2w"): (0, 0)}  # 3 is silent
    assert seen[3] == seen[2] | {(1, "launch_3m"): (60, 24), (2, "launch_1m"): (1, 1), (3, "launch_1m"): (0, 0)}
    late = spark.createDataFrame([(1, "launch_2w", T(2026, 1, 15), 25, 9)], polls.WINDOW_ROW)
    polls.replaced_windows(late, table)
    after = {(r.appid, r.window_key): (r.review_total, r.review_positive) for r in upserts.current(spark, table, windows.schema).collect()}
    assert after == seen[3] | {(1, "launch_2w"): (25, 9)}


def test_windows_take_late_reviews_while_they_run_and_silent_titles_announced_later(spark, tmp_path, rocksdb):
    schema = "appid long, at timestamp, weight long, positive long"
    path, table = str(tmp_path / "in"), str(tmp_path / "table")
    kind = spark.createDataFrame([], schema).schema
    for days, known in (((2, 9), [(1, T(2026, 1, 1))]), ((3, 20), [(1, T(2026, 1, 1)), (2, T(2026, 1, 10))]), ((31,), [(1, T(2026, 1, 1)), (2, T(2026, 1, 10))])):
        spark.createDataFrame([(1, T(2026, 1, 1) + datetime.timedelta(days=d), 10, 4) for d in days], schema).coalesce(1).write.mode("append").parquet(path)
        windows = polls.launch_windows(polls.read_polls(spark, path, kind), spark.createDataFrame(known, "appid long, start timestamp"))
        assert "InPandas" not in windows._jdf.queryExecution().toString()  # no title calls Python
        polls.keep_windows(windows, table, str(tmp_path / "state")).awaitTermination()
    got = {(r.appid, r.window_key): (r.review_total, r.review_positive) for r in upserts.current(spark, table, windows.schema).collect()}
    assert got == {(1, "launch_2w"): (30, 12), (1, "launch_1m"): (40, 16), (2, "launch_2w"): (0, 0)}  # day 3 came behind the watermark


POLL = "appid long, captured_at timestamp, players long"


def written_bytes(path, before):
    return sum(f.stat().st_size for f in path.rglob("*.parquet") if f not in before)


def test_a_batch_writes_what_it_has_and_files_stay_few(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(1)
    rows = lambda xs: spark.createDataFrame(xs, POLL).coalesce(1)
    keep = lambda xs, epoch: upserts.put(rows(xs), path, epoch, "appid", "captured_at", limit=2000, least=50)
    want = {i: (T(2026, 1, 2), i) for i in range(20000)}
    keep([(i, *v) for i, v in want.items()], 0)
    state = lambda: json.loads(upserts.last_state(spark, f"{path}/state")[1])
    assert len(state()["buckets"]) == 16 and not state()["deltas"]  # split as the table grew
    whole = written_bytes(tmp_path / "t", ())
    for epoch in range(1, 12):
        batch = [(rng.randrange(20100), T(2026, 1, rng.randrange(1, 28)), epoch * 1000 + k) for k in range(20)]
        batch = list({r[0]: r for r in batch}.values())
        before = set((tmp_path / "t").rglob("*.parquet"))
        keep(batch, epoch)
        keep(batch, epoch)  # the batch again
        assert written_bytes(tmp_path / "t", before) < whole / 10
        for i, at, n in batch:
            want[i] = max(want.get(i, (T(2000, 1, 1), 0)), (at, n), key=lambda x: x[0]) if i not in want or at != want[i][0] else (at, n)
    assert len(state()["deltas"]) < upserts.FAN
    got = {r.appid: (r.captured_at, r.players) for r in upserts.current(spark, path, rows([]).schema).collect()}
    assert got == want


def test_a_bucket_is_compacted_when_its_deltas_outgrow_it(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda xs: spark.createDataFrame(xs, POLL)
    for epoch in range(5):
        upserts.put(rows([(i, T(2026, 1, 1 + epoch), epoch) for i in range(40)]), path, epoch, "appid", "captured_at", limit=1000, least=100)
    state = json.loads(upserts.last_state(spark, f"{path}/state")[1])
    assert state["buckets"][0]["rows"] == 40 and len(state["deltas"]) == 2  # at the third put, and not again
    assert {r.players for r in upserts.current(spark, path, rows([]).schema).collect()} == {4}
    assert len([f for f in (tmp_path / "t").iterdir() if f.name != "state"]) <= 5


def test_a_put_that_breaks_off_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda n: spark.createDataFrame([(1, T(2026, 1, n), n)], POLL)
    upserts.put(rows(1), path, 0, "appid", "captured_at")
    with monkeypatch.context() as m:
        m.setattr(upserts, "_compact", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            upserts.put(rows(2), path, 1, "appid", "captured_at")
    assert upserts.current(spark, path, rows(1).schema).first().players == 1
    upserts.put(rows(2), path, 1, "appid", "captured_at")
    assert upserts.current(spark, path, rows(1).schema).first().players == 2
