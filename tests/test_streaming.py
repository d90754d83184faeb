"""Streams that stop, fail and go on: results equal those of one pass over all rows."""

import glob
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators.aggregates import recurrence as in_one_pass
from quillspark.streaming import events, recurrence, sinks, tasks


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).parquet(f"{path}/*")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def uncommit(folder):
    """Forget that the last batch ended, as after a crash between its output and its commit."""
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{folder}/state/commits/[0-9]*"))
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(p := f"{folder}/state/commits/{name}"):
            os.remove(p)
    return last


def test_recurrence_survives_a_restart(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, f"s{i % 5}" if i % 3 else "hot", f"n{i % 11}" if i % 13 else None) for i in range(400)], "step int, signature string, node string")
    folder = str(tmp_path / "q")

    def start(stream):
        return recurrence.start_recurrence(stream.select("signature", "node"), folder)

    rows.where("step = 0").write.parquet(str(tmp_path / "in/0"))
    start(stream_of(spark, tmp_path / "in", rows.schema)).awaitTermination()
    half = rows_of(recurrence.recurrence_table(spark, folder))
    rows.where("step = 1").write.parquet(str(tmp_path / "in/1"))
    start(stream_of(spark, tmp_path / "in", rows.schema)).awaitTermination()
    whole = rows_of(recurrence.recurrence_table(spark, folder))
    assert half != whole == rows_of(in_one_pass(rows.fillna({"node": ""})))


def test_versions_are_found_on_disk_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    update = lambda old, new: new if old is None else old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    batches = [spark.createDataFrame([(k, 1) for k in ks], "k string, n long") for ks in (["a", "b"], ["b"], ["c", "a"])]
    for epoch, batch in enumerate(batches):
        sinks.VersionedTable(spark, path).merge(update)(batch, epoch)
    found = rows_of(sinks.VersionedTable(spark, path).read())
    assert found == [("a", 2), ("b", 2), ("c", 1)]
    sinks.VersionedTable(spark, path).merge(update)(batches[2], 2)
    assert rows_of(sinks.VersionedTable(spark, path).read()) == found and sinks.VersionedTable(spark, path).versions() == [1, 2]
    assert sinks.VersionedTable(spark, str(tmp_path / "none")).read() is None


def test_appended_batches_are_replaced_when_replayed(spark, tmp_path):
    folder, rows = str(tmp_path / "q"), spark.range(10).withColumn("x", F.col("id") * 2)
    rows.write.parquet(str(tmp_path / "in/0"))
    for _ in range(3):
        events.start_epochs(stream_of(spark, tmp_path / "in", rows.schema), folder).awaitTermination()
        uncommit(folder)
    assert rows_of(events.epoch_rows(spark, folder)) == rows_of(rows)


REQUESTS = "task_id long, type string, payload string, action string"


def ran(log):
    def handler(payload):
        with open(log, "a") as f:
            f.write(payload + "\n")
        if payload == "bad":
            raise tasks.PartialFailure("broken", "half")
        return payload.upper()

    return handler


def test_task_queue(spark, tmp_path):
    folder, log = str(tmp_path / "q"), str(tmp_path / "log")
    steps = [
        [(1, "a", "x", "submit"), (2, "a", "bad", "submit"), (3, "b", "y", "submit"), (4, "a", "z", "submit"), (4, "a", "z", "cancel"), (9, "a", "q", "cancel")],
        [(1, "a", "again", "submit"), (1, None, None, "cancel"), (5, "a", "w", "submit"), (9, "a", "late", "submit")],
    ]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        tasks.start_queue(stream_of(spark, tmp_path / "in", spark.createDataFrame([], REQUESTS).schema), {"a": ran(log)}, folder).awaitTermination()
    want = {
        1: ("succeeded", "X", None), 2: ("failed", "half", "broken"), 3: ("failed", None, "No handler for task type: b"), 4: ("canceled", None, None), 5: ("succeeded", "W", None),
        9: ("succeeded", "LATE", None),
    }
    assert {r.task_id: (r.status, r.result, r.error) for r in tasks.task_table(spark, folder).collect()} == want
    # the batch is played again, with the same outcome; its tasks run a second time
    uncommit(folder)
    tasks.start_queue(stream_of(spark, tmp_path / "in", spark.createDataFrame([], REQUESTS).schema), {"a": ran(log)}, folder).awaitTermination()
    assert {r.task_id: (r.status, r.result, r.error) for r in tasks.task_table(spark, folder).collect()} == want
    assert sorted(open(log).read().split()) == sorted(["x", "bad", "w", "late", "w", "late"])


def test_tasks_of_a_batch_that_died_are_run_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "q")
    spark.createDataFrame([(1, "a", "x", "submit")], REQUESTS).write.parquet(str(tmp_path / "in/0"))
    schema = spark.createDataFrame([], REQUESTS).schema
    put = sinks.VersionedTable.put
    monkeypatch.setattr(sinks.VersionedTable, "put", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(Exception, match="disk"):
        tasks.start_queue(stream_of(spark, tmp_path / "in", schema), {"a": str.upper}, folder).awaitTermination()
    monkeypatch.setattr(sinks.VersionedTable, "put", put)
    tasks.start_queue(stream_of(spark, tmp_path / "in", schema), {"a": str.upper}, folder).awaitTermination()
    assert [(r.status, r.result) for r in tasks.task_table(spark, folder).collect()] == [("succeeded", "X")]


def test_running_tasks_are_queued_after_a_restart(spark):
    rows = [(1, "a", "x", "running", 0.5, None, None), (2, "a", "y", "succeeded", 1.0, "r", None), (3, "a", "z", "queued", 0.0, None, "old")]
    got = tasks.requeued(spark.createDataFrame(rows, tasks.SCHEMA))
    assert {r.task_id: (r.status, r.progress, r.error) for r in got.collect()} == {1: ("queued", 0.0, None), 2: ("succeeded", 1.0, None), 3: ("queued", 0.0, None)}


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    hours = [[0, 1, 5], [30, 31], [2, 29, 60], [3, 59]]  # 2 is behind 31 - 12, 3 is behind 60 - 12
    rows = spark.createDataFrame([(i, t0 + timedelta(hours=h), "e", 1.0) for i, hs in enumerate(hours) for h in hs], "step int, ts timestamp, event_type string, value double")
    folder = str(tmp_path / "q")
    reports = sinks.feed(rows, F.col("step"), 4, lambda s: events.start_epochs(events.sliding_counts(s, "6 hours", "3 hours", "12 hours"), folder))
    got = {(r.start - t0).total_seconds() / 3600: r.n for r in events.epoch_rows(spark, folder).collect()}
    want: dict[float, int] = {}
    for step, hs in enumerate(hours):
        seen = [h for x in hours[:step] for h in x]
        for h in hs:
            for start in (h // 3 * 3, h // 3 * 3 - 3):
                if not seen or start + 6 > max(seen) - 12:
                    want[start] = want.get(start, 0) + 1
    assert got == {s: n for s, n in want.items() if s + 6 <= 60 - 12}
    assert sinks.dropped_rows(reports) == 4


def test_progress_log(spark, tmp_path):
    lines: list[dict] = []
    listener = sinks.ProgressLog(lines.append)
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in/0"))
        events.start_epochs(stream_of(spark, tmp_path / "in", spark.range(1).schema), str(tmp_path / "q")).awaitTermination()
        for _ in range(100):
            if lines and lines[-1]["event"] == "done":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [x["event"] for x in lines] == ["started", "progress", "done"] and lines[1]["rows"] == 7
