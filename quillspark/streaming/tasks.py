"""A task queue over streams of requests: at least one run for each task, across restarts.

Requests are rows (task_id, type, payload, action); the first submit of an id makes the task. A batch takes up
what its requests and the table before it leave queued, runs the handlers in tasks of Spark, and
writes the next version of the table. A batch that was cut short leaves no version, so its tasks are queued again
when the stream goes on, and a batch replayed gives the same version.

Defined results: a cancel counts only for a task that has not finished, and not before its submit; further submits of an id
change nothing; a type without a handler fails; a handler's exception fails its task alone, and keeps the
partial result that the exception brings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.streaming.sinks import VersionedTable

SCHEMA = "task_id long, type string, payload string, status string, progress double, result string, error string"
FINISHED = ("succeeded", "failed", "canceled")


class PartialFailure(Exception):
    """A handler's failure that brings what was done before it."""

    def __init__(self, message: str, partial_result: str | None = None) -> None:
        super().__init__(message)
        self.partial_result = partial_result


def requeued(tasks: DataFrame) -> DataFrame:
    """Tasks that had not finished are queued anew."""
    open_ = ~F.col("status").isin(*FINISHED)
    queued = {"status": F.lit("queued"), "progress": F.lit(0.0), "error": F.lit(None).cast("string")}
    return tasks.withColumns({c: F.when(open_, v).otherwise(F.col(c)) for c, v in queued.items()})


def with_requests(old: DataFrame | None, requests: DataFrame) -> DataFrame:
    """The table after a batch of requests, before anything runs."""
    nothing = {"status": F.lit("queued"), "progress": F.lit(0.0), "result": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    submits = requests.where("action = 'submit'").groupBy("task_id").agg(F.min(F.struct("type", "payload")).alias("t"))
    new = submits.select("task_id", "t.type", "t.payload").withColumns(nothing)
    tasks = new if old is None else requeued(old).unionByName(new.join(old, "task_id", "left_anti"))
    cancels = requests.where("action = 'cancel'").select("task_id", F.lit(True).alias("stop")).distinct()
    stopped = F.col("stop") & ~F.col("status").isin(*FINISHED)
    marked = tasks.join(cancels, "task_id", "left")
    return marked.withColumn("status", F.when(stopped, "canceled").otherwise(F.col("status"))).drop("stop")


def run_queued(tasks: DataFrame, handlers: dict[str, Callable[[str], str]], partitions: int) -> DataFrame:
    """Queued tasks after one run of their handlers, in so many tasks of Spark; all others as they are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, (kind, payload) in enumerate(zip(b["type"], b["payload"], strict=True)):
                status, done, result, error = "succeeded", 1.0, None, None
                if kind not in handlers:
                    status, done, error = "failed", 0.0, f"No handler for task type: {kind}"
                else:
                    try:
                        result = handlers[kind](payload)
                    except Exception as e:  # noqa: BLE001 - whatever a handler raises fails its own task only
                        status, done, result, error = "failed", 0.0, getattr(e, "partial_result", None), str(e)
                for c, v in zip(("status", "progress", "result", "error"), (status, done, result, error), strict=True):
                    b.iat[i, b.columns.get_loc(c)] = v
            yield b

    queued = F.col("status") == "queued"
    ran = tasks.where(queued).repartition(partitions, "task_id").mapInPandas(work, SCHEMA)
    return tasks.where(~queued).unionByName(ran)


def start_queue(requests: DataFrame, handlers: dict[str, Callable[[str], str]], folder: str, partitions: int | None = None) -> StreamingQuery:
    """Work through a stream of requests; the same folder goes on where the query stopped."""
    spark = requests.sparkSession
    table = VersionedTable(spark, f"{folder}/table")
    n = partitions or spark.sparkContext.defaultParallelism

    def update(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return run_queued(with_requests(old, batch), handlers, n).select(*[c.split()[0] for c in SCHEMA.split(", ")])

    return requests.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(table.merge(update)).start()


def task_table(spark: SparkSession, folder: str) -> DataFrame:
    return VersionedTable(spark, f"{folder}/table").read()
