"""Sinks that a replayed batch leaves unchanged, and streams that are fed step by step.

A batch that was cut short runs again with the same number and rows after a restart. What a batch writes is
therefore named by its number and replaced as a whole; what it reads is found on disk, never in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quillspark.session import shared_folder


class EpochTable:
    """Rows appended by batches: each batch owns one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def put(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).drop("epoch")


class VersionedTable:
    """A table that each batch replaces: version N is what batch N made of the last complete version before it."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2) -> None:
        self.spark, self.folder, self.keep = spark, folder, max(2, keep)

    def _files(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def versions(self) -> list[int]:
        """Complete versions on disk, in order."""
        files, folder = self._files()
        done = files.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in done)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The last version, or the last one before a number; None where there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.folder}/version={found[-1]}") if found else None

    def put(self, rows: DataFrame, epoch: int) -> None:
        """Version `epoch` as a whole; versions that no replay needs any more go."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/version={epoch}")
        files, folder = self._files()
        for v in [v for v in self.versions() if v <= epoch][: -self.keep]:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"version={v}"), True)

    def merge(self, update: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: version N is update(version before N, batch N)."""
        return lambda batch, epoch: self.put(update(self.read(epoch), batch), epoch)


def feed(rows: DataFrame, step: Column, steps: int, start: Callable[[DataFrame], StreamingQuery]) -> list[dict]:
    """Rows arrive in files of one step after the other. After each the query is started anew from its checkpoint
    and runs over all that has come; the progress reports of its batches are returned."""
    folder, reports = shared_folder(rows.sparkSession, "feed"), []
    for i in range(steps):
        rows.where(step == i).write.parquet(f"{folder}/{i}")
        query = start(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/*"))
        query.awaitTermination()
        reports += query.recentProgress
    return reports


def dropped_rows(reports: list[dict]) -> int:
    """How many rows (after partial aggregation) the stateful operators dropped as too late."""
    return sum(op["numRowsDroppedByWatermark"] for r in reports for op in r["stateOperators"])


class ProgressLog(StreamingQueryListener):
    """A line for each event of the session's streams, passed to `write` as they come."""

    def __init__(self, write: Callable[[dict], None]) -> None:
        self.write = write

    def onQueryStarted(self, event) -> None:
        self.write({"event": "started", "run": str(event.runId)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.write({"event": "progress", "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.write({"event": "failed" if event.exception else "done", "run": str(event.runId), "error": event.exception})


def bucket(key: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
