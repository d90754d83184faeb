"""AGG-25 as keyed state: signatures that recur over nodes, counted for as long as the stream lives.

A frequent signature may hold a third of all rows, so the state's keys are pairs of a signature and a node, counted by Spark's own
aggregation. State is in RocksDB, one entry for each pair, so no signature's nodes are ever in memory together.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.streaming.sinks import VersionedTable

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, so that it need not fit in memory."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def recurrence_counts(rows: DataFrame) -> DataFrame:
    """Stream (signature string, node string) -> changed (signature, node, n) after each batch. Null nodes count as one node."""
    return rows.select("signature", F.coalesce("node", F.lit("")).alias("node")).groupBy("signature", "node").agg(F.count("*").alias("n"))


def start_recurrence(rows: DataFrame, folder: str) -> StreamingQuery:
    """Keep the counts as a table under folder; the same folder goes on where the query stopped."""

    def update(old: DataFrame | None, changed: DataFrame) -> DataFrame:
        # counts only grow, so the largest one is the last
        return changed if old is None else old.unionByName(changed).groupBy("signature", "node").agg(F.max("n").alias("n"))

    table = VersionedTable(rows.sparkSession, f"{folder}/table")
    with rocksdb_state(rows.sparkSession):
        return (
            recurrence_counts(rows).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).foreachBatch(table.merge(update)).start()
        )


def recurrence_table(spark: SparkSession, folder: str, cross: int = 2, total: int = 3) -> DataFrame:
    """(signature, nodes, n, grows) as of the last batch."""
    kept = VersionedTable(spark, f"{folder}/table").read()
    sums = kept.groupBy("signature").agg(F.count("*").alias("nodes"), F.sum("n").alias("n"))
    return sums.withColumn("grows", (F.col("nodes") >= cross) | (F.col("n") >= total))
