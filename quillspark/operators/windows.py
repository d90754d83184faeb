"""Window patterns: top-k, caps, cursors, batches, round robin and graph backbones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize


def top_per(df: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """WIN-01/03: the first k rows of each group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def capped_membership(members: DataFrame, per_node: int, least: int) -> DataFrame:
    """WIN-04: each node's surest communities; communities that fall under the least size go."""
    kept = top_per(members, "node_id", [F.desc("weight"), F.col("community_id")], per_node)
    size = F.count("*").over(Window.partitionBy("community_id"))
    return kept.withColumn("size", size).where(F.col("size") >= least)


def consecutive(df: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """WIN-05/06: each row with the key of the next one of its group."""
    return df.withColumn("next", F.lead(key).over(Window.partitionBy(by).orderBy(order))).where(F.col("next").isNotNull())


def round_robin(df: DataFrame, bucket: str, order: list[Column], key: str, limit: int, buckets: list[str]) -> DataFrame:
    """WIN-10: one of each bucket in turn, buckets in the given order; a key counts once; the first `limit` rows."""
    place = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col(bucket)).cast("int")
    first = Window.partitionBy(bucket, key).orderBy(*order)
    once = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    ranked = once.withColumns({"turn": F.row_number().over(Window.partitionBy(bucket).orderBy(*order)), "place": place}).where(F.col("turn") <= limit)
    again = F.row_number().over(Window.partitionBy(key).orderBy("turn", "place"))
    kept = ranked.withColumn("_n", again).where("_n = 1").drop("_n")
    return kept.orderBy("turn", "place").limit(limit)


def char_budget_batches(df: DataFrame, by: str, order: str, chars: int, count: int) -> DataFrame:
    """WIN-11: rows of a group in order, filled greedily into batches of at most `chars` characters and `count` rows.

    Sorted partitions are read once with the open batch as the only state, so a group may be of any length. Null texts are empty.
    """

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, held, rows = object(), 0, 0, 0
        for f in frames:
            out = []
            for g, n in zip(f["_group"], f["_n"], strict=True):
                if g != group:
                    group, batch, held, rows = g, 0, 0, 0
                elif held + n > chars or rows >= count:
                    batch, held, rows = batch + 1, 0, 0
                held, rows = held + n, rows + 1
                out.append(batch)
            yield f.drop(columns=["_group", "_n"]).assign(batch=out)

    # the group as text, so that a null is one group, too
    rows = df.select(by, order, F.coalesce(F.col(by).cast("string"), F.lit("")).alias("_group"), F.coalesce(F.length("text"), F.lit(0)).alias("_n"))
    rows = rows.repartition("_group").sortWithinPartitions("_group", by, order)
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, batch int"
    return rows.mapInPandas(fill, schema)


def backbone(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """WIN-12: nodes (id, year) by 20 degree + 6 ln(1 + mentions) + 2 recency; connected ones first, isolates by year."""
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "total_mentions").unionByName(
        edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "total_mentions")
    )
    stats = ends.where("id != other").groupBy("id").agg(F.count_distinct("other").alias("degree"), F.sum("total_mentions").alias("mentions"))
    low, high = nodes.agg(F.min("year"), F.max("year")).first()
    span = max(1, (high or 0) - (low or 0))
    joined = nodes.join(stats, "id", "left").na.fill(0, ["degree", "mentions"])
    recency = F.coalesce((F.col("year") - F.lit(low or 0)) / span, F.lit(0.0))
    score = F.round(20 * F.col("degree") + 6 * F.log1p("mentions") + 2 * recency, 6)
    order = [F.when(F.col("degree") > 0, 0).otherwise(1), F.desc(F.when(F.col("degree") > 0, F.col("score")).otherwise(F.col("year"))), F.desc("degree"), F.desc("mentions"), F.desc("id")]
    return joined.withColumn("score", score).orderBy(*order).limit(limit)


def retention(tasks: DataFrame, keep: int) -> DataFrame:
    """WIN-14: all active tasks, and the newest finished ones."""
    finished = tasks.where("status = 'finished'").orderBy(F.desc("updated"), "task_id").limit(keep)
    return tasks.where("status != 'finished'").unionByName(finished)


def degree_capped(edges: DataFrame, cap: int, max_rounds: int = 500) -> DataFrame:
    """WIN-08: distinct edges (source, target, weight) taken by falling weight while both ends have fewer than cap; ties by source, target.

    Gives what taking the edges one by one gives, in rounds of joins: an edge that is among the heaviest
    open ones at both its ends, as many as each end has room for, is taken; at a full end the open ones go.
    The heaviest open edge is always taken, so rounds end. Loops are left out.
    """
    open_, taken, room = materialize(edges.where("source != target").select("source", "target", "weight")), [], None
    for _ in range(max_rounds):
        ends = open_.withColumn("end", F.explode(F.array("source", "target")))
        place = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("weight"), "source", "target"))
        best = ends.withColumn("place", place).where(F.col("place") <= cap)
        if room is not None:
            best = best.join(room, "end", "left").where(F.col("place") <= F.coalesce("room", F.lit(cap)))
        now = materialize(best.groupBy("source", "target").agg(F.first("weight").alias("weight"), F.count("*").alias("ends")).where("ends = 2").drop("ends"))
        if not now.limit(1).count():
            return reduce(lambda a, b: a.unionByName(b), [*taken, now])
        taken.append(now)
        used = reduce(lambda a, b: a.unionByName(b), taken).select(F.explode(F.array("source", "target")).alias("end")).groupBy("end")
        room = materialize(used.agg((F.lit(cap) - F.count("*")).alias("room")))
        full = room.where("room <= 0").select("end")
        left = open_.join(now, ["source", "target"], "left_anti")
        for side in ("source", "target"):
            left = left.join(full.withColumnRenamed("end", side), side, "left_anti")
        open_ = materialize(left.select("source", "target", "weight"))
    raise RuntimeError(f"edges were still open after {max_rounds} rounds")


def mutual_top(edges: DataFrame, cap: int) -> DataFrame:
    """The scalable relative of WIN-08: edges among the cap heaviest of both their ends, a subset of the greedy result."""
    ends = edges.withColumn("end", F.explode(F.array("source", "target")))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("weight"), "source", "target"))
    good = ends.withColumn("_n", rank).groupBy("source", "target", "weight").agg(F.max("_n").alias("worst"))
    return good.where(F.col("worst") <= cap).drop("worst")


def stream_batches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows of a partition in frames of at most `size`, for injected model calls."""
    for b in batches:
        for i in range(0, len(b), size):
            yield b.iloc[i : i + size]
