"""Samples of a graph under a budget of nodes and edges, with the result of taking edges one by one.

As long as two more nodes fit, no edge is passed over, so the next edges in order are taken as they come. When one
more node fits, only edges with an end in the sample count until one of them brings that node; then only edges
inside the sample count. Each of these is one top-k over the edges, so that the table is never sorted as
a whole, and what the driver holds is bounded by the two limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

#: What an edge's type adds to its weight.
TYPE_BONUS = {"EXPLAINS": 5, "RELATES_TO": 4, "HAS_CLAIM": 3, "IN_COMMUNITY": 2, "HAS_KEYWORD": 1}


def _members(edges: DataFrame, nodes: set[str]) -> DataFrame:
    """edges with in_source and in_target; the sample has a bounded number of nodes."""
    held = edges.sparkSession.createDataFrame([(n,) for n in nodes], "node string")
    for end in ("source", "target"):
        side = F.broadcast(held.select(F.col("node").alias(end), F.lit(True).alias(f"in_{end}")))
        edges = edges.join(side, end, "left").withColumn(f"in_{end}", F.coalesce(f"in_{end}", F.lit(False)))
    return edges


def _literal(row) -> Column:
    return F.struct(*[F.lit(v) for v in row])


def greedy_edges(edges: DataFrame, node_limit: int, edge_limit: int) -> tuple[list, set[str]]:
    """(taken rows in order, their nodes): edges (source, target, rank_key struct) by rising rank_key while the limits hold."""
    taken: list = []
    nodes: set[str] = set()
    open_ = edges
    while len(taken) < edge_limit:
        room = node_limit - len(nodes)
        if room >= 2:
            rows = open_
        else:
            seen = _members(open_, nodes)
            rows = seen.where(F.col("in_source") & F.col("in_target") if room == 0 else F.col("in_source") | F.col("in_target"))
        found = rows.select("source", "target", "rank_key").orderBy("rank_key").limit(edge_limit - len(taken)).collect()
        last = None
        for r in found:
            # a loop asks for two places, although it fills one
            if (r.source not in nodes) + (r.target not in nodes) > node_limit - len(nodes):
                continue  # room for one node, and the edge brings two
            taken.append(r)
            nodes |= {r.source, r.target}
            last = r.rank_key
            if (node_limit - len(nodes) < 2) != (room < 2) or (node_limit - len(nodes) == 0) != (room == 0):
                break
        else:
            return taken, nodes
        # a struct of literals has the columns' names and types
        open_ = edges.where(F.col("rank_key") > _literal(last).cast(edges.schema["rank_key"].dataType))
    return taken, nodes


def _taken(edges: DataFrame, rows: list) -> DataFrame:
    """The taken ones among edges, by their ends and key."""
    kept = edges.sparkSession.createDataFrame([(r.source, r.target, r.rank_key) for r in rows], edges.select("source", "target", "rank_key").schema)
    return edges.join(F.broadcast(kept), ["source", "target", "rank_key"], "left_semi")


def connected_sample(nodes: DataFrame, edges: DataFrame, node_limit: int = 260, edge_limit: int = 520) -> tuple[DataFrame, DataFrame]:
    """WIN-09, GRAPH-13: nodes (node, name, chapter) and edges (source, target, rel_type) within the limits.

    Edges go by the degrees of their ends, then type, source, target; nodes that are still free are filled round robin by
    chapter, within it by degree and name (the id where there is none); then come further edges inside the sample. Loops and
    edges without both ends count for nothing; edges of the same ends and type count for the degree, but are taken once.
    """
    node_limit, edge_limit = max(1, node_limit), max(0, edge_limit)
    nodes = nodes.where(F.trim("node") != "").select("node", F.coalesce(F.nullif("name", F.lit("")), F.col("node")).alias("name"), F.coalesce("chapter", F.lit("")).alias("chapter"))
    nodes = nodes.dropDuplicates(["node"])
    ids = nodes.select("node")
    valid = edges.where("source != target").join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")
    valid = valid.select("source", "target", F.coalesce("rel_type", F.lit("")).alias("rel_type")).groupBy("source", "target", "rel_type").agg(F.count("*").alias("times"))
    valid = materialize(valid)
    degree = materialize(valid.select(F.explode(F.array("source", "target")).alias("node"), "times").groupBy("node").agg(F.sum("times").alias("degree")))
    ends = [degree.select(F.col("node").alias(e), F.col("degree").alias(f"d_{e}")) for e in ("source", "target")]
    ranked = valid.join(ends[0], "source").join(ends[1], "target")
    ranked = materialize(ranked.select("source", "target", "rel_type", F.struct((-F.col("d_source") - F.col("d_target")).alias("d"), "rel_type", "source", "target").alias("rank_key")))
    rows, chosen = greedy_edges(ranked, node_limit, edge_limit)
    sample = nodes.join(degree, "node", "left").na.fill(0, ["degree"])
    spark = nodes.sparkSession
    first = spark.createDataFrame([(n,) for n in chosen], "node string")
    free = sample.join(F.broadcast(first), "node", "left_anti")
    place = F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("degree"), "name", "node"))
    more = free.withColumn("place", place).where(F.col("place") <= node_limit).orderBy("place", "chapter").limit(max(0, node_limit - len(chosen))).select("node")
    kept = materialize(sample.join(F.broadcast(first.unionByName(more)), "node", "left_semi"))
    inside = {r.node for r in kept.select("node").collect()}
    out = _taken(ranked, rows)
    if len(rows) < edge_limit:
        seen = _members(ranked, inside).where("in_source and in_target").join(F.broadcast(out.select("source", "target", "rel_type")), ["source", "target", "rel_type"], "left_anti")
        out = out.unionByName(seen.select(*out.columns).orderBy("rank_key").limit(edge_limit - len(rows)))
    return kept.select("node", "name", "chapter", "degree"), out.select("source", "target", "rel_type")


def fusion_sample(nodes: DataFrame, edges: DataFrame, node_limit: int = 1000, edge_limit: int = 3000) -> tuple[DataFrame, DataFrame]:
    """WIN-09, GRAPH-14: nodes (no, id, label, text) and edges (no, source, target, type, weight) within the limits; no is the input's order.

    The first of equal ids, and of edges of equal ends and type, counts; edges without both ends go. Edges rank by the bonus of
    their type plus weight, then by the larger degree of their ends; free places go to the first nodes in order (to
    those of the highest degree where no edge fits). All edges between chosen nodes come back, the best first.
    """
    node_limit, edge_limit = max(1, node_limit), max(1, edge_limit)
    named = nodes.withColumn("id", F.trim("id")).where("id != ''")
    named = materialize(named.groupBy("id").agg(F.min_by(F.struct("no", "label", "text"), "no").alias("n")).select("n.no", "id", "n.label", "n.text"))
    rows = edges.select("no", F.trim("source").alias("source"), F.trim("target").alias("target"), F.trim(F.coalesce("type", F.lit(""))).alias("type"), "weight")
    for end in ("source", "target"):
        rows = rows.join(named.select(F.col("id").alias(end)), end, "left_semi")
    rows = rows.groupBy("source", "target", "type").agg(F.min("no").alias("no"), F.min_by(F.coalesce("weight", F.lit(0.0)), "no").alias("weight"))
    rows = materialize(rows)
    degree = rows.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    if named.limit(node_limit + 1).count() <= node_limit and rows.limit(edge_limit + 1).count() <= edge_limit:
        return named, rows.select("source", "target", "type", "weight")
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_BONUS.items() for x in kv])[F.col("type")], F.lit(0))
    ends = [degree.select(F.col("id").alias(e), F.col("degree").alias(f"d_{e}")) for e in ("source", "target")]
    ranked = rows.join(ends[0], "source").join(ends[1], "target")
    key = F.struct((-bonus - F.col("weight")).alias("s"), (-F.greatest("d_source", "d_target")).alias("d"), "no")
    ranked = materialize(ranked.select("source", "target", "type", "weight", key.alias("rank_key")))
    _, chosen = greedy_edges(ranked, node_limit, edge_limit)
    first = nodes.sparkSession.createDataFrame([(n,) for n in chosen], "id string")
    free = named.join(F.broadcast(first), "id", "left_anti")
    if not chosen:
        free = free.join(degree, "id", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "no")
    else:
        free = free.orderBy("no")
    kept = materialize(named.join(F.broadcast(first.unionByName(free.limit(max(0, node_limit - len(chosen))).select("id"))), "id", "left_semi"))
    inside = _members(ranked, {r.id for r in kept.select("id").collect()}).where("in_source and in_target")
    return kept, inside.orderBy("rank_key").limit(edge_limit).select("source", "target", "type", "weight")
