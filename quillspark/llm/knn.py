"""Exact top-k search by inner product: a Voronoi kNN join.

1. A bounded number of PIVOTS, rows of the table that differ, cut the space into cells; each row
   belongs to the nearest pivot. A cell's rows are summed up in shells of growing distance to the
   pivot: how many rows, and the least and greatest distance.
2. For a query q, a row d of a shell around p scores between <q,p> - |q| r and <q,p> + |q| r. The
   pivots' own scores and the shells' lower bounds give a score that the k-th best cannot miss;
   cells whose upper bound stays below it hold nothing for q.
3. Queries are grouped by neighbouring cells into blocks of bounded size; a row is replicated to
   exactly the blocks one of whose queries may need its cell. Rows lie in splits of bounded size: a
   few neighbouring cells, or a part of a larger cell, so a hot cell, or a vector held by a third of
   all rows, spreads over many tasks. A query goes to those splits only that hold a cell it needs.
4. Each (block, split) is solved locally; the best k of every query are merged.

Vectors are compared as integers floor(scale * x). Null ids, null vectors, and vectors with a null
or non-finite component take no part; only vectors of one dimension, that of most rows, do.
Rows with equal ids are candidates each on its own, but never of their own id; a query id counts
once, with its least vector. Ties go to the smaller id. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

PIVOTS = 128
SHELLS = 32
QUERIES_PER_BLOCK = 16_384
MIN_BLOCKS = 8
ROWS_PER_SPLIT = 50_000
MIN_SPLITS = 16


def quantized(embeddings: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part; v holds integers."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    return embeddings.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim) if len(column) else np.empty((0, dim))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every partial sum is below 2^53, else in Python's integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    wide = a.astype(object) @ b.T.astype(object)
    wide = np.vectorize(int, otypes=[object])(wide) if wide.size else wide
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64) if wide.size else np.empty((len(a), len(b)), np.int64)


def _chain(pivots: np.ndarray) -> list[int]:
    """The cells in an order in which neighbours tend to follow each other."""
    left, order = set(range(1, len(pivots))), [0]
    while left:
        last = pivots[order[-1]]
        nearest = min(left, key=lambda j: (float(((pivots[j] - last) ** 2).sum()), j))
        order.append(nearest)
        left.remove(nearest)
    return order


def _splits(cell_rows: np.ndarray, order: list[int], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first split and number of splits of each cell, number of all): cells follow each other in splits of `most` rows, larger ones have several."""
    begin, parts, n, room = np.zeros(len(cell_rows), np.int64), np.ones(len(cell_rows), np.int64), 0, 0
    for c in order:
        rows = int(cell_rows[c])
        if rows > most:
            parts[c] = -(-rows // most)
            begin[c], n, room = n, n + int(parts[c]), 0
        else:
            if rows > room:
                n, room = n + 1, most
            begin[c], room = max(0, n - 1), room - rows
    return begin, parts, max(1, n)


def knn_join(embeddings: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows by inner product for each row for which is_query (over vec_id) holds."""
    schema = "query_id long, rank int, vec_id long, score long"
    spark = embeddings.sparkSession
    rows = quantized(embeddings, scale, id_col, vector_col)
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if dims is None or dims.dim == 0:
        return spark.createDataFrame([], schema)
    dim, total = dims
    rows = rows.where(F.size("v") == dim)
    mark = F.xxhash64("v")
    picked = rows.groupBy(F.pmod(mark, F.lit(PIVOTS)).alias("slot")).agg(F.min_by(F.struct("vec_id", "v"), mark).alias("p")).orderBy("slot").collect()  # PIVOTS rows at most
    pivots = np.array([r.p.v for r in picked])
    half_norms = (pivots**2).sum(1) / 2

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()) if len(b) else np.empty((0, dim))
            cell = np.argmax(x @ pivots.T - half_norms, 1).astype(np.int32)
            r = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pd.DataFrame({"vec_id": b["vec_id"], "cell": cell, "r": r, "v": [y.tobytes() for y in x]})

    placed = materialize(rows.mapInPandas(assign, "vec_id long, cell int, r double, v binary"))
    widest = placed.agg(F.max("r")).first()[0] or 1.0
    shell = F.least(F.floor(F.col("r") / F.lit(widest) * SHELLS), F.lit(SHELLS - 1)).cast("int")
    summary = np.array(
        [tuple(r) for r in placed.groupBy("cell", shell.alias("shell")).agg(F.count("*"), F.max("r")).orderBy("cell", "shell").collect()]  # PIVOTS x SHELLS rows at most
    )
    s_cell, s_count, s_radius = summary[:, 0].astype(int), summary[:, 2], summary[:, 3]
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, s_cell, s_radius)
    pivot_ids = np.array([r.p.vec_id for r in picked])

    asked = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q")).select("vec_id", "q.*")
    asked = materialize(asked)
    sizes = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # PIVOTS rows at most
    n_queries = sum(sizes.values())
    if not n_queries:
        return spark.createDataFrame([], schema)
    blocks = max(MIN_BLOCKS, -(-n_queries // QUERIES_PER_BLOCK))
    first_place = dict(zip(order := _chain(pivots), np.cumsum([0, *[sizes.get(c, 0) for c in order[:-1]]]).tolist(), strict=True))

    cell_rows = np.bincount(s_cell, s_count, len(pivots)).astype(np.int64)
    begin, parts, n_splits = _splits(cell_rows, order, min(ROWS_PER_SPLIT, -(-total // MIN_SPLITS)))
    held_by = np.zeros((len(pivots), n_splits), bool)
    for c in np.flatnonzero(cell_rows):
        held_by[c, begin[c] : begin[c] + parts[c]] = True

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The block of each query, a score that its k-th best reaches, and the splits it needs."""
        for b in batches:
            q = _matrix(b["v"], dim)
            inner, norm = q @ pivots.T, np.sqrt((q**2).sum(1))[:, None]
            slack = 1e-6 * (1 + np.abs(inner).max(initial=0) + norm * widest)
            floor = inner[:, s_cell] - norm * s_radius
            own = b["vec_id"].to_numpy()[:, None]
            order = np.argsort(-floor, 1)
            held = np.cumsum(s_count[order], 1)
            reached = np.argmax(held >= k + 1, 1)  # one row of them may be the query itself
            sure = np.where(held[:, -1] >= k + 1, np.take_along_axis(floor, order, 1)[np.arange(len(q)), reached], -np.inf)
            if len(pivots) > k:
                among = np.sort(np.where(own == pivot_ids, -np.inf, inner), 1)[:, -k]
                sure = np.maximum(sure, among)
            sure = sure - slack[:, 0]
            needed = inner + norm * radius + slack >= sure[:, None]
            # queries follow the chain of cells; within a cell, by a hash of the id, so that a hot cell has several blocks
            spread = (b["vec_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.float64) / 2**24
            size = np.array([sizes[c] for c in b["cell"]])
            place = np.array([first_place[c] for c in b["cell"]]) + spread * size
            block = np.minimum(place * blocks // n_queries, blocks - 1).astype(np.int32)
            cells = [np.packbits(x, bitorder="little").view(np.int64) for x in np.pad(needed, ((0, 0), (0, -len(pivots) % 64)))]
            splits = [np.flatnonzero(held_by[x].any(0)).astype(np.int32) for x in needed]
            yield pd.DataFrame({"block": block, "vec_id": b["vec_id"], "v": b["v"], "sure": sure, "cells": cells, "splits": splits})

    asked = materialize(asked.mapInPandas(bounded, "block int, vec_id long, v binary, sure double, cells array<long>, splits array<int>"))

    wanted = asked.groupBy("block").agg(F.array(*[F.bit_or(F.col("cells")[i]) for i in range(-(-len(pivots) // 64))]).alias("cells"))
    cell_blocks: list[list[int]] = [[] for _ in pivots]
    for r in wanted.collect():  # PIVOTS bits for each block of queries
        for c in np.flatnonzero(np.unpackbits(np.array(r.cells, np.int64).view(np.uint8), bitorder="little")).tolist():
            cell_blocks[c].append(r.block)

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, spread = b["cell"].to_numpy(), b["spread"].to_numpy()
            split = begin[cell] + spread % parts[cell]
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "split": split.astype(np.int32), "blocks": [cell_blocks[c] for c in cell]})

    spread = placed.select("vec_id", "cell", "v", F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 1).alias("spread"))
    data = spread.mapInPandas(replicate, "vec_id long, v binary, split int, blocks array<int>").select(F.explode("blocks").alias("block"), "split", "vec_id", "v")
    queries = asked.select("block", F.explode("splits").alias("split"), "vec_id", "v", "sure")

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64),) * 3]
        ids, vectors = d["vec_id"].to_numpy(), _matrix(d["v"], dim)
        for i in range(0, len(q), 512):
            part = q.iloc[i : i + 512]
            score = _products(_matrix(part["v"], dim), vectors)
            own, sure = part["vec_id"].to_numpy(), part["sure"].to_numpy()
            for j in range(len(part)):
                s = score[j]
                hit = np.flatnonzero((s >= sure[j]) & (ids != own[j]))
                if len(hit) > k:
                    hit = hit[s[hit] >= np.partition(s[hit], -k)[-k]]  # all ties of the k-th
                    hit = hit[np.lexsort((ids[hit], -s[hit]))[:k]]
                out.append((np.full(len(hit), own[j]), ids[hit], s[hit]))
        query, vec, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})

    local = queries.groupBy("block", "split").cogroup(data.groupBy("block", "split")).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_knn(spark, sf_dir: str) -> DataFrame:
    return knn_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


ORACLE_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
