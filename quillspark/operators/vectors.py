"""Vector operators and fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """VEC-05: 0 where a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def normalized(v: Column) -> Column:
    """VEC-01: unit length; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Queries, and numbers of the vectors, that one task of a block join holds.
QUERIES_PER_BLOCK = 4096
VALUES_PER_BLOCK = 1 << 20


def cross_group_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """VEC-02, WIN-01: the k nearest rows of other groups by inner product, for each query row.

    vectors and queries: (node_id, paper_id, vec). The stated queries meet all rows block by block, in
    numpy. The numbers of blocks follow the row counts, and rows are dealt by id and vector together,
    so a task is of one size whatever the tables; only k rows of each query leave it. Ids of queries are distinct.
    """
    import numpy as np
    import pandas as pd

    rows, width = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    row_blocks = max(1, -(-rows * max(1, width or 1) // VALUES_PER_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(d):
            data = np.stack(d["vec"].to_numpy()).astype(float).T
            ids, groups = d["node_id"].to_numpy(), d["paper_id"].to_numpy()
            for begin in range(0, len(q), 128):
                part = q.iloc[begin : begin + 128]
                score = np.round(np.stack(part["vec"].to_numpy()).astype(float) @ data, 6)
                for i, (node, group) in enumerate(zip(part["node_id"], part["paper_id"], strict=True)):
                    ok = np.flatnonzero(groups != group)
                    if len(ok) > k:  # all rows from the k-th score on, ties included
                        ok = ok[score[i, ok] >= -np.partition(-score[i, ok], k - 1)[k - 1]]
                    best = ok[np.lexsort((ids[ok], -score[i, ok]))[:k]]
                    out += [(node, ids[j], score[i, j]) for j in best]
        return pd.DataFrame(out, columns=["src", "dst", "score"]).astype({"src": "int64", "dst": "int64", "score": "float64"})

    def side(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("node_id", "vec"), F.lit(blocks)).cast("int")
        return df.select(block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), "node_id", "paper_id", "vec").groupBy("qb", "db")

    asked, held = side(queries, "qb", query_blocks, "db", row_blocks), side(vectors, "db", row_blocks, "qb", query_blocks)
    local = asked.cogroup(held).applyInPandas(solve, "src long, dst long, score double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def duplicates_in_group(rows: DataFrame, group: str, least: float, most: int = 200) -> DataFrame:
    """VEC-06: pairs of a group with cosine from `least` on, for groups of 2 to `most` rows."""
    size = F.count("*").over(Window.partitionBy(group))
    fit = rows.withColumn("_n", size).where((F.col("_n") >= 2) & (F.col("_n") <= most))
    a = fit.select(group, F.col("node_id").alias("a"), F.col("vec").alias("va"))
    b = fit.select(group, F.col("node_id").alias("b"), F.col("vec").alias("vb"))
    scored = a.join(b, group).where("a < b").select(group, "a", "b", cosine(F.col("va"), F.col("vb")).alias("score"))
    return scored.where(F.col("score") >= least)


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, order: list[Column], k: int = 60, depth: int = 200) -> DataFrame:
    """VEC-08: sum over the first `depth` rows of the lists of 1 / (k + rank). A repeated key counts once in a list but still takes a rank."""
    scored = []
    for i, x in enumerate(lists):
        rank = F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(*order))
        scored.append(x.orderBy(*order).limit(depth).withColumn("_r", rank).groupBy(key).agg(F.min("_r").alias("_r")).withColumn("_s", 1 / (k + F.col("_r"))))
    return reduce(lambda a, b: a.unionByName(b), scored).groupBy(key).agg(F.sum("_s").alias("score"), F.count("*").alias("lists"))


def basics_rank(rows: DataFrame, k: int) -> DataFrame:
    """VEC-09: 0.45 score + 0.35 overlap + 0.20 hint, best first, ties by score and name."""
    final = F.round(0.45 * F.col("score") + 0.35 * F.col("overlap") + 0.20 * F.col("hint"), 6)
    return rows.withColumn("final", final).orderBy(F.desc("final"), F.desc("score"), "name").limit(k)


#: The channels that a plan asks for twice the rows, and those that it asks for two more.
PLAN_CHANNELS = {
    "paper_first_then_textbook": (["logic_step", "claim"], []),
    "textbook_first_then_paper": (["community", "textbook"], []),
    "claim_first": (["claim"], ["logic_step"]),
    "community_first": (["community"], ["textbook"]),
    "hybrid_parallel": ([], ["logic_step", "claim", "community", "textbook"]),
}


def channel_limits(plans: DataFrame, want: Column) -> DataFrame:
    """VEC-10: rows (plan, ...) with the number of rows to fetch from each channel; an unknown plan favours none."""
    base = F.greatest(F.lit(2), want + 1)

    def limit(channel: str) -> Column:
        twice = [p for p, (most, _) in PLAN_CHANNELS.items() if channel in most]
        more = [p for p, (_, some) in PLAN_CHANNELS.items() if channel in some]
        plan = F.col("plan")
        return F.when(plan.isin(twice), F.greatest(base + 1, 2 * want)).when(plan.isin(more), F.greatest(base, want + 2)).otherwise(base)

    return plans.withColumns({c: limit(c) for c in ("logic_step", "claim", "community", "textbook")})


def retrieval_route(enabled: Column, available: Column) -> Column:
    """VEC-14: (mode, reason) of a question: the page index where it is on and there; available is null where the probe failed."""
    reason = F.when(~enabled, "disabled").when(available.isNull(), "adapter_error").when(~available, "adapter_unavailable").otherwise("adapter_ready")
    return F.struct(F.when(reason == "adapter_ready", "pageindex").otherwise("fallback").alias("mode"), reason.alias("reason"))


def include_minority(atoms: DataFrame, least_models: int = 2, least: float = 0.5) -> DataFrame:
    """VEC-15, SET-05: atoms (key, model, vec) of enough models, and others whose best cosine to those reaches `least`."""
    keys = atoms.groupBy("key").agg(F.count_distinct("model").alias("models"), F.min_by("vec", "model").alias("vec"))
    major, minor = keys.where(F.col("models") >= least_models), keys.where(F.col("models") < least_models)
    rows = lambda df, p: df.select(F.lit(p).alias("paper_id"), F.col("key").alias("node_id"), F.col("vec"))
    best = cross_group_topk(rows(major, 0), rows(minor, 1), 1).where(F.col("score") >= least)
    return major.select("key", F.lit("majority").alias("why")).unionByName(best.select(F.col("src").alias("key"), F.lit("similar").alias("why")))
