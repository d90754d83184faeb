"""Queries of windows, vectors and retrieval fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import relational as r
from quillspark.operators import vectors as v
from quillspark.operators import windows as w
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import table

_DOT = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@register(
    "knn_cross_label",
    fx.sql("vector") + f""", s AS (SELECT a.node_id AS src, b.node_id AS dst, round({_DOT}, 6) AS score FROM vector a JOIN vector b ON a.paper_id <> b.paper_id WHERE a.node_id % 20 = 0),
    q AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst)::INT AS rank FROM s) SELECT src, dst, score, rank FROM q WHERE rank <= 3""",
)
def knn_cross_label(spark, d):
    """VEC-01..03, WIN-01: nearest neighbours under another label; queries are the ids divisible by 20."""
    x = fx.vectors(spark, d)
    return v.cross_group_topk(x, x.where("node_id % 20 = 0"), 3)


@register(
    "duplicate_observation",
    """WITH g AS (SELECT vec_id AS node_id, vec_id // 100 AS grp, embedding AS vec FROM embeddings), n AS (SELECT grp FROM g GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200),
    s AS (SELECT grp, a.node_id AS a, b.node_id AS b, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
      / (sqrt(list_sum(list_transform(a.vec, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.vec, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM g a JOIN g b USING (grp) SEMI JOIN n USING (grp) WHERE a.node_id < b.node_id)
    SELECT grp, a, b, round(score, 5) AS score FROM s WHERE score >= 0.2""",
)
def duplicate_observation(spark, d):
    """VEC-05, VEC-06: groups of neighbouring ids, which hold like numbers of rows in any table."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.expr("vec_id div 100").alias("grp"), F.col("embedding").alias("vec"))
    return v.duplicates_in_group(rows, "grp", 0.2).withColumn("score", F.round("score", 5))


@register(
    "rrf_fusion",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'en' QUALIFY r <= 200), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE source IN ('src1','src2') QUALIFY r <= 200),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score, count(*) AS lists FROM u GROUP BY 1""",
)
def rrf_fusion(spark, d):
    """VEC-08, VEC-13: two rankings fused."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    lists = [docs.where("lang = 'en'"), docs.where("source in ('src1', 'src2')")]
    return v.reciprocal_rank_fusion(lists, "doc_id", [F.desc("n_chars"), F.col("doc_id")]).withColumn("score", F.round("score", 8))


@register(
    "basics_ranking",
    "SELECT p_partkey AS id, round(0.45 * (p_size / 50.0)::DOUBLE + 0.35 * (p_partkey % 10 / 10.0)::DOUBLE + 0.20 * (p_size % 2), 6) AS final FROM part ORDER BY final DESC, p_size / 50.0 DESC, p_name, p_partkey LIMIT 40",
)
def basics_ranking(spark, d):
    """VEC-09"""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("score"), (F.col("p_partkey") % 10 / 10).alias("overlap"), (F.col("p_size") % 2).alias("hint"), F.concat("p_name", F.lpad("p_partkey", 12, "0")).alias("name"))
    return v.basics_rank(rows, 40).select("id", "final")


@register(
    "round_robin_channels",
    fx.sql("claim") + """, t AS (SELECT *, row_number() OVER (PARTITION BY step_type ORDER BY confidence DESC, claim_id) AS turn, list_position(['Method','Result','Problem','Background'], step_type) AS place FROM claim WHERE step_type IN ('Method','Result','Problem','Background'))
    SELECT claim_id, step_type, turn::INT AS turn FROM t ORDER BY turn, place LIMIT 30""",
)
def round_robin_channels(spark, d):
    """WIN-10, VEC-11"""
    plan = ["Method", "Result", "Problem", "Background"]
    rows = fx.claims(spark, d).where(F.col("step_type").isin(plan))
    return w.round_robin(rows, "step_type", [F.desc("confidence"), F.col("claim_id")], "claim_id", 30, plan).select("claim_id", "step_type", "turn")


@register(
    "priority_channels",
    fx.sql("claim") + """, p AS (SELECT claim_id, step_type, list_position(['Result','Method','Problem'], step_type) AS place, confidence FROM claim WHERE step_type IN ('Result','Method','Problem') AND confidence > 0.9)
    SELECT claim_id, step_type FROM p ORDER BY place, confidence DESC, claim_id LIMIT 25""",
)
def priority_channels(spark, d):
    """SET-04: channels one after the other, the first (kind, id) wins."""
    plan = F.array(F.lit("Result"), F.lit("Method"), F.lit("Problem"))
    rows = fx.claims(spark, d).withColumn("place", F.array_position(plan, F.col("step_type"))).where("place > 0 and confidence > 0.9")
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("step_type", "claim_id").orderBy("pos"))).where("_n = 1")
    return once.orderBy("place", F.desc("confidence"), "claim_id").limit(25).select("claim_id", "step_type")


@register(
    "query_coverage",
    r"""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_:+./-]+|[\x{4e00}-\x{9fff}]+')) AS t FROM benchmark), q AS (SELECT regexp_extract_all('the the in onthe of thing by', '[a-z0-9_:+./-]+') AS q)
    SELECT item_id, round(len(list_filter(q, lambda x: list_contains(t, x))) / len(list_distinct(q))::DOUBLE, 6) AS score FROM b CROSS JOIN q""",
)
def query_coverage(spark, d):
    """STR-18"""
    q = F.array(*[F.lit(x) for x in "the the in onthe of thing by".split()])
    return table(spark, d, "benchmark").select("item_id", F.round(tx.coverage(q, F.array_distinct(tx.structured_tokens(F.col("text")))), 6).alias("score"))


@register(
    "jaccard_pairs",
    r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{4e00}-\x{9fff}]+')) AS s FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE, 6) AS score FROM t a JOIN t b ON a.item_id < b.item_id
    WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE >= 0.15""",
)
def jaccard_pairs(spark, d):
    """STR-16: pairs found through the rarest of their shared tokens."""
    sets = table(spark, d, "benchmark").select("item_id", tx.token_set(F.col("text")).alias("s"))
    return r.jaccard_join(sets, "item_id", 0.15).select("a", "b", F.round("score", 6).alias("score"))


@register("next_context", "SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations")
def next_context(spark, d):
    """WIN-05"""
    return table(spark, d, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_text"))


@register(
    "consecutive_steps",
    fx.sql("step") + ", n AS (SELECT paper_id, logic_step_id AS src, lead(logic_step_id) OVER (PARTITION BY paper_id ORDER BY step_order) AS next FROM step) SELECT paper_id, src, next FROM n WHERE next IS NOT NULL",
)
def consecutive_steps(spark, d):
    """WIN-06, SINK-02: NEXT edges."""
    return w.consecutive(fx.logic_steps(spark, d), "paper_id", "step_order", "logic_step_id").select("paper_id", F.col("logic_step_id").alias("src"), "next")


@register(
    "membership_cap",
    """WITH m AS (SELECT l_suppkey AS node_id, l_partkey % 40 AS community_id, sum(l_discount) AS weight FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(weight, 6) DESC, community_id)::INT AS rank FROM m), k AS (SELECT *, count(*) OVER (PARTITION BY community_id) AS size FROM r WHERE rank <= 2)
    SELECT node_id, community_id, rank, size FROM k WHERE size >= 4""",
)
def membership_cap(spark, d):
    """WIN-04, GRAPH-09"""
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node_id"), (F.col("l_partkey") % 40).alias("community_id")).agg(F.round(F.sum("l_discount"), 6).alias("weight"))
    return w.capped_membership(m, 2, 4).select("node_id", "community_id", "rank", "size")


@register(
    "network_backbone",
    """WITH n AS (SELECT c_custkey AS id, (1990 + c_custkey % 30)::INT AS year FROM customer), e AS (SELECT o_custkey AS source, (o_orderkey * 7) % 150 AS target, count(*) AS m FROM orders WHERE o_totalprice > 300000 GROUP BY 1, 2),
    u AS (SELECT source AS id, target AS other, m FROM e UNION ALL SELECT target, source, m FROM e), s AS (SELECT id, count(DISTINCT other) AS degree, sum(m)::BIGINT AS mentions FROM u WHERE id <> other GROUP BY 1),
    j AS (SELECT n.*, coalesce(degree, 0) AS degree, coalesce(mentions, 0) AS mentions FROM n LEFT JOIN s USING (id)),
    k AS (SELECT *, round(20 * degree + 6 * ln(1 + mentions) + 2 * (year - 1990) / 29.0::DOUBLE, 6) AS score FROM j)
    SELECT id, year, degree, mentions, score FROM k ORDER BY (degree = 0)::INT, CASE WHEN degree > 0 THEN score ELSE year END DESC, degree DESC, mentions DESC, id DESC LIMIT 60""",
)
def network_backbone(spark, d):
    """WIN-12, GRAPH-01"""
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (1990 + F.col("c_custkey") % 30).cast("int").alias("year"))
    e = table(spark, d, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("source"), (F.col("o_orderkey") * 7 % 150).alias("target")).agg(F.count("*").alias("total_mentions"))
    return w.backbone(n, e, 60).select("id", "year", "degree", "mentions", "score")


@register(
    "task_retention",
    """WITH t AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'active' END AS status, o_orderdate AS updated FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY status = 'finished' ORDER BY updated DESC, task_id) AS n FROM t) SELECT task_id, status FROM r WHERE status <> 'finished' OR n <= 10""",
)
def task_retention(spark, d):
    """WIN-14"""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("active").alias("status"), F.col("o_orderdate").alias("updated"))
    return w.retention(t, 10).select("task_id", "status")


@register(
    "char_budget_batches",
    fx.sql("chunk").replace("WITH ", "WITH RECURSIVE ", 1) + """, x AS MATERIALIZED (SELECT paper_id, pos, length(text) AS n FROM chunk), r(paper_id, pos, batch, held, k) AS (SELECT paper_id, pos, 0, n, 1 FROM x WHERE pos = 0
      UNION ALL SELECT x.paper_id, x.pos, CASE WHEN held + n > 1500 OR k >= 4 THEN batch + 1 ELSE batch END, CASE WHEN held + n > 1500 OR k >= 4 THEN n ELSE held + n END, CASE WHEN held + n > 1500 OR k >= 4 THEN 1 ELSE k + 1 END
      FROM r JOIN x ON x.paper_id = r.paper_id AND x.pos = r.pos + 1) SELECT paper_id, pos, batch FROM r""",
)
def char_budget_batches(spark, d):
    """WIN-11"""
    return w.char_budget_batches(fx.chunks(spark, d), "paper_id", "pos", 1500, 4)


@register("degree_capped_graph")
def degree_capped_graph(spark, d):
    """WIN-08, GRAPH-08: exact greedy selection over the whole graph of suppliers and parts, in rounds of joins."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 10_000_000_000).alias("target")).agg(F.round(F.sum("l_discount"), 6).alias("weight"))
    return w.degree_capped(e, 8)


_PLANS = ["paper_first_then_textbook", "textbook_first_then_paper", "claim_first", "community_first", "hybrid_parallel", "other"]


@register(
    "channel_limits",
    f"""WITH p AS (SELECT o_orderkey, ({_PLANS})[o_custkey % 6 + 1] AS plan, o_orderkey % 9 AS want FROM orders), b AS (SELECT *, greatest(2, want + 1) AS base FROM p)
    SELECT o_orderkey, plan, CASE plan WHEN 'paper_first_then_textbook' THEN greatest(base + 1, 2 * want) WHEN 'claim_first' THEN greatest(base, want + 2) WHEN 'hybrid_parallel' THEN greatest(base, want + 2) ELSE base END AS logic_step,
    CASE WHEN plan IN ('paper_first_then_textbook', 'claim_first') THEN greatest(base + 1, 2 * want) WHEN plan = 'hybrid_parallel' THEN greatest(base, want + 2) ELSE base END AS claim,
    CASE WHEN plan IN ('textbook_first_then_paper', 'community_first') THEN greatest(base + 1, 2 * want) WHEN plan = 'hybrid_parallel' THEN greatest(base, want + 2) ELSE base END AS community,
    CASE WHEN plan = 'textbook_first_then_paper' THEN greatest(base + 1, 2 * want) WHEN plan IN ('community_first', 'hybrid_parallel') THEN greatest(base, want + 2) ELSE base END AS textbook FROM b""",
)
def channel_limits(spark, d):
    """VEC-10: how many rows each channel gives a question, by its plan."""
    plan = F.array(*map(F.lit, _PLANS))[(F.col("o_custkey") % 6).cast("int")]
    plans = table(spark, d, "orders").select("o_orderkey", plan.alias("plan"), (F.col("o_orderkey") % 9).alias("want"))
    return v.channel_limits(plans, F.col("want")).drop("want")


@register(
    "retrieval_route",
    "SELECT item_id, CASE WHEN item_id % 2 = 1 AND item_id % 3 = 0 THEN 'pageindex' ELSE 'fallback' END AS mode, CASE WHEN item_id % 2 = 0 THEN 'disabled' ELSE (['adapter_ready','adapter_unavailable','adapter_error'])[item_id % 3 + 1] END AS reason FROM benchmark",
)
def retrieval_route(spark, d):
    """VEC-14: where a question goes, by what is on and there."""
    i = F.col("item_id")
    route = v.retrieval_route(i % 2 == 1, F.when(i % 3 == 0, True).when(i % 3 == 1, False))
    return table(spark, d, "benchmark").select("item_id", route.alias("r")).select("item_id", "r.*")


@register(
    "mutual_top_edges",
    """WITH e AS (SELECT l_suppkey AS source, l_partkey + 100000 AS target, round(sum(l_discount), 6) AS weight FROM lineitem GROUP BY 1, 2),
    u AS (SELECT *, source AS n FROM e UNION ALL SELECT *, target FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY weight DESC, source, target) AS k FROM u)
    SELECT source, target, weight FROM r GROUP BY ALL HAVING max(k) <= 8""",
)
def mutual_top_edges(spark, d):
    """WIN-08, the scalable subset"""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 100000).alias("target")).agg(F.round(F.sum("l_discount"), 6).alias("weight"))
    return w.mutual_top(e, 8)


@register(
    "conversation_fold",
    r"""WITH q AS (SELECT conv_id, turn, role, regexp_replace(trim(text), '\s+', ' ', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    SELECT conv_id, string_agg(role || ': ' || left(text, 400), chr(10) ORDER BY turn) AS folded FROM q WHERE rn <= 4 GROUP BY 1""",
)
def conversation_fold(spark, d):
    """STR-24: the last four turns of each conversation, in order."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", tx.compact_whitespace(F.col("text")).alias("text"))
    last = w.top_per(rows, "conv_id", [F.desc("turn")], 4)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 400)).alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("folded"))


@register(
    "minority_atoms",
    """WITH k AS (SELECT vec_id AS key, vec_id % 3 > 0 AS many, embedding AS vec FROM embeddings), s AS (SELECT b.key, max(round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6)) AS best
      FROM k a JOIN k b ON a.many AND NOT b.many GROUP BY 1)
    SELECT key, 'majority' AS why FROM k WHERE many UNION ALL SELECT key, 'similar' FROM s WHERE best >= 0.4""",
)
def minority_atoms(spark, d):
    """VEC-15, SET-05"""
    models = F.when(F.col("vec_id") % 3 > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    atoms = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.explode(models).alias("model"), F.col("embedding").alias("vec"))
    return v.include_minority(atoms, 2, 0.4)
