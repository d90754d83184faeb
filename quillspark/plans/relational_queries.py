"""Queries of filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import relational as r
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import spread, table

def _lex(col: str, words: list[str]) -> str:
    one = "CASE WHEN {o} > 0 THEN 1 + 0.3::DOUBLE * least(5, {o}) ELSE 0 END"
    return " + ".join(one.format(o=f"((length(lower({col})) - length(replace(lower({col}), '{t}', ''))) // {len(t)})") for t in words)


@register(
    "lexical_topk",
    fx.sql("chunk", "paper")
    + f""", s AS (SELECT chunk_id, paper_id, round({_lex('text', ['thing', 'that'])}, 6) AS score FROM chunk)
    SELECT chunk_id, s.paper_id, score, paper_source, year FROM s JOIN paper USING (paper_id)
    WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 50""",
)
def lexical_topk(spark, d):
    """STR-17, WIN-13, JOIN-01: the best chunks for a fixed question, with their papers' metadata."""
    scored = fx.chunks(spark, d).select("chunk_id", "paper_id", F.round(tx.lexical_score(F.col("text"), ["thing", "that"]), 6).alias("score")).where("score > 0")
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(50)
    meta = fx.papers(spark, d).select("paper_id", "paper_source", "year")
    return best.join(meta, "paper_id").select("chunk_id", "paper_id", "score", "paper_source", "year")


@register("paper_search", fx.sql("paper") + " SELECT paper_id, title, year FROM paper WHERE contains(lower(coalesce(title, '')), 'thing') OR contains(lower(paper_source), 'thing') ORDER BY year DESC, paper_id LIMIT 20")
def paper_search(spark, d):
    """FIL-01"""
    return r.search(fx.papers(spark, d), " Thing ", ["title", "paper_source"], 20).select("paper_id", "title", "year")


_MEMBERS = "m AS (SELECT doc_id AS paper_id, 'q' || quality AS collection_id FROM labels)"


def _members(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("q"), "quality").alias("collection_id"))


@register(
    "management_list",
    fx.sql("paper") + f""", {_MEMBERS}, g AS (SELECT paper_id, list_sort(list(collection_id)) AS c FROM m GROUP BY paper_id)
    SELECT paper_id, coalesce(nullif(trim(title), ''), nullif(trim(paper_source), ''), paper_id::VARCHAR) AS display_title, year, array_to_string(c, ';') AS collections
    FROM paper LEFT JOIN g USING (paper_id)""",
)
def management_list(spark, d):
    """FIL-02"""
    out = r.management_list(fx.papers(spark, d), _members(spark, d))
    return out.withColumn("collections", F.when(F.size("collections") > 0, F.array_join("collections", ";")))


@register("uncategorised_papers", fx.sql("paper") + f", {_MEMBERS} SELECT paper_id, paper_source FROM paper WHERE paper_id NOT IN (SELECT paper_id FROM m)")
def uncategorised_papers(spark, d):
    """FIL-03, JOIN-16, SET-06"""
    return r.uncategorised(fx.papers(spark, d), _members(spark, d)).select("paper_id", "paper_source")


@register("papers_by_ids", fx.sql("paper") + f", {_MEMBERS} SELECT paper_id, year FROM paper WHERE paper_id IN (SELECT paper_id FROM m WHERE collection_id = 'q0')")
def papers_by_ids(spark, d):
    """FIL-04, VEC-16"""
    return r.in_ids(fx.papers(spark, d), _members(spark, d).where("collection_id = 'q0'"), "paper_id").select("paper_id", "year")


@register(
    "unresolved_citations",
    "SELECT o_custkey AS src, count(*) AS mentions FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1",
)
def unresolved_citations(spark, d):
    """FIL-05: cited but not among the registered works, with their mentions."""
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("src"))
    cites = table(spark, d, "orders").select(F.col("o_custkey").alias("src"))
    return cites.join(known, "src", "left_anti").groupBy("src").agg(F.count("*").alias("mentions"))


@register(
    "gap_like_claims",
    fx.sql("claim") + " SELECT claim_id, paper_id, step_type, confidence FROM claim WHERE list_has_any(kinds, ['Gap','Limitation'])",
)
def gap_like_claims(spark, d):
    """FIL-06"""
    hit = F.arrays_overlap("kinds", F.array(F.lit("Gap"), F.lit("Limitation")))
    return fx.claims(spark, d).where(hit).select("claim_id", "paper_id", "step_type", "confidence")


@register(
    "candidate_chunks",
    fx.sql("chunk") + """, s AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY pos) AS section FROM chunk)
    SELECT chunk_id, section FROM s WHERE kind <> 'heading' AND trim(text) <> ''
    AND NOT (contains(regexp_replace(lower(coalesce(section, '')), '[\\s_\\-:：]+', '', 'g'), 'thethe') OR contains(lower(coalesce(section, '')), 'thethe'))""",
)
def candidate_chunks(spark, d):
    """FIL-07, WIN-07: chunks under their last heading, without those of excluded sections."""
    cursor = Window.partitionBy("paper_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = fx.chunks(spark, d).withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(cursor))
    return r.candidate_chunks(rows, ["thethe"]).select("chunk_id", "section")


@register(
    "caption_filter",
    fx.sql("chunk") + r" SELECT chunk_id FROM chunk WHERE regexp_matches(text, '(?i)^\s*(?:supplementary\s+)?(?:figure|fig\.?|table|scheme|图|表)\s*[0-9a-z]*\s*[.:|]')",
)
def caption_filter(spark, d):
    """FIL-08"""
    return fx.chunks(spark, d).where(r.is_caption(F.col("text"))).select("chunk_id")


@register(
    "batch_validated_claims",
    fx.sql("claim") + """, q AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY claim_id) AS rn FROM claim)
    SELECT claim_id, step_type, array_to_string(list_filter(kinds, lambda k: k IN ('Gap','Result')), ';') AS kinds, confidence FROM q WHERE rn <= 3 AND step_type IN ('Method','Result','Problem')""",
)
def batch_validated_claims(spark, d):
    """FIL-11: the first three claims of each unit, validated."""
    units = fx.claims(spark, d).withColumn("chunk_id", F.col("paper_id"))
    out = r.batch_validated(units, ["Method", "Result", "Problem"], ["Gap", "Result"], 3)
    return out.select("claim_id", "step_type", F.array_join("kinds", ";").alias("kinds"), "confidence")


@register(
    "prefixed_id_buckets",
    """WITH i AS (SELECT (['CL','GC','CH'])[doc_id % 3 + 1] || ':' || source AS id FROM documents)
    SELECT split_part(id, ':', 1) AS bucket, array_to_string(list_sort(list(DISTINCT substr(id, instr(id, ':') + 1))), ';') AS ids FROM i GROUP BY 1""",
)
def prefixed_id_buckets(spark, d):
    """FIL-18"""
    kinds = F.array(F.lit("CL"), F.lit("GC"), F.lit("CH"))
    ids = table(spark, d, "documents").select(F.concat(kinds[(F.col("doc_id") % 3).cast("int")], F.lit(":"), "source").alias("id"))
    return r.split_prefixed(ids).withColumn("ids", F.array_join("ids", ";"))


@register(
    "human_overrides",
    """WITH m AS (SELECT doc_id, lang AS value FROM documents), h AS (SELECT doc_id, 'human' || toxic AS value, quality = 0 AS cleared FROM labels)
    SELECT doc_id, CASE WHEN coalesce(cleared, false) THEN NULL ELSE coalesce(h.value, m.value) END AS value,
    CASE WHEN coalesce(cleared, false) THEN 'cleared' WHEN h.value IS NOT NULL THEN 'human' ELSE 'machine' END AS source FROM m FULL JOIN h USING (doc_id)""",
)
def human_overrides(spark, d):
    """FIL-19, FIL-20, SINK-08, EXT-25"""
    machine = table(spark, d, "documents").select("doc_id", F.col("lang").alias("value"))
    human = table(spark, d, "labels").select("doc_id", F.concat(F.lit("human"), "toxic").alias("value"), (F.col("quality") == 0).alias("cleared"))
    return r.override_overlay(machine, human, "doc_id", "value")


@register("citation_edges", fx.sql("mention") + " SELECT src, dst, count(*) AS total_mentions FROM mention GROUP BY src, dst")
def citation_edges(spark, d):
    """AGG-01: mentions counted for each citing and cited pair."""
    return r.citation_edges(fx.mentions(spark, d))


@register(
    "neighbourhood_union",
    fx.sql("mention") + ", e AS (SELECT src, dst, count(*) AS total_mentions FROM mention GROUP BY src, dst) SELECT * FROM e WHERE src = 7 UNION SELECT * FROM e WHERE dst = 7",
)
def neighbourhood_union(spark, d):
    """SET-01, GRAPH-02"""
    return r.neighbourhood(r.citation_edges(fx.mentions(spark, d)), 7)


@register(
    "citation_pairs",
    fx.sql("mention") + " SELECT DISTINCT src, dst FROM mention WHERE src IN (SELECT doc_id FROM documents) AND dst IN (SELECT doc_id FROM documents)",
)
def citation_pairs(spark, d):
    """JOIN-05"""
    return r.citation_pairs(fx.mentions(spark, d), fx.papers(spark, d))


@register(
    "structured_lookup",
    fx.sql("claim") + """, q AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(confidence, -1) DESC, claim_id) AS rank FROM claim)
    SELECT paper_id, claim_id, confidence, rank::INT AS rank FROM q WHERE rank <= 5""",
)
def structured_lookup(spark, d):
    """JOIN-02, WIN-02, WIN-03: each paper's five surest claims."""
    w = Window.partitionBy("paper_id").orderBy(F.desc(F.coalesce("confidence", F.lit(-1.0))), "claim_id")
    return fx.claims(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("paper_id", "claim_id", "confidence", "rank")


_EXPLAINS = """x AS (SELECT l_partkey % 97 AS entity_id, l_suppkey AS step_id, l_suppkey % 5 AS paper_id, avg(l_discount) AS score FROM lineitem GROUP BY ALL)"""


def _explains(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_partkey") % 97).alias("entity_id"), F.col("l_suppkey").alias("step_id"), (F.col("l_suppkey") % 5).alias("paper_id")).agg(F.avg("l_discount").alias("score"))


@register(
    "shared_entity_edges",
    f"""WITH {_EXPLAINS} SELECT a.step_id AS a, b.step_id AS b, round(avg(a.score + b.score) / 2 + 0.05 * count(DISTINCT a.entity_id), 6) AS score
    FROM x a JOIN x b ON a.entity_id = b.entity_id AND a.step_id < b.step_id AND a.paper_id <> b.paper_id GROUP BY 1, 2""",
)
def shared_entity_edges(spark, d):
    """JOIN-04"""
    return r.shared_entity_edges(_explains(spark, d)).withColumn("score", F.round("score", 6))


@register(
    "cross_paper_top",
    """WITH p AS (SELECT l_suppkey AS src, l_partkey AS dst, max(l_discount) AS score FROM lineitem GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst)::INT AS rank FROM p WHERE score >= 0.05 AND src % 5 <> dst % 5)
    SELECT src, dst, score, rank FROM q WHERE rank <= 3""",
)
def cross_paper_top(spark, d):
    """JOIN-03: the three best targets in other papers for each source."""
    pairs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max("l_discount").alias("score"))
    pairs = pairs.withColumns({"paper_a": F.col("src") % 5, "paper_b": F.col("dst") % 5})
    return r.cross_pairs_top(pairs, "paper", 3, 0.05).select("src", "dst", "score", "rank")


@register(
    "citation_boost",
    """WITH s AS (SELECT l_orderkey AS edge, l_suppkey % 50 AS paper_a, l_partkey % 50 AS paper_b FROM lineitem WHERE l_suppkey % 50 <> l_partkey % 50),
    c AS (SELECT DISTINCT o_custkey % 50 AS src, o_orderkey % 7 AS dst FROM orders)
    SELECT edge, paper_a, paper_b FROM s WHERE EXISTS (SELECT 1 FROM c WHERE (src = paper_a AND dst = paper_b) OR (src = paper_b AND dst = paper_a))""",
)
def citation_boost(spark, d):
    """JOIN-06"""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edge"), (F.col("l_suppkey") % 50).alias("paper_a"), (F.col("l_partkey") % 50).alias("paper_b"))
    c = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 7).alias("dst"))
    return r.citation_boost(s.where("paper_a != paper_b"), c)


@register(
    "claim_first_step",
    fx.sql("step") + """, f AS (SELECT step_type, arg_min(logic_step_id, logic_step_id) AS logic_step_id FROM step GROUP BY step_type)
    SELECT claim_id, step_type, logic_step_id FROM claim JOIN f USING (step_type)""",
)
def claim_first_step(spark, d):
    """JOIN-08: every claim with the first step of its type."""
    steps = fx.logic_steps(spark, d).select("step_type", "logic_step_id", F.col("logic_step_id").alias("pos"))
    return r.first_match(fx.claims(spark, d).select("claim_id", "step_type"), steps, "step_type", "logic_step_id", "pos").select("claim_id", "step_type", "logic_step_id")


@register("claims_with_step", fx.sql("step") + " SELECT claim_id, logic_step_id, step_order FROM claim JOIN step USING (paper_id, step_type)")
def claims_with_step(spark, d):
    """JOIN-09, SINK-02: the key join of claims and steps."""
    return fx.claims(spark, d).join(fx.logic_steps(spark, d), ["paper_id", "step_type"]).select("claim_id", "logic_step_id", "step_order")


@register(
    "interval_blocks",
    fx.sql("chunk") + """, s AS (SELECT doc_id AS grp, doc_id % 3 AS a, doc_id % 3 + n_chars % 200 AS b, 's' || doc_id AS span_id FROM documents)
    SELECT chunk_id, span_id FROM chunk JOIN s ON paper_id = grp AND pos >= a AND pos < b""",
)
def interval_blocks(spark, d):
    """JOIN-13: blocks inside their section's span."""
    docs = table(spark, d, "documents")
    spans = docs.select(F.col("doc_id").alias("grp"), (F.col("doc_id") % 3).alias("a"), (F.col("doc_id") % 3 + F.col("n_chars") % 200).alias("b"), F.concat(F.lit("s"), "doc_id").alias("span_id"))
    points = fx.chunks(spark, d).select("chunk_id", F.col("paper_id").alias("grp"), F.col("pos").alias("idx"))
    return r.interval_join(points, spans).select("chunk_id", "span_id")


@register(
    "metadata_fill",
    """WITH l AS (SELECT doc_id, text, row_number() OVER () AS x FROM documents), f AS (SELECT source, arg_min(lang, doc_id) AS found FROM documents GROUP BY source)
    SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, found) AS lang FROM documents JOIN f USING (source)""",
)
def metadata_fill(spark, d):
    """JOIN-14: a missing value from the first row of the same source."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    return r.fill_by_first(rows, docs.select("source", F.col("doc_id").alias("pos"), "lang"), "source", "lang").select("doc_id", "lang")


@register(
    "pairs_sharing_topic",
    fx.sql("step") + r""", w AS (SELECT step_type, logic_step_id AS claim_id, unnest(list_distinct(regexp_extract_all(lower(summary), '[a-z]{7,}'))) AS token FROM step)
    SELECT a.step_type, a.claim_id AS a, b.claim_id AS b, count(*) AS shared FROM w a JOIN w b ON a.step_type = b.step_type AND a.token = b.token AND a.claim_id < b.claim_id
    GROUP BY ALL HAVING count(*) >= 12""",
)
def pairs_sharing_topic(spark, d):
    """JOIN-18: pairs within a step by shared topic tokens."""
    steps = fx.logic_steps(spark, d).withColumnRenamed("logic_step_id", "claim_id")
    return r.pairs_in_group(steps, ["step_type"], 12, F.regexp_extract_all(F.lower("summary"), F.lit("[a-z]{7,}"), F.lit(0)))


@register(
    "ordered_union",
    """WITH u AS (SELECT c_custkey AS id, 0 AS source_rank FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_totalprice > 400000)
    SELECT id, min(source_rank)::INT AS source_rank FROM u GROUP BY id""",
)
def ordered_union(spark, d):
    """SET-02"""
    a = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    b = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return r.ordered_union([a, b], "id", "id")


@register(
    "coauthor_pairs",
    """WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS weight FROM p a JOIN p b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2)
    SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e""",
)
def coauthor_pairs(spark, d):
    """SINK-01: co-author weights in both directions."""
    li = table(spark, d, "lineitem")
    n = li.count()
    p = spread(li.select("l_orderkey", "l_suppkey"), n, "l_orderkey").distinct()
    pairs = p.withColumnRenamed("l_suppkey", "a").join(p.withColumnRenamed("l_suppkey", "b"), "l_orderkey").where("a < b").select("a", "b")
    e = spread(pairs, 2 * n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    return e.select(F.inline(F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))))


@register(
    "explains_links",
    fx.sql("step") + r""", s AS (SELECT logic_step_id AS step_id, step_type, summary AS text, list_distinct(regexp_extract_all(lower(summary), '[a-z0-9\x{4e00}-\x{9fff}]+')) AS st FROM step),
    e AS (SELECT item_id AS entity_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS name, 'steel' AS entity_type FROM benchmark),
    f AS (SELECT *, list_distinct(regexp_extract_all(lower(name), '[a-z0-9\x{4e00}-\x{9fff}]+')) AS et FROM e),
    j AS (SELECT step_id, entity_id, step_type, text, name, len(list_intersect(st, et))::DOUBLE AS i, len(st) AS ns, len(et) AS ne FROM s JOIN f ON list_has_any(st, et)),
    k AS (SELECT *, i / (ns + ne - i) AS lex, i / ne AS cov FROM j),
    z AS (SELECT step_id, entity_id, round(0.25 * lex + 0.30 * cov + 0.20 * least(1.0, 0.6 * lex + 0.4 * cov)
      + 0.10 * (length(name) >= 4 AND contains(lower(text), lower(name)))::INT + 0.15 * CASE WHEN lower(step_type) IN ('method','experiment') THEN 1.0 ELSE 0.35 END, 6) AS score FROM k),
    q AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY score DESC, entity_id)::INT AS rank FROM z WHERE score >= 0.45)
    SELECT step_id, entity_id, score, rank FROM q WHERE rank <= 3""",
)
def explains_links(spark, d):
    """JOIN-07: steps linked to entities by token-blocked scoring."""
    s = fx.logic_steps(spark, d).select(F.col("logic_step_id").alias("step_id"), "step_type", F.col("summary").alias("text"))
    two = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    e = table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), two.alias("name"), F.lit("steel").alias("entity_type"))
    return r.token_blocked_links(s, e)
