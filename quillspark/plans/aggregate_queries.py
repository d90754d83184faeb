"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import aggregates as a
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import table


@register("first_references", "SELECT o_custkey % 50 AS paper_id, o_custkey % 7 AS ref_num, arg_min(o_orderpriority, o_orderkey) AS raw FROM orders GROUP BY 1, 2")
def first_references(spark, d):
    """AGG-01: the first reference of each number."""
    refs = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("paper_id"), (F.col("o_custkey") % 7).alias("ref_num"), F.col("o_orderpriority").alias("raw"), F.col("o_orderkey").alias("pos"))
    return a.first_references(refs)


@register(
    "cite_records",
    """WITH e AS (SELECT l_suppkey AS paper_id, l_partkey % 9 AS ref_num, l_orderkey || ':' || l_linenumber AS chunk_id, l_orderkey AS pos FROM lineitem),
    s AS (SELECT DISTINCT l_suppkey AS paper_id, l_partkey % 9 AS ref_num FROM lineitem),
    v AS (SELECT *, CASE WHEN ref_num % 4 = 3 THEN '' ELSE 'X' || ref_num // 2 END AS doi, ref_num / 10.0 AS confidence FROM s),
    j AS (SELECT e.*, coalesce('doi:' || CASE WHEN confidence >= 0.55 AND doi <> '' THEN lower(doi) END, 'ref:' || e.ref_num) AS target FROM e JOIN v USING (paper_id, ref_num)),
    q AS (SELECT *, row_number() OVER (PARTITION BY paper_id, target ORDER BY pos, chunk_id) AS rn FROM j)
    SELECT paper_id, target, count(*) AS total_mentions, array_to_string(list_sort(list(DISTINCT ref_num)), ';') AS ref_nums,
    string_agg(chunk_id, ';' ORDER BY rn) FILTER (rn <= 5) AS evidence FROM q GROUP BY 1, 2""",
)
def cite_records(spark, d):
    """AGG-01, CIT-01: citation events grouped by resolved work."""
    li = table(spark, d, "lineitem")
    events = li.select(F.col("l_suppkey").alias("paper_id"), (F.col("l_partkey") % 9).alias("ref_num"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("pos"))
    doi = F.when(F.col("ref_num") % 4 == 3, "").otherwise(F.concat(F.lit("X"), F.floor(F.col("ref_num") / 2)))
    resolved = events.select("paper_id", "ref_num").distinct().select("paper_id", "ref_num", doi.alias("doi"), (F.col("ref_num") / 10).alias("confidence"))
    out = a.cite_records(events, resolved)
    return out.select("paper_id", "target", "total_mentions", F.array_join("ref_nums", ";").alias("ref_nums"), F.array_join("evidence", ";").alias("evidence"))


_MERGED = r"""k AS (SELECT *, lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.;。；\s]+$', '')) AS key FROM claim),
o AS (SELECT paper_id, lower(step_type) AS step, key, max({'l': length(text), 't': text}).t AS text, list_sort(list_distinct(flatten(list(kinds)))) AS kinds,
  list_sort(list(DISTINCT chunk_id)) AS chunks, greatest(0.0, least(1.0, avg(confidence))) AS confidence FROM k GROUP BY 1, 2, 3),
p AS (SELECT *, coalesce(list_position(['background','problem','method','experiment','result','conclusion'], step), 7) AS place FROM o),
merged AS (SELECT paper_id, key, arg_min(step, place) AS step, arg_min(text, {'p': place, 't': text}) AS text, arg_min(kinds, {'p': place, 't': text}) AS kinds,
  list_sort(list_distinct(flatten(list(chunks)))) AS chunks, arg_min(confidence, {'p': place, 't': text}) AS confidence, count(*) AS merged_steps FROM p GROUP BY 1, 2)"""


def _merged(spark, d):
    return a.merge_claims(fx.claims(spark, d), fx.STEPS)


@register("claim_merge", fx.sql("claim") + f", {_MERGED} SELECT paper_id, step, text, array_to_string(kinds, ';') AS kinds, len(chunks) AS n_chunks, round(confidence, 6) AS confidence, merged_steps FROM merged")
def claim_merge(spark, d):
    """AGG-02"""
    return _merged(spark, d).select("paper_id", "step", "text", F.array_join("kinds", ";").alias("kinds"), F.size("chunks").cast("long").alias("n_chunks"), F.round("confidence", 6).alias("confidence"), "merged_steps")


@register(
    "slot_completeness",
    fx.sql("claim") + """, slot AS (SELECT * FROM (VALUES ('Background','Method'),('Method','Method'),('Result','Result'),('Conclusion','Gap'),('Problem','Gap')) t(step_type, kind)),
    h AS (SELECT DISTINCT paper_id, step_type, unnest(kinds) AS kind FROM claim), w AS (SELECT DISTINCT doc_id AS paper_id FROM documents),
    j AS (SELECT w.paper_id, slot.step_type, slot.kind, h.kind IS NOT NULL AS ok FROM w CROSS JOIN slot LEFT JOIN h ON h.paper_id = w.paper_id AND h.step_type = slot.step_type AND h.kind = slot.kind)
    SELECT paper_id, count(*) FILTER (ok) AS covered, count(*) AS total, coalesce(string_agg(step_type || '/' || kind, ';' ORDER BY step_type || '/' || kind) FILTER (NOT ok), '') AS missing,
    count(*) FILTER (ok) / count(*)::DOUBLE AS coverage FROM j GROUP BY 1""",
)
def slot_completeness(spark, d):
    """AGG-03"""
    slots = [("Background", "Method"), ("Method", "Method"), ("Result", "Result"), ("Conclusion", "Gap"), ("Problem", "Gap")]
    return a.slot_completeness(fx.claims(spark, d), slots, fx.papers(spark, d)).withColumn("missing", F.array_join("missing", ";"))


@register(
    "conflict_stats",
    fx.sql("step") + r""", w AS (SELECT step_type, logic_step_id AS claim_id, unnest(list_distinct(regexp_extract_all(lower(summary), '[a-z]{7,}'))) AS token FROM step),
    pr AS (SELECT a.claim_id AS a, b.claim_id AS b FROM w a JOIN w b ON a.step_type = b.step_type AND a.token = b.token AND a.claim_id < b.claim_id GROUP BY a.step_type, a.claim_id, b.claim_id HAVING count(*) >= 2),
    c AS (SELECT logic_step_id AS claim_id, sign(len(regexp_extract_all(lower(summary), '\b(?:the|thing)\w*')) - len(regexp_extract_all(lower(summary), '\b(?:that|and)\w*'))) AS p FROM step),
    j AS (SELECT x.p AS pa, y.p AS pb FROM pr JOIN c x ON x.claim_id = a JOIN c y ON y.claim_id = b WHERE x.p <> 0 AND y.p <> 0)
    SELECT count(*) AS comparable, count(*) FILTER (pa <> pb) AS conflicts, count(*) FILTER (pa <> pb) / count(*)::DOUBLE AS rate FROM j""",
)
def conflict_stats(spark, d):
    """AGG-04"""
    tokens = F.regexp_extract_all(F.lower("summary"), F.lit("[a-z]{7,}"), F.lit(0))
    return a.token_conflicts(fx.logic_steps(spark, d), ["step_type"], 2, tokens, a.polarity(F.col("summary"), r"\b(?:the|thing)\w*", r"\b(?:that|and)\w*"))


@register(
    "judged_conflicts",
    """WITH p AS (SELECT o_orderkey AS pair_id FROM orders), j AS (SELECT l_orderkey AS pair_id, (['contradict','not_conflict','insufficient'])[l_partkey % 3 + 1] AS label, l_discount * 10 AS score
      FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 5 > 0 UNION ALL SELECT 0 - c_custkey, 'contradict', 1.0 FROM customer),
    m AS (SELECT p.*, label, score FROM p LEFT JOIN j USING (pair_id))
    SELECT count(*) AS pairs, count(*) FILTER (label = 'contradict' AND score >= 0.5) AS contradictions, count(*) FILTER (label = 'insufficient') AS insufficient,
    count(*) FILTER (label IS NULL) AS missing, (SELECT count(*) FROM j WHERE pair_id NOT IN (SELECT pair_id FROM p)) AS unknown, 1 - count(*) FILTER (label IS NULL) / count(*)::DOUBLE AS coverage FROM m""",
)
def judged_conflicts(spark, d):
    """AGG-05, CIT-08"""
    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"))
    names = F.array(F.lit("contradict"), F.lit("not_conflict"), F.lit("insufficient"))
    li = table(spark, d, "lineitem").where("l_linenumber = 1 and l_partkey % 5 > 0")
    j = li.select(F.col("l_orderkey").alias("pair_id"), names[(F.col("l_partkey") % 3).cast("int")].alias("label"), (F.col("l_discount") * 10).alias("score"))
    extra = table(spark, d, "customer").select((-F.col("c_custkey")).alias("pair_id"), F.lit("contradict").alias("label"), F.lit(1.0).alias("score"))
    return a.judged_conflicts(pairs, j.unionByName(extra), 0.5)


@register(
    "quality_gates",
    """WITH t AS (SELECT source, avg((n_chars % 100) / 100.0) AS supported, avg((n_chars % 10) / 10.0) AS step, avg((doc_id % 9) / 10.0) AS slot, avg((n_chars % 7) / 6.0) AS conflict,
      avg(0.6 + (doc_id % 5) / 10.0) AS logic, count(*) AS comparable, count(*) FILTER (lang = 'en') AS conflicts FROM documents GROUP BY 1),
    f AS (SELECT source, list_filter([CASE WHEN supported < 0.72 THEN 'supported_low' END, CASE WHEN step < 0.55 THEN 'step_low' END, CASE WHEN slot < 0.65 THEN 'slot_low' END, CASE WHEN logic < 0.9 THEN 'logic_low' END,
      CASE WHEN comparable >= 3 AND conflicts >= 1 AND conflict > 0.2 THEN 'conflict_high' END], lambda x: x IS NOT NULL) AS r FROM t)
    SELECT source, array_to_string(r, ';') AS reasons, CASE len(r) WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS tier, greatest(0.0, 1 - len(r) / 5.0)::DOUBLE AS score FROM f""",
)
def quality_gates(spark, d):
    """AGG-06, AGG-07"""
    n, i = F.col("n_chars"), F.col("doc_id")
    reports = table(spark, d, "documents").groupBy("source").agg(
        F.avg(n % 100 / 100).alias("supported"), F.avg(n % 10 / 10).alias("step"), F.avg(i % 9 / 10).alias("slot"), F.avg(n % 7 / 6).alias("conflict"),
        F.avg(0.6 + i % 5 / 10).alias("logic"), F.count("*").alias("comparable"), F.count_if(F.col("lang") == "en").alias("conflicts"),
    )
    return a.quality_gates(reports, "strict").select("source", F.array_join("reasons", ";").alias("reasons"), "tier", "score")


@register(
    "keyword_topk",
    r"""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS token FROM documents), n AS (SELECT source, token, count(*) AS n FROM t GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token)::INT AS rank FROM n) SELECT source, token, n, rank FROM q WHERE rank <= 5""",
)
def keyword_topk(spark, d):
    """AGG-14"""
    tokens = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("token"))
    return a.keyword_top(tokens, "source", 5)


@register(
    "ngram_labels",
    r"""WITH w AS (SELECT lang, regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)?') AS w FROM documents),
    g AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM w WHERE len(w) >= 3
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) FROM w WHERE len(w) >= 2),
    n AS (SELECT lang, array_to_string(g, ' ') AS phrase, count(*) AS n FROM g WHERE len(list_filter(g, lambda t: t NOT IN ('the','and','of'))) > 0 GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(phrase) DESC, phrase DESC) AS rn FROM n) SELECT lang, phrase AS title, n FROM q WHERE rn = 1""",
)
def ngram_labels(spark, d):
    """AGG-13"""
    return a.ngram_label(table(spark, d, "documents").select("lang", "text"), "lang", ["the", "and", "of"])


@register(
    "label_histogram",
    """WITH r AS (SELECT l_suppkey AS key, unnest(['MethodUse', CASE WHEN l_linenumber % 2 = 0 THEN 'Survey' ELSE 'Theory' END]) AS label, unnest([l_discount, l_tax]) AS score FROM lineitem)
    SELECT key, label, max(score) AS score FROM r GROUP BY 1, 2""",
)
def label_histogram(spark, d):
    """AGG-15"""
    second = F.when(F.col("l_linenumber") % 2 == 0, "Survey").otherwise("Theory")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.array(F.lit("MethodUse"), second).alias("labels"), F.array("l_discount", "l_tax").alias("scores"))
    return a.label_histogram(rows, "key")


@register(
    "segment_merge",
    fx.sql("claim") + """, q AS (SELECT *, row_number() OVER (PARTITION BY paper_id, step_type ORDER BY confidence DESC, length(text) DESC, text DESC) AS rn FROM claim),
    e AS (SELECT paper_id, step_type, string_agg(chunk_id, ';' ORDER BY pos) AS evidence FROM claim GROUP BY 1, 2)
    SELECT paper_id, step_type, text AS summary, evidence FROM q JOIN e USING (paper_id, step_type) WHERE rn = 1""",
)
def segment_merge(spark, d):
    """AGG-24"""
    rows = fx.claims(spark, d).select("paper_id", "step_type", F.col("text").alias("summary"), "confidence", "pos", F.array("chunk_id").alias("evidence"))
    return a.merge_segments(rows).withColumn("evidence", F.array_join("evidence", ";"))


@register(
    "recurrence_state",
    """WITH s AS (SELECT event_type || ':' || (floor(value)::BIGINT % 5) AS signature, user_id AS node FROM events)
    SELECT signature, count(DISTINCT node) AS nodes, count(*) AS n, count(DISTINCT node) >= 2 OR count(*) >= 3 AS grows FROM s GROUP BY 1""",
)
def recurrence_state(spark, d):
    """AGG-25, AGG-20"""
    rows = table(spark, d, "events").select(F.concat_ws(":", "event_type", F.floor("value") % 5).alias("signature"), F.col("user_id").alias("node"))
    return a.recurrence(rows)


@register(
    "community_materialize",
    "SELECT c_nationkey AS community_id, count(*) AS member_count, count(DISTINCT c_mktsegment) AS paper_count, count(*) FILTER (c_acctbal > 5000) AS core_member_count FROM customer GROUP BY 1",
)
def community_materialize(spark, d):
    """AGG-12"""
    m = table(spark, d, "customer").select(F.col("c_nationkey").alias("community_id"), F.col("c_custkey").alias("member_id"), F.col("c_mktsegment").alias("paper_id"), (F.col("c_acctbal") > 5000).alias("core"))
    return a.materialize_communities(m)


@register(
    "rollup_quality",
    "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(lang, source)::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source)",
)
def rollup_quality(spark, d):
    """AGG-23: per source, per language and corpus totals."""
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))


@register(
    "cube_slots",
    fx.sql("claim") + " SELECT step_type, kind, count(*) AS n FROM (SELECT step_type, unnest(kinds) AS kind FROM claim) GROUP BY CUBE (step_type, kind)",
)
def cube_slots(spark, d):
    """AGG-03, AGG-16: claims by step and kind with all margins."""
    return fx.claims(spark, d).select("step_type", F.explode("kinds").alias("kind")).cube("step_type", "kind").agg(F.count("*").alias("n"))


@register("section_counts", fx.sql("step") + " SELECT step_type, count(claim_id) AS links, round(max(confidence), 6) AS best FROM step LEFT JOIN claim USING (paper_id, step_type) GROUP BY 1")
def section_counts(spark, d):
    """AGG-09, AGG-10"""
    return fx.logic_steps(spark, d).join(fx.claims(spark, d), ["paper_id", "step_type"], "left").groupBy("step_type").agg(F.count("claim_id").alias("links"), F.round(F.max("confidence"), 6).alias("best"))


@register("community_keywords", "SELECT p_brand AS community_id, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS keywords FROM part GROUP BY 1")
def community_keywords(spark, d):
    """AGG-11, SRC-19"""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("community_id")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("keywords"))


@register(
    "grounding_summary",
    """SELECT count(*) AS atoms, count(*) FILTER (quality = 1) AS grounded, count(*) FILTER (toxic = 1) AS flagged, round(avg(quality), 6) AS grounded_rate, round(avg(toxic), 3) AS flagged_rate FROM labels""",
)
def grounding_summary(spark, d):
    """AGG-17, AGG-18, AGG-26"""
    return table(spark, d, "labels").agg(
        F.count("*").alias("atoms"), F.count_if(F.col("quality") == 1).alias("grounded"), F.count_if(F.col("toxic") == 1).alias("flagged"),
        F.round(F.avg("quality"), 6).alias("grounded_rate"), F.round(F.avg("toxic"), 3).alias("flagged_rate"),
    )


@register(
    "qa_grounding_rate",
    r"""WITH q AS (SELECT item_id, lower(trim(regexp_replace(split_part(text, '.', 1), '\s+', ' ', 'g'))) AS span FROM benchmark),
    t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM documents)
    SELECT item_id, EXISTS (SELECT 1 FROM t WHERE contains(t.text, span)) AS grounded FROM q""",
)
def qa_grounding_rate(spark, d):
    """AGG-19: whether the first sentence of each passage stands in any document.

    Spans meet the texts in the lists of word pairs, so that no pair without those is looked at.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    q = table(spark, d, "benchmark").select("item_id", norm(F.split_part("text", F.lit("."), F.lit(1))).alias("span"))
    t = table(spark, d, "documents").select("doc_id", norm(F.col("text")).alias("text")).withColumn("w", F.split("text", " "))
    pair = lambda w, i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))
    # inner words of a span are whole words of any text that holds it
    q = q.withColumn("w", F.split("span", " "))
    grams = t.where(F.size("w") >= 4).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(2), F.size("w") - 2), lambda i: pair(F.col("w"), i)))).alias("k"))
    keyed = q.where(F.size("w") >= 4).withColumn("k", pair(F.col("w"), F.lit(2)))
    met = keyed.join(grams, "k").select("item_id", "span", "doc_id").join(t.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("span")))
    short = q.where(F.size("w") < 4).join(t, F.col("text").contains(F.col("span"))).select("item_id")
    found = met.select("item_id").unionByName(short).distinct().withColumn("hit", F.lit(True))
    return q.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("grounded"))
