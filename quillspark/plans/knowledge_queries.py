"""Queries of hypergraph, citation and upsert operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import citations as c
from quillspark.operators import hypergraph as h
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import table

# orders are hyperedges, their line items the members, parts the nodes
_HG = """hn AS (SELECT p_partkey AS nid, p_brand || ' ' || p_type AS surface, CASE WHEN p_size % 3 = 0 THEN ['NUMERIC', 'PROPERTY'] ELSE ['PROPERTY'] END AS labels FROM part),
he AS (SELECT o_orderkey AS eid, (['defines','influences','measures','claim_relation'])[o_orderkey % 4 + 1] AS pattern, (['experiment','theory','Review','bad'])[o_custkey % 4 + 1] AS method, (['dense','flow',''])[o_custkey % 3 + 1] AS regime FROM orders),
hi AS (SELECT l_orderkey AS eid, l_linenumber AS pos, l_partkey AS nid, CASE WHEN l_linenumber % 2 = 1 THEN 'source' ELSE 'target' END AS role FROM lineitem)"""


def _nodes(spark, d):
    labels = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("NUMERIC"), F.lit("PROPERTY"))).otherwise(F.array(F.lit("PROPERTY")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("nid"), F.concat_ws(" ", "p_brand", "p_type").alias("surface"), labels.alias("labels"))


def _edges(spark, d):
    pick = lambda xs, i: F.array(*[F.lit(x) for x in xs])[i.cast("int")]
    o = table(spark, d, "orders")
    q = F.create_map(F.lit("method"), pick(["experiment", "theory", "Review", "bad"], F.col("o_custkey") % 4), F.lit("applies_in_regime"), pick(["dense", "flow", ""], F.col("o_custkey") % 3))
    return o.select(F.col("o_orderkey").alias("eid"), pick(["defines", "influences", "measures", "claim_relation"], F.col("o_orderkey") % 4).alias("pattern"), q.alias("qualifiers"))


def _incidence(spark, d):
    role = F.when(F.col("l_linenumber") % 2 == 1, "source").otherwise("target")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("eid"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("nid"), role.alias("role"))


@register("qualifier_validation", f"WITH {_HG} SELECT eid, lower(method) IN ('experiment','simulation','theory','review') AND lower(regime) IN ('dense','quasi-static','inertial','solid-like','flow','static','unknown') AS valid FROM he")
def qualifier_validation(spark, d):
    """COL-09"""
    return _edges(spark, d).select("eid", h.qualifiers_valid(F.col("qualifiers")).alias("valid"))


@register("surface_merge", f"WITH {_HG} SELECT trim(regexp_replace(lower(surface), '[\\s_-]+', ' ', 'g'), ' .,;:()') AS key, arg_min(surface, nid) AS surface, array_to_string(list_sort(list_distinct(flatten(list(labels)))), ';') AS labels, count(DISTINCT nid % 7) AS papers FROM hn GROUP BY 1")
def surface_merge(spark, d):
    """HG-01, HG-03"""
    rows = _nodes(spark, d).withColumn("paper_id", F.lit(0))
    merged = h.merge_surfaces(rows).drop("papers", "labels")
    more = h.merge_surfaces(_nodes(spark, d).withColumn("paper_id", F.col("nid") % 7)).select("key", F.array_join("labels", ";").alias("labels"), "papers")
    return merged.join(more, "key")


@register(
    "pattern_matching",
    f"""WITH {_HG}, s AS (SELECT * FROM (VALUES ('pair', 1, 'source', false), ('pair', 1, 'target', false), ('fan', 2, 'source', true), ('fan', 2, 'target', true), ('single', 3, 'source', false)) t(pattern, ord, role, rep)),
    n AS (SELECT eid, role, count(*) AS n FROM hi GROUP BY 1, 2), r AS (SELECT eid, count(*) AS roles FROM n GROUP BY 1), z AS (SELECT pattern, count(*) AS slots FROM s GROUP BY 1),
    f AS (SELECT eid, pattern, ord, count(*) AS hit FROM n JOIN s USING (role) WHERE n = 1 OR rep GROUP BY 1, 2, 3) SELECT eid, arg_min(pattern, ord) AS pattern FROM f JOIN r USING (eid) JOIN z USING (pattern) WHERE hit = roles AND hit = slots GROUP BY 1""",
)
def pattern_matching(spark, d):
    """HG-02"""
    slots = [("pair", 1, "source", False), ("pair", 1, "target", False), ("fan", 2, "source", True), ("fan", 2, "target", True), ("single", 3, "source", False)]
    return h.match_patterns(_incidence(spark, d), spark.createDataFrame(slots, "pattern string, ord int, role string, repeatable boolean"))


@register(
    "constraint_violations",
    f"""WITH {_HG}, p AS (SELECT eid, nid, pattern, surface, labels FROM hi JOIN he USING (eid) JOIN hn USING (nid) WHERE eid % 50 = 0 OR pattern <> 'defines')
    SELECT eid, nid, surface FROM p WHERE pattern <> 'defines' AND list_contains(labels, 'NUMERIC') AND surface NOT IN (SELECT surface FROM p WHERE pattern = 'defines')""",
)
def constraint_violations(spark, d):
    """HG-04: with few definitions kept, so that some numeric nodes lack one."""
    e = _edges(spark, d).where("eid % 50 = 0 or pattern != 'defines'")
    return h.constraint_violations(_nodes(spark, d), _incidence(spark, d), e)


@register("pattern_dependencies", f"WITH {_HG}, p AS (SELECT DISTINCT pattern, surface FROM hi JOIN he USING (eid) JOIN hn USING (nid)) SELECT DISTINCT a.pattern, b.pattern AS \"on\" FROM p a JOIN p b USING (surface) WHERE a.pattern <> 'defines' AND b.pattern = 'defines'")
def pattern_dependencies(spark, d):
    """HG-05"""
    return h.pattern_dependencies(_nodes(spark, d), _incidence(spark, d), _edges(spark, d))


@register(
    "split_triggers",
    f"""WITH {_HG}, q AS (SELECT pattern, 'method' AS key, method AS value FROM he UNION ALL SELECT pattern, 'applies_in_regime', regime FROM he), n AS (SELECT pattern, key, value, count(*) AS n FROM q GROUP BY 1, 2, 3)
    SELECT pattern, key, sum(n)::BIGINT AS total, count(*) AS "values", count(*) FILTER (n >= 3) AS clusters FROM n GROUP BY 1, 2 HAVING count(*) / sum(n) <= 0.6 AND count(*) FILTER (n >= 3) >= 2""",
)
def split_triggers(spark, d):
    """HG-06"""
    return h.split_triggers(_edges(spark, d))


@register("split_apply", f"WITH {_HG} SELECT eid, CASE WHEN pattern = 'measures' THEN 'measures__' || lower(method) ELSE pattern END AS pattern FROM he")
def split_apply(spark, d):
    """HG-07"""
    return h.split_apply(_edges(spark, d), "measures", "method").select("eid", "pattern")


@register("merge_apply", f"WITH {_HG} SELECT CASE WHEN pattern IN ('measures','influences') THEN 'affects' ELSE pattern END AS pattern, count(*) AS n FROM he GROUP BY 1")
def merge_apply(spark, d):
    """HG-07"""
    return h.merge_apply(_edges(spark, d), ["measures", "influences"], "affects").groupBy("pattern").agg(F.count("*").alias("n"))


@register("rebind_candidates", "SELECT p_brand AS surface, count(DISTINCT p_type) AS types, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def rebind_candidates(spark, d):
    """HG-13"""
    return h.rebind_candidates(table(spark, d, "part").select(F.col("p_brand").alias("surface"), F.col("p_type").alias("type")))


@register("enum_gaps", "SELECT p_brand AS layer, p_type AS value, count(*) AS n FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_size > 25) GROUP BY 1, 2")
def enum_gaps(spark, d):
    """HG-12"""
    part = table(spark, d, "part").select(F.col("p_brand").alias("layer"), F.col("p_type").alias("value"), "p_size")
    return h.enum_gaps(part.select("layer", "value"), part.where("p_size > 25").select("layer", "value").distinct())


@register("retire_triggers", f"WITH {_HG} SELECT DISTINCT p_type AS pattern FROM part WHERE p_type NOT IN (SELECT pattern FROM he)")
def retire_triggers(spark, d):
    """HG-09"""
    return h.retire_triggers(table(spark, d, "part").select(F.col("p_type").alias("pattern")).distinct(), _edges(spark, d))


@register(
    "edge_questions",
    f"""WITH {_HG}, m AS (SELECT eid, arg_min(surface, {{'p': pos, 'n': nid}}) AS first, arg_max(surface, {{'p': pos, 'n': nid}}) AS second FROM hi JOIN hn USING (nid) GROUP BY 1)
    SELECT eid, CASE pattern WHEN 'defines' THEN 'How is ' || first || ' defined?' WHEN 'influences' THEN 'What does ' || first || ' influence?' WHEN 'measures' THEN 'How is ' || first || ' measured?' ELSE 'How does ' || first || ' relate to ' || second || '?' END AS question FROM he JOIN m USING (eid)""",
)
def edge_questions(spark, d):
    """HG-14"""
    m = _incidence(spark, d).join(_nodes(spark, d), "nid").groupBy("eid").agg(F.min_by("surface", F.struct("pos", "nid")).alias("first"), F.max_by("surface", F.struct("pos", "nid")).alias("second"))
    return h.questions(_edges(spark, d).join(m, "eid")).select("eid", "question")


@register("edge_retrieval", f"WITH {_HG} SELECT eid, pattern FROM he WHERE contains(pattern, 'influ') AND contains(lower(method), 'exp') AND eid IN (SELECT eid FROM hi JOIN hn USING (nid) WHERE contains(lower(surface), 'brand#1'))")
def edge_retrieval(spark, d):
    """FIL-15, FIL-16"""
    return h.retrieve(_edges(spark, d), _incidence(spark, d), _nodes(spark, d), "influ", ("method", "EXP"), "Brand#1").select("eid", "pattern")


_LAB = "l AS (SELECT l_orderkey, l_linenumber, [(['SupportEvidence','CritiqueLimit','Survey','DataTool','FutureDirection','Nonsense'])[l_partkey % 6 + 1], (['BaselineCompare','CritiqueLimit','Theory'])[l_suppkey % 3 + 1]] AS labels, [l_discount, l_tax] AS scores FROM lineitem)"


def _labelled(spark, d):
    pick = lambda xs, i: F.array(*[F.lit(x) for x in xs])[i.cast("int")]
    a = pick(["SupportEvidence", "CritiqueLimit", "Survey", "DataTool", "FutureDirection", "Nonsense"], F.col("l_partkey") % 6)
    b = pick(["BaselineCompare", "CritiqueLimit", "Theory"], F.col("l_suppkey") % 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(a, b).alias("labels"), F.array("l_discount", "l_tax").alias("scores"))


_ANY = lambda names: "list_has_any(labels, [" + ",".join(f"'{n}'" for n in names) + "])"


def _names_sql(sets: dict, head: str = "") -> str:
    items = ([f"'{head}'"] if head else []) + [f"CASE WHEN {_ANY(v)} THEN '{k}' END" for k, v in sets.items()]
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), ';')"


@register(
    "citation_acts",
    f"""WITH {_LAB} SELECT l_orderkey, l_linenumber, CASE WHEN {_ANY(c.POSITIVE)} AND {_ANY(c.NEGATIVE)} THEN 'mixed' WHEN {_ANY(c.POSITIVE)} THEN 'positive' WHEN {_ANY(c.NEGATIVE)} THEN 'negative' ELSE 'neutral' END AS polarity,
    {_names_sql(c.SIGNALS)} AS signals, {_names_sql(c.SCOPES, 'paper')} AS scopes FROM l""",
)
def citation_acts(spark, d):
    """COL-05, CIT-04"""
    x = F.col("labels")
    return _labelled(spark, d).select("l_orderkey", "l_linenumber", c.polarity(x).alias("polarity"), F.array_join(c.signals(x), ";").alias("signals"), F.array_join(c.scopes(x), ";").alias("scopes"))


@register(
    "purpose_cleaning",
    f"""WITH {_LAB}, k AS (SELECT l_orderkey, l_linenumber, list_reverse_sort(list_filter([{{'s': scores[1], 'l': labels[1]}}, {{'s': scores[2], 'l': labels[2]}}], lambda x: x.l <> 'Nonsense'))[1] AS b FROM l)
    SELECT l_orderkey, l_linenumber, b.l AS label, b.s AS score FROM k""",
)
def purpose_cleaning(spark, d):
    """CIT-07"""
    best = c.clean_purposes(F.col("labels"), F.col("scores"), 1)
    return _labelled(spark, d).select("l_orderkey", "l_linenumber", best[0]["label"].alias("label"), best[0]["score"].alias("score"))


@register("judge_labels", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsupported' WHEN (doc_id % 100) / 100.0 >= 0.75 THEN 'supported' WHEN (doc_id % 100) / 100.0 >= 0.55 THEN 'weak' ELSE 'unsupported' END AS label FROM labels")
def judge_labels(spark, d):
    """CIT-08"""
    return table(spark, d, "labels").select("doc_id", c.judge_label(F.col("doc_id") % 100 / 100, F.col("toxic") == 1).alias("label"))


@register(
    "citation_mentions",
    fx.sql("mention") + """, cites AS (SELECT src AS paper_id, ref_num, arg_max(dst, {'c': chunk, 'd': dst}) AS cited_id FROM mention GROUP BY 1, 2), acts AS (SELECT src AS paper_id, dst AS cited_id, max('a' || chunk) AS act_id FROM mention WHERE dst % 2 = 0 GROUP BY 1, 2)
    SELECT m.src AS paper_id, m.ref_num, m.chunk, c.cited_id, coalesce(act_id, m.src || '->' || c.cited_id) AS act_id FROM mention m JOIN cites c ON m.src = c.paper_id AND m.ref_num = c.ref_num LEFT JOIN acts a ON a.paper_id = m.src AND a.cited_id = c.cited_id""",
)
def citation_mentions(spark, d):
    """JOIN-10, CIT-05"""
    m = fx.mentions(spark, d)
    events = m.select(F.col("src").alias("paper_id"), "ref_num", "chunk")
    cites = m.select(F.col("src").alias("paper_id"), "ref_num", F.col("dst").alias("cited_id"), F.struct("chunk", "dst").alias("pos"))
    acts = m.where("dst % 2 = 0").select(F.col("src").alias("paper_id"), F.col("dst").alias("cited_id"), F.concat(F.lit("a"), "chunk").alias("act_id"))
    return c.mention_rows(events, cites, acts)


@register(
    "event_recovery",
    """WITH t AS (SELECT doc_id AS paper_id, 'k' || doc_id AS chunk_id, [doc_id % 12, doc_id % 12 + 1, doc_id % 7] AS ns FROM documents), e AS (SELECT DISTINCT paper_id, chunk_id, unnest(ns) AS ref_num FROM t)
    SELECT paper_id, chunk_id, ref_num::INT AS ref_num FROM e WHERE ref_num BETWEEN 1 AND 10 AND ref_num <> 5""",
)
def event_recovery(spark, d):
    """CIT-02, SRC-04: numbers in brackets become events where the reference exists and the event does not."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 12
    text = F.format_string("see [%d-%d] and [%d].", k, k + 1, F.col("doc_id") % 7)
    chunks = docs.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("k"), "doc_id").alias("chunk_id"), text.alias("text"))
    refs = docs.select(F.col("doc_id").alias("paper_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("ref_num"))
    done = chunks.select("chunk_id", F.lit(5).alias("ref_num"))
    return c.recover_events(chunks, refs, done).drop("rank")


@register(
    "upsert_keep_old",
    """WITH o AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents WHERE doc_id % 3 > 0), n AS (SELECT doc_id AS id, 'new' AS lang, 'n' || n_chars AS source FROM documents WHERE doc_id % 3 < 2)
    SELECT id, coalesce(o.lang, n.lang) AS lang, coalesce(o.source, n.source) AS source FROM o FULL JOIN n USING (id)""",
)
def upsert_keep_old(spark, d):
    """SINK-03, SINK-12, SINK-15, SINK-20, SINK-21"""
    docs = table(spark, d, "documents")
    o = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    n = docs.where("doc_id % 3 < 2").select(F.col("doc_id").alias("id"), F.lit("new").alias("lang"), F.concat(F.lit("n"), "n_chars").alias("source"))
    return c.upsert_keep_old(o, n, ["id"], ["lang", "source"])


@register(
    "upsert_non_blank",
    """WITH o AS (SELECT doc_id AS id, lang AS v FROM documents WHERE doc_id % 3 > 0), n AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE source END AS v FROM documents WHERE doc_id % 3 < 2)
    SELECT id, coalesce(nullif(trim(n.v), ''), o.v) AS v FROM o FULL JOIN n USING (id)""",
)
def upsert_non_blank(spark, d):
    """SINK-11"""
    docs = table(spark, d, "documents")
    o = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("v"))
    n = docs.where("doc_id % 3 < 2").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("source")).alias("v"))
    return c.upsert_keep_non_blank(o, n, ["id"], ["v"])


@register("replace_by_source", "SELECT source, doc_id, 'new' AS v FROM documents WHERE source IN ('src1','src2') AND doc_id % 2 = 0 UNION ALL SELECT source, doc_id, 'old' FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source IN ('src1','src2') AND doc_id % 2 = 0)")
def replace_by_source(spark, d):
    """SINK-09, SINK-07, SINK-13, VEC-04"""
    docs = table(spark, d, "documents").select("source", "doc_id")
    new = docs.where("source in ('src1', 'src2') and doc_id % 2 = 0").withColumn("v", F.lit("new"))
    return c.replace_by_source(docs.withColumn("v", F.lit("old")), new, "source")


@register(
    "delete_unshared",
    "WITH l AS (SELECT l_partkey AS entity_id, l_suppkey AS book FROM lineitem WHERE l_quantity > 45) SELECT p_partkey AS entity_id FROM part WHERE NOT (p_partkey IN (SELECT entity_id FROM l WHERE book = 3) AND p_partkey NOT IN (SELECT entity_id FROM l WHERE book <> 3))",
)
def delete_unshared(spark, d):
    """SINK-14, JOIN-16"""
    links = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").cast("string").alias("textbook_id"))
    return c.delete_unshared(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id")), links, "3")


@register("bibtex_export", fx.sql("paper") + r""" SELECT paper_id, '@article{' || paper_id || ',' || chr(10) || '  title = {' || regexp_replace(title, '([{}\\%&_#$])', '\\\1', 'g') || '},' || chr(10) || '  year = {' || year || '}' || chr(10) || '}' AS entry FROM paper""")
def bibtex_export(spark, d):
    """SINK-17"""
    return c.bibtex(fx.papers(spark, d))


@register(
    "resolved_merge",
    """WITH o AS (SELECT l_suppkey AS src, l_partkey % 20 AS dst, l_orderkey, l_linenumber FROM lineitem), a AS (SELECT src, dst, count(*) AS n, list_sort(list(DISTINCT 'e' || l_orderkey % 5)) AS e FROM o WHERE l_linenumber = 1 GROUP BY 1, 2),
    b AS (SELECT src, dst, count(*) AS n, list_sort(list(DISTINCT 'e' || l_orderkey % 9)) AS e FROM o WHERE l_linenumber = 2 GROUP BY 1, 2), j AS (SELECT src, dst, coalesce(a.n, 0) + coalesce(b.n, 0) AS total_mentions, coalesce(a.e, []) AS ae, coalesce(b.e, []) AS be FROM a FULL JOIN b USING (src, dst))
    SELECT src, dst, total_mentions, array_to_string((ae || list_filter(be, lambda x: NOT list_contains(ae, x)))[1:4], ';') AS evidence FROM j""",
)
def resolved_merge(spark, d):
    """SINK-04"""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 20).alias("dst"), "l_orderkey", "l_linenumber")
    part = lambda n, m: li.where(F.col("l_linenumber") == n).groupBy("src", "dst").agg(
        F.count("*").alias("total_mentions"), F.array(F.lit("1")).alias("ref_nums"), F.array_sort(F.collect_set(F.concat(F.lit("e"), F.col("l_orderkey") % m))).alias("evidence")
    )
    return c.merge_resolved(part(1, 5), part(2, 9)).select("src", "dst", "total_mentions", F.array_join("evidence", ";").alias("evidence"))


@register(
    "purpose_backfill",
    """SELECT item_id, CASE WHEN item_id % 3 < 2 THEN 'Background' ELSE 'MethodUse' END AS label, CASE WHEN item_id % 3 < 2 THEN 0.2 ELSE 0.9 END::DOUBLE AS score FROM benchmark""",
)
def purpose_backfill(spark, d):
    """SINK-06: citations without purposes (none, or an empty list) become Background with 0.2."""
    known = lambda value, kind: F.when(F.col("item_id") % 3 == 2, F.array(F.lit(value))).when(F.col("item_id") % 3 == 1, F.array().cast(f"array<{kind}>"))
    cites = table(spark, d, "benchmark").select("item_id", known("MethodUse", "string").alias("labels"), known(0.9, "double").alias("scores"))
    return c.backfill_purposes(cites).select("item_id", F.col("labels")[0].alias("label"), F.col("scores")[0].alias("score"))
