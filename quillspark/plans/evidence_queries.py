"""Queries of evidence, noise and overlay operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import evidence as e
from quillspark.operators import graph as g
from quillspark.operators.relational import is_caption
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import table
from quillspark.sources import documents as s

_COMP = r"(?i)\b(?:better|worse|more|less|higher|lower|outperform\w*|improv\w+|increas\w+|decreas\w+|caus\w+|leads?|leading|led|result\w*)\b"
_SHAPES = " + ".join(rf"regexp_matches(text, '(?i)\b{p}\s+')::INT" for p in (r"is\s+a", r"is\s+the", r"refers?\s+to", r"is\s+defined\s+as", "represents?"))
_NOISE = rf"""z AS (SELECT claim_id, paper_id, pos, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS text FROM claim),
n AS (SELECT *, lead(text) OVER (PARTITION BY paper_id ORDER BY pos) AS nxt, {_SHAPES} AS shapes,
  len(regexp_extract_all(text, '(?i)\b(?:is|are|was|were)\b')) / len(regexp_extract_all(text, '\S+'))::DOUBLE > 0.08 AS dense FROM z),
f AS (SELECT *, CASE WHEN coalesce(trim(text), '') = '' OR regexp_matches(text, '{_COMP}') THEN false
  WHEN regexp_matches(text, '(?i)\brefers?\s+to\s+|\bis\s+defined\s+as\s+') THEN true
  ELSE (shapes >= 2 OR shapes >= 1 AND dense) AND NOT coalesce(regexp_matches(nxt, '{_COMP}'), false) END AS d FROM n)"""


@register("noise_filter_stats", fx.sql("claim") + f", {_NOISE} SELECT count(*) AS seen, 0::BIGINT AS captions, count(*) FILTER (d) AS definitions, count(*) FILTER (NOT d) AS kept, 1 - count(*) FILTER (NOT d) / count(*)::DOUBLE AS rate FROM f")
def noise_filter_stats(spark, d):
    """FIL-08, FIL-09, FIL-10"""
    return e.filter_claims(fx.claims(spark, d), is_caption(F.col("text")), "paper_id", "pos")[1]


@register("noise_filtered_claims", fx.sql("claim") + f", {_NOISE} SELECT claim_id FROM f WHERE NOT d")
def noise_filtered_claims(spark, d):
    """FIL-10"""
    return e.filter_claims(fx.claims(spark, d), is_caption(F.col("text")), "paper_id", "pos")[0].select("claim_id")


#: Words of the tables that play domain terms.
_TERMS = ["thing", "the", "der"]


@register(
    "noise_filter_rules",
    fx.sql("claim")
    + rf""", z AS (SELECT claim_id, paper_id, pos, CASE WHEN pos % 11 = 0 THEN 'Figure 2: ' ELSE '' END || regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') || CASE WHEN pos % 7 = 1 THEN ' increases' ELSE '' END AS text, pos % 11 = 0 AS caption FROM claim),
    n AS (SELECT *, lead(text) OVER (PARTITION BY paper_id ORDER BY pos) AS nxt, {_SHAPES} AS shapes, regexp_matches(text, '(?i)\b(thing|the|der)\b') AS term,
      len(regexp_extract_all(text, '(?i)\b(?:is|are|was|were)\b')) / len(regexp_extract_all(text, '\S+'))::DOUBLE > 0.08 AS dense FROM z),
    f AS (SELECT *, NOT regexp_matches(text, '{_COMP}') AND regexp_matches(text, '(?i)\brefers?\s+to\s+|\bis\s+defined\s+as\s+') AS strong, NOT regexp_matches(text, '{_COMP}') AND (shapes >= 2 OR shapes >= 1 AND dense) AS plain,
      coalesce(regexp_matches(nxt, '{_COMP}'), false) AS saved FROM n),
    g AS (SELECT *, strong OR plain AS alone, strong OR plain AND NOT saved AS bare, CASE WHEN caption AND NOT term THEN 'caption' WHEN NOT term AND (strong OR plain AND NOT saved) THEN 'definition' END AS gone FROM f)
    SELECT count(*) AS raw_count, count(*) FILTER (gone IS NULL) AS filtered_count, count(*) FILTER (gone = 'caption') AS caption_filtered, count(*) FILTER (gone = 'definition') AS definition_filtered,
      count(*) FILTER (gone IS NULL AND term AND (caption OR bare)) AS whitelist_preserved, count(*) FILTER (gone IS NULL AND nxt IS NOT NULL AND NOT term AND alone) AS context_preserved,
      count(*) FILTER (gone IS NOT NULL) / count(*)::DOUBLE AS filter_rate FROM g""",
)
def noise_filter_rules(spark, d):
    """FIL-10: captions and definitions with domain terms and the next claim, every counter."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    text = F.concat(F.when(F.col("pos") % 11 == 0, "Figure 2: ").otherwise(""), plain, F.when(F.col("pos") % 7 == 1, " increases").otherwise(""))
    return e.noise_filter(fx.claims(spark, d).withColumn("text", text), is_caption(F.col("text")), "paper_id", "pos", _TERMS)[1]


@register("scoped_hits", "SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 5 = 0 THEN lang = 'de' ELSE source IN ('src1','src2','src3') END")
def scoped_hits(spark, d):
    """FIL-12"""
    docs = table(spark, d, "documents")
    hits = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source")).alias("paper_source"), F.when(F.col("lang") == "de", "textbook").otherwise("paper").alias("origin"))
    return e.scoped(hits, ["src1", "src2", "src3"]).select("doc_id")


@register("structured_rows", "SELECT lang AS kind, CASE WHEN doc_id % 3 = 0 THEN source ELSE doc_id::VARCHAR END AS id, trim(text) AS text FROM documents WHERE lang IN ('en','fr') AND trim(text) <> ''")
def structured_rows(spark, d):
    """FIL-13"""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("lang").alias("kind"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("alt_id"), "text", F.lit("").alias("quote"))
    return e.structured_rows(rows, ["en", "fr"])


@register("grounded_atoms", "SELECT doc_id FROM labels WHERE CASE WHEN doc_id % 4 = 0 THEN toxic = 0 ELSE quality = 1 END")
def grounded_atoms(spark, d):
    """FIL-14"""
    kind = F.when(F.col("doc_id") % 4 == 0, "PAPER").otherwise("CLAIM")
    status = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("toxic") == 1, "unsupported").otherwise("open")).otherwise(F.when(F.col("quality") == 1, "grounded").otherwise("unsupported"))
    return e.grounded(table(spark, d, "labels").select("doc_id", kind.alias("type"), status.alias("status"))).select("doc_id")


@register("qa_selection", "WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rank FROM part) SELECT p_partkey, p_type FROM r WHERE rank <= CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'LARGE' THEN 1 ELSE 0 END")
def qa_selection(spark, d):
    """FIL-21"""
    return e.capped_buckets(table(spark, d, "part"), "p_type", "p_partkey", {"ECONOMY": 3, "LARGE": 1}).select("p_partkey", "p_type")


@register(
    "claim_targets",
    fx.sql("claim") + """, c AS (SELECT chunk_id, pos % 7 AS cited_id, pos + 1 AS mentions FROM chunk UNION ALL SELECT chunk_id, pos % 5 + 10, 3 FROM chunk),
    w AS (SELECT claim_id, cited_id, max(mentions) AS m FROM claim JOIN c USING (chunk_id) WHERE list_has_any(kinds, ['Gap','Result']) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY m DESC, cited_id) AS rank FROM w)
    SELECT claim_id, string_agg(cited_id::VARCHAR, ';' ORDER BY rank) AS targets FROM r WHERE rank <= 2 GROUP BY 1""",
)
def claim_targets(spark, d):
    """JOIN-11"""
    ch = fx.chunks(spark, d)
    cites = ch.select("chunk_id", (F.col("pos") % 7).alias("cited_id"), (F.col("pos") + 1).alias("mentions")).unionByName(ch.select("chunk_id", (F.col("pos") % 5 + 10).alias("cited_id"), F.lit(3).alias("mentions")))
    claims = fx.claims(spark, d).withColumn("chunks", F.array("chunk_id"))
    return e.targets_from_citations(claims, cites, ["Gap", "Result"], 2).withColumn("targets", F.array_join("targets", ";"))


@register(
    "grounding_rows",
    fx.sql("claim") + """, i AS (SELECT claim_id AS id FROM claim WHERE confidence > 0.97) SELECT 'claim' AS kind, id, chunk_id, chunk.text AS quote FROM i JOIN claim ON id = claim_id JOIN chunk USING (chunk_id) ORDER BY kind, id, chunk_id LIMIT 200""",
)
def grounding_rows(spark, d):
    """JOIN-12, VEC-12"""
    claims = fx.claims(spark, d)
    ids = claims.where("confidence > 0.97").select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"))
    steps = fx.logic_steps(spark, d).withColumn("chunk_id", F.lit(None).cast("string"))
    return e.grounding_rows(ids, claims, steps, fx.chunks(spark, d), 200)


@register("discourse_roles", fx.sql("step") + " SELECT claim_id, logic_step_id, CASE step_type WHEN 'Method' THEN 'context' WHEN 'Result' THEN 'observation' WHEN 'Conclusion' THEN 'summary' ELSE 'claim' END AS role FROM claim JOIN step USING (paper_id, step_type)")
def discourse_roles(spark, d):
    """JOIN-15: node -> section -> role."""
    role = F.when(F.col("step_type") == "Method", "context").when(F.col("step_type") == "Result", "observation").when(F.col("step_type") == "Conclusion", "summary").otherwise("claim")
    return fx.claims(spark, d).join(fx.logic_steps(spark, d).select("paper_id", "step_type", "logic_step_id"), ["paper_id", "step_type"]).select("claim_id", "logic_step_id", role.alias("role"))


@register("section_basics", "SELECT l_suppkey AS step, l_partkey AS entity, coalesce(p_brand, 'none') AS chapter, l_discount AS score FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 WHERE l_linenumber = 1 ORDER BY score DESC, step, entity, l_orderkey LIMIT 50")
def section_basics(spark, d):
    """JOIN-17"""
    li = table(spark, d, "lineitem").where("l_linenumber = 1")
    part = table(spark, d, "part").where("p_size > 10")
    out = li.join(part, li.l_partkey == part.p_partkey, "left").orderBy(F.desc("l_discount"), "l_suppkey", "l_partkey", "l_orderkey").limit(50)
    return out.select(F.col("l_suppkey").alias("step"), F.col("l_partkey").alias("entity"), F.coalesce("p_brand", F.lit("none")).alias("chapter"), F.col("l_discount").alias("score"))


@register(
    "author_year",
    """WITH m AS (SELECT o_orderkey AS mention_id, o_custkey % 20 AS paper_id, o_orderkey % 30 AS year, o_orderpriority AS token FROM orders), r AS (SELECT c_custkey % 20 AS paper_id, c_custkey AS ref_num, c_custkey % 30 AS year, (['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'])[c_custkey % 5 + 1] AS token FROM customer)
    SELECT mention_id, min(ref_num) AS ref_num FROM m JOIN r USING (paper_id, year, token) GROUP BY 1 HAVING count(DISTINCT ref_num) = 1""",
)
def author_year(spark, d):
    """JOIN-19"""
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("mention_id"), (F.col("o_custkey") % 20).alias("paper_id"), (F.col("o_orderkey") % 30).alias("year"), F.col("o_orderpriority").alias("token"))
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    r = table(spark, d, "customer").select((F.col("c_custkey") % 20).alias("paper_id"), F.col("c_custkey").alias("ref_num"), (F.col("c_custkey") % 30).alias("year"), names[(F.col("c_custkey") % 5).cast("int")].alias("surname"))
    return e.author_year(m, r)


@register("gap_scores", "SELECT event_type AS gap, (['definition','claim','observation'])[user_id % 3 + 1] AS role, count(DISTINCT user_id) AS nodes, count(DISTINCT user_id) * CASE user_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 ELSE 0.7 END::DOUBLE AS score FROM events GROUP BY event_type, user_id % 3")
def gap_scores(spark, d):
    """AGG-21"""
    role = F.array(F.lit("definition"), F.lit("claim"), F.lit("observation"))[(F.col("user_id") % 3).cast("int")]
    gaps = table(spark, d, "events").select(F.col("event_type").alias("gap"), role.alias("role"), F.col("user_id").alias("node"))
    return e.gap_scores(gaps, {"definition": 1.5, "summary": 1.2, "claim": 1.2, "interpretation": 1.0, "context": 1.0, "observation": 0.7})


@register("label_permutation")
def label_permutation(spark, d):
    """AGG-22"""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted"))
    return e.permuted_accuracy(rows, 7)


@register(
    "step_evidence",
    fx.sql("step") + """, t AS (SELECT step.logic_step_id AS unit_id, chunk_id, round(CASE WHEN (length(lower(chunk.text)) - length(replace(lower(chunk.text), 'thing', ''))) // 5 > 0 THEN 1 + 0.3::DOUBLE * least(5, (length(lower(chunk.text)) - length(replace(lower(chunk.text), 'thing', ''))) // 5) ELSE 0 END, 6) AS score
      FROM step JOIN chunk USING (paper_id)), q AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, chunk_id)::INT AS rank, max(score) OVER (PARTITION BY unit_id) < 2.0 AS weak FROM t WHERE score > 0) SELECT unit_id, chunk_id, score, rank, weak FROM q WHERE rank <= 2""",
)
def step_evidence(spark, d):
    """EXT-05, STR-17"""
    units = fx.logic_steps(spark, d).select(F.col("logic_step_id").alias("unit_id"), "paper_id")
    return e.evidence_for(units, fx.chunks(spark, d).select("chunk_id", "paper_id", "text"), tx.lexical_score(F.col("text"), ["thing"]), 2)


@register(
    "taxonomy_lines",
    """WITH RECURSIVE t AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), r(node, path, depth) AS (SELECT 0::BIGINT, '0', 0 UNION ALL SELECT t.child, r.path || '/' || t.child, r.depth + 1 FROM r JOIN t ON t.parent = r.node)
    SELECT node, path, repeat('  ', depth) || node AS line FROM r""",
)
def taxonomy_lines(spark, d):
    """HG-16"""
    t = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    nodes = t.select(F.col("child").alias("node")).unionByName(spark.range(1).select(F.col("id").alias("node"))).distinct()
    return e.taxonomy_text(g.transitive_closure(t), nodes)


@register(
    "outgoing_enrichment",
    fx.sql("mention") + """, c AS (SELECT src, dst, count(*) AS n FROM mention GROUP BY 1, 2) SELECT src, dst, CASE WHEN dst % 7 = 0 THEN '' WHEN dst % 3 = 0 THEN 'Survey' ELSE 'MethodUse' END AS labels,
    CASE WHEN dst % 7 = 0 THEN 'cleared' WHEN dst % 3 = 0 THEN 'human' ELSE 'machine' END AS source, CASE WHEN dst % 3 = 0 AND dst % 2 = 0 THEN 'MethodUse' END AS pending, n::INT AS n_mentions FROM c""",
)
def outgoing_enrichment(spark, d):
    """CIT-06"""
    m = fx.mentions(spark, d)
    pairs = m.select("src", "dst").distinct()
    cites = pairs.withColumn("labels", F.array(F.lit("MethodUse")))
    human = pairs.where("dst % 3 = 0 or dst % 7 = 0").select("src", "dst", F.when(F.col("dst") % 3 == 0, F.array(F.lit("Survey"))).alias("human_labels"), (F.col("dst") % 7 == 0).alias("cleared"), (F.col("dst") % 2 == 0).alias("needs_review"))
    return e.outgoing_enrichment(cites, human, m).withColumns({"labels": F.array_join("labels", ";"), "pending": F.array_join("pending", ";")})


#: Answers of a planner by order key: five plans, an unsupported one with and without a community query or an old name for it, and invalid ones.
_ANSWERS = [
    '{"intent": "comparison", "retrieval_plan": "hybrid_parallel", "main_query": "m", "confidence": 0.5}',
    '```json {"intent": "foundational", "retrieval_plan": "claim_first", "main_query": "m"} ```',
    '{"intent": "paper_detail", "retrieval_plan": "textbook_first_then_paper", "main_query": "m", "paper_query": "p"}',
    '{"intent": "foundational", "retrieval_plan": "proposition_first", "main_query": "m", "proposition_query": " old "}',
    '{"intent": "foundational", "retrieval_plan": "proposition_first", "main_query": "m", "community_query": "c"}',
    '{"intent": "foundational", "retrieval_plan": "proposition_first", "main_query": "m"}',
    '{"intent": "unknown", "retrieval_plan": "claim_first", "main_query": "m"}',
    '{"intent": "foundational", "retrieval_plan": "paper_first_then_textbook", "paper_query": "p"}',
    '{"intent": "foundational", "retrieval_plan": "community_first", "main_query": "m", "confidence": 1.5}',
    'no plan at all',
    '{"intent": "foundational", "retrieval_plan": "paper_first_then_textbook", "main_query": "m", "community_query": null}',
    '{"intent": "hybrid_explanation", "retrieval_plan": "community_first", "main_query": 7}',
]


@register(
    "query_plans",
    """WITH c(k, intent, plan, community, confidence) AS (VALUES (0, 'comparison', 'hybrid_parallel', NULL, 0.5), (1, 'foundational', 'claim_first', NULL, NULL), (2, 'paper_detail', 'textbook_first_then_paper', NULL, NULL),
      (3, 'foundational', 'community_first', 'old', NULL), (4, 'foundational', 'community_first', 'c', NULL), (10, 'foundational', 'paper_first_then_textbook', NULL, NULL))
    SELECT o_orderkey, coalesce(intent, 'paper_detail') AS intent, coalesce(plan, 'paper_first_then_textbook') AS plan, CASE WHEN intent IS NOT NULL THEN 'm' WHEN o_orderpriority = '5-LOW' THEN 'question' ELSE o_orderpriority END AS main_query,
      community AS community_query, confidence::DOUBLE AS confidence, intent IS NULL AS fallback FROM orders LEFT JOIN c ON k = o_orderkey % 12""",
)
def query_plans(spark, d):
    """COL-06, COL-08"""
    orders = table(spark, d, "orders")
    question = F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    answer = F.array(*[F.lit(x) for x in _ANSWERS])[(F.col("o_orderkey") % len(_ANSWERS)).cast("int")]
    return orders.select("o_orderkey", e.query_plan(question, answer).alias("p")).select("o_orderkey", "p.intent", F.col("p.retrieval_plan").alias("plan"), "p.main_query", "p.community_query", "p.confidence", "p.fallback")


@register("string_lists", "SELECT doc_id, array_to_string(CASE WHEN lang = source THEN [lang] ELSE [lang, source] END, ';') AS names FROM documents")
def string_lists(spark, d):
    """COL-01, COL-02, COL-04"""
    xs = F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), "source", "lang")
    return table(spark, d, "documents").select("doc_id", F.array_join(e.norm_string_list(xs), ";").alias("names"))


@register(
    "chapters",
    """WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c0, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents), m AS (SELECT doc_id, line, CASE WHEN line % 4 = 2 THEN '# ' || c0 ELSE c0 END AS content, line % 4 = 2 AS h FROM ls),
    w AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY line) AS chapter FROM m) SELECT doc_id, chapter::BIGINT AS chapter, arg_min(content, line) AS heading, min(line)::INT AS start_line, max(line)::INT AS end_line, count(*) FILTER (trim(content) <> '') AS n_lines FROM w GROUP BY 1, 2""",
)
def chapters(spark, d):
    """SRC-06"""
    rows = s.lines(table(spark, d, "documents"), "doc_id").withColumn("content", F.when(F.col("line") % 4 == 2, F.concat(F.lit("# "), "content")).otherwise(F.col("content")))
    return s.chapters(s.sections(rows, "doc_id"), "doc_id")


@register(
    "figures",
    """WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c0, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
    m AS (SELECT doc_id, line, CASE WHEN line % 9 = 4 THEN '![x](images/' || line || '.png) ' || c0 WHEN line % 18 = 3 THEN 'Figure ' || line || ' ' || c0 ELSE c0 END AS c FROM ls),
    w AS (SELECT *, trim(lag(c) OVER q) AS before, [trim(lead(c, 1) OVER q), trim(lead(c, 2) OVER q), trim(lead(c, 3) OVER q), trim(lead(c, 4) OVER q), trim(lead(c, 5) OVER q), trim(lead(c, 6) OVER q), trim(lead(c, 7) OVER q)] AS near FROM m WINDOW q AS (PARTITION BY doc_id ORDER BY line))
    SELECT doc_id, line::INT AS img_line, 'images/' || line || '.png' AS rel_path, CASE WHEN line % 18 = 4 THEN before ELSE nullif(array_to_string(list_filter(near, lambda x: x IS NOT NULL AND x <> '')[1:3], ' '), '') END AS caption,
    substr(sha256(doc_id || '|images/' || line || '.png'), 1, 16) AS figure_id FROM w WHERE line % 9 = 4""",
)
def figures(spark, d):
    """SRC-05: lines of each text; some play an image, some the caption before it, others are read after it."""
    line = F.col("line")
    image, caption = F.concat(F.lit("![x](images/"), line, F.lit(".png) "), "content"), F.concat(F.lit("Figure "), line, F.lit(" "), "content")
    rows = s.lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return s.figures(rows.withColumn("content", F.when(line % 9 == 4, image).when(line % 18 == 3, caption).otherwise(F.col("content"))), "doc_id")


@register("seeded_sample")
def seeded_sample(spark, d):
    """SRC-21: a seeded sample of a manifest, then its distribution."""
    return s.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 7, 100).groupBy("lang").agg(F.count("*").alias("n"))


@register("textbook_snapshot", "WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, count(*) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT * FROM e ORDER BY w DESC, source, target LIMIT 520) SELECT source, target, w, s.s_name AS source_name, p.p_name AS target_name FROM r JOIN supplier s ON source = s_suppkey JOIN part p ON target = p_partkey")
def textbook_snapshot(spark, d):
    """GRAPH-13, GRAPH-14, WIN-09: the heaviest edges within a budget, with their ends."""
    edges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count("*").alias("w"))
    top = edges.orderBy(F.desc("w"), "source", "target").limit(520)
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("source_name"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("target_name"))
    return top.join(sup, "source").join(part, "target")
