"""Queries of extraction, schema growth and small record rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import chained
from quillspark.operators import citations as c
from quillspark.operators import extraction as x
from quillspark.operators import graph as g
from quillspark.operators import ingest
from quillspark.operators import routing
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import shared_folder, table
from quillspark.sources import payloads


def _length_model(rows: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: batches that hold an item divisible by seven fail unless they are small."""
    if len(rows) > 1 and (rows["item_id"] % 7 == 0).any():
        raise ValueError("batch refused")
    return pd.DataFrame({"item_id": rows["item_id"], "n": rows["text"].str.len().astype("int64")})


@register("tiered_extraction", "SELECT item_id, length(text)::BIGINT AS n FROM benchmark")
def tiered_extraction(spark, d):
    """EXT-03: an injected callable with smaller batches for what failed."""
    return x.tiered_extraction(table(spark, d, "benchmark").select("item_id", "text"), "item_id", _length_model, "item_id long, n long").drop("tier")


def _first_words(n: int):
    """Stands in for a model that finds the first n words of a text."""

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        words = rows["text"].str.split().str[:n]
        return pd.DataFrame({"item_id": rows["item_id"].repeat(words.str.len()).to_numpy(), "atom": [w.lower() for ws in words for w in ws]})

    return call


@register(
    "multi_model_atoms",
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\s]+'), lambda x: x <> '') AS w FROM benchmark), a AS (SELECT item_id, unnest([lower(x) for x in w[1:4]]) AS atom, 'wide' AS model FROM w UNION ALL SELECT item_id, unnest([lower(x) for x in w[1:2]]), 'narrow' FROM w)
    SELECT item_id, atom, count(DISTINCT model) AS models, count(*) AS found FROM a GROUP BY 1, 2""",
)
def multi_model_atoms(spark, d):
    """EXT-13: the atoms of two injected models, and how many models found each."""
    atoms = x.multi_model(table(spark, d, "benchmark").select("item_id", "text"), {"wide": _first_words(4), "narrow": _first_words(2)}, "item_id long, atom string")
    return atoms.groupBy("item_id", "atom").agg(F.count_distinct("model").alias("models"), F.count("*").alias("found"))


@register(
    "evidence_quotes",
    fx.sql("step", "chunk") + r""", q AS (SELECT paper_id, logic_step_id, trim(regexp_replace(substr(summary, 6, 40), '\s+', ' ', 'g')) AS quote FROM step WHERE trim(substr(summary, 6, 40)) <> ''),
    h AS (SELECT q.paper_id, logic_step_id, arg_min(chunk_id, pos) AS chunk_id FROM q JOIN chunk USING (paper_id) WHERE contains(trim(regexp_replace(text, '\s+', ' ', 'g')), quote) GROUP BY 1, 2)
    SELECT paper_id, logic_step_id, quote, chunk_id FROM q LEFT JOIN h USING (paper_id, logic_step_id)""",
)
def evidence_quotes(spark, d):
    """EXT-04: a passage of each step's text as its quote, with the first chunk that holds it."""
    quotes = fx.logic_steps(spark, d).select("paper_id", "logic_step_id", F.substring("summary", 6, 40).alias("quote"))
    return x.evidence_quotes(quotes, fx.chunks(spark, d), "paper_id", "logic_step_id")


@register(
    "atom_recheck",
    """WITH a AS (SELECT item_id, item_id % 3 > 0 AS grounded, (item_id % 10) / 10.0::DOUBLE AS confidence, (['confirmed','unsupported','none'])[item_id % 5 % 3 + 1] AS verdict,
      text, CASE WHEN item_id % 4 = 0 THEN 'not in it' ELSE substr(text, 1, 60) END AS span FROM benchmark),
    f AS (SELECT *, NOT grounded OR confidence < 0.4 AS flagged, item_id % 4 > 0 AND trim(span) <> '' AND (item_id % 2 = 0 OR list_contains(regexp_extract_all(lower(span), '[a-z0-9]+'), 'the')) AS ok FROM a)
    SELECT item_id, CASE WHEN flagged AND verdict = 'confirmed' THEN ok ELSE grounded END AS grounded, CASE WHEN flagged AND verdict = 'confirmed' AND ok THEN greatest(confidence, 0.6) ELSE confidence END AS confidence,
    flagged AND verdict = 'unsupported' AS unsupported FROM f""",
)
def atom_recheck(spark, d):
    """EXT-11: flagged atoms after a second look, whose spans must stand in the text and support the values."""
    i, b = F.col("item_id"), table(spark, d, "benchmark")
    span = F.substring("text", 1, 60)
    values = F.when(i % 2 == 0, F.array(F.element_at(F.regexp_extract_all(F.lower(span), F.lit("[a-z0-9]+"), F.lit(0)), 1))).otherwise(F.array(F.lit("the")))
    atoms = b.select("item_id", F.col("item_id").alias("doc"), values.alias("values"), (i % 3 > 0).alias("grounded"), (i % 10 / 10).alias("confidence"))
    verdict = F.array(F.lit("confirmed"), F.lit("unsupported"), F.lit("none"))[(i % 5 % 3).cast("int")]
    verdicts = b.select("item_id", verdict.alias("verdict"), F.when(i % 4 == 0, "not in it").otherwise(span).alias("span"))
    return x.recheck(atoms, verdicts, b.select(F.col("item_id").alias("doc"), "text"), "item_id", "doc")


@register("section_map", "SELECT doc_id::VARCHAR AS section_id, greatest(0, doc_id % 9 - 3) AS start, least(len(string_split(text, chr(10))), doc_id % 9) AS \"end\" FROM documents WHERE greatest(0, doc_id % 9 - 3) < least(len(string_split(text, chr(10))), doc_id % 9)")
def section_map(spark, d):
    """EXT-09"""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("section_id"), (F.col("doc_id") % 9 - 3).alias("start"), (F.col("doc_id") % 9).alias("end"), F.size(F.split("text", "\n")).cast("long").alias("blocks"))
    return x.section_map(rows, F.col("blocks")).drop("blocks")


@register(
    "chained_contexts",
    f"""WITH RECURSIVE {fx.LAYERS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON r.node = e.src),
    l AS (SELECT node, max(level)::INT AS level FROM r GROUP BY 1) SELECT node, level, coalesce((SELECT string_agg('s' || src, chr(10) ORDER BY src) FROM e WHERE dst = node), '') AS context FROM l""",
)
def chained_contexts(spark, d):
    """EXT-10, GRAPH-18"""
    e = fx.layers(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return x.chained_levels(g.topological_levels(e, nodes), e, nodes.select("node", F.concat(F.lit("s"), "node").alias("summary")))


@register("middle_truncation", "SELECT doc_id, CASE WHEN length(text) <= 800 THEN text ELSE substr(text, 1, 400) || chr(10) || '...' || chr(10) || right(text, 400) END AS text FROM documents")
def middle_truncation(spark, d):
    """EXT-33"""
    return table(spark, d, "documents").select("doc_id", x.middle_truncated(F.col("text"), 800).alias("text"))


@register("path_identities", "SELECT page_id, 'paper:' || substr(sha256('/data/paper:' || page_id || '/full.md'), 1, 24) AS paper_id, page_id::VARCHAR AS source FROM pages")
def path_identities(spark, d):
    """EXT-29"""
    ident, source = x.path_identity(F.concat(F.lit("/data/paper:"), "page_id", F.lit("/full.md")))
    return table(spark, d, "pages").select("page_id", ident.alias("paper_id"), source.alias("source"))


@register("source_metadata", fx.sql("chunk") + r""", f AS (SELECT paper_id, pos, text || CASE WHEN pos = 1 THEN ' 10.5555/ab' || paper_id || 'c 1999' ELSE '' END AS text FROM chunk WHERE pos < 12) SELECT paper_id, arg_min(text, CASE WHEN length(text) >= 10 THEN pos END) AS title, max(CASE WHEN pos = 1 THEN '10.5555/ab' || paper_id || 'c' END) AS doi, max(CASE WHEN pos = 1 THEN 1999 END)::INT AS year FROM f GROUP BY 1""")
def source_metadata(spark, d):
    """EXT-17, STR-23"""
    text = F.when(F.col("pos") == 1, F.concat("text", F.lit(" 10.5555/ab"), "paper_id", F.lit("c 1999"))).otherwise(F.col("text"))
    return x.source_metadata(fx.chunks(spark, d).select("paper_id", F.col("pos").alias("idx"), text.alias("text")), "paper_id")


@register("schema_growth", "SELECT lower(p_type) AS type_id, 3 AS version FROM part WHERE p_size > 48 GROUP BY 1 UNION ALL SELECT DISTINCT lower(p_type) || '_new', 4 FROM part WHERE p_size < 3")
def schema_growth(spark, d):
    """EXT-15"""
    part = table(spark, d, "part")
    known = part.where("p_size > 48").select(F.lower("p_type").alias("type_id"), F.lit(3).alias("version")).distinct()
    new = part.where("p_size < 3").select(F.concat(F.lit(" "), "p_type", F.lit("_New")).alias("type_id"))
    return x.grow_schema(known, new.unionByName(known.select("type_id")))


@register("paper_rebuild", "SELECT doc_id, lang, 'old' AS v FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, lang, 'new' FROM documents WHERE lang = 'fr' AND doc_id % 2 = 0")
def paper_rebuild(spark, d):
    """EXT-18, EXT-19, EXT-34"""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return x.rebuild_groups(docs.withColumn("v", F.lit("old")), docs.where("lang = 'fr' and doc_id % 2 = 0").withColumn("v", F.lit("new")), "lang")


@register("batch_delete", "SELECT o_custkey AS doc_id, bool_or(o_custkey IN (SELECT doc_id FROM documents)) AS deleted FROM orders GROUP BY 1")
def batch_delete(spark, d):
    """EXT-23, SINK-13"""
    return x.batch_delete(table(spark, d, "documents"), table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")), "doc_id")[1]


@register("formula_norms", r"SELECT item_id, 'x' || item_id || ' = 5α and rate-σ' AS formula FROM benchmark")
def formula_norms(spark, d):
    """STR-07"""
    text = F.concat(F.lit("\\mathrm{x"), "item_id", F.lit("} = 5 \\alpha and \\text{rate}−\\sigma"))
    return table(spark, d, "benchmark").select("item_id", x.formula(text).alias("formula"))


@register("float_lists", "SELECT o_orderkey, o_totalprice + 1.5 AS total FROM orders")
def float_lists(spark, d):
    """COL-10"""
    xs = F.array(F.col("o_totalprice").cast("string"), F.lit("n/a"), F.lit("1.5"), F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", F.aggregate(x.float_list(xs), F.lit(0.0), lambda s, v: s + v).alias("total"))


@register("reference_recovery_due", "SELECT doc_id, doc_id % 20 < greatest(12, least(18, floor(n_chars / 1000.0 * 0.45))) AS due FROM documents")
def reference_recovery_due(spark, d):
    """CIT-03"""
    return table(spark, d, "documents").select("doc_id", x.recovery_due(F.col("doc_id") % 20, F.col("n_chars")).alias("due"))


@register("answer_graph", fx.sql("claim") + " SELECT DISTINCT * FROM (SELECT 'q' || step_type AS source, chunk_id AS target FROM claim UNION ALL SELECT chunk_id, 'paper:' || CASE WHEN paper_id % 5 > 0 THEN paper_id::VARCHAR ELSE paper_source END FROM claim)")
def answer_graph(spark, d):
    """GRAPH-19"""
    rows = fx.claims(spark, d).select(F.concat(F.lit("q"), "step_type").alias("question"), F.when(F.col("paper_id") % 5 > 0, F.col("paper_id")).alias("paper_id"), "paper_source", "chunk_id")
    return x.answer_graph(rows)[1]


@register("topic_candidates", "SELECT c_nationkey AS community_id, count(DISTINCT c_mktsegment) AS paper_count FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 2")
def topic_candidates(spark, d):
    """FIL-17"""
    return x.topic_candidates(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("community_id")).agg(F.count_distinct("c_mktsegment").alias("paper_count")))


@register("preview_update", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'new' ELSE lang END AS lang, source FROM documents")
def preview_update(spark, d):
    """SINK-05"""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    new = docs.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "new").alias("lang"))
    return x.preview_update(docs, new, "doc_id", ["lang"])


@register("rendered_prompts", "SELECT item_id, 'Item ' || item_id || ' {{other}}: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS prompt FROM benchmark")
def rendered_prompts(spark, d):
    """STR-22"""
    values = {"id": F.col("item_id"), "text": tx.compact_whitespace(F.col("text"))}
    return table(spark, d, "benchmark").select("item_id", tx.render_template("Item {{id}} {{other}}: {{text}}", values).alias("prompt"))


def _purpose_model(rows: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model that labels citations: now and then with unknown labels, lists of other lengths, or nothing."""
    labels = {0: ["MethodUse", "Nonsense", "Theory"], 1: ["Survey"], 2: [], 3: ["Nonsense"], 4: ["DataTool", "Theory"]}
    scores = {0: ["0.3", "0.9", "high"], 1: ["7"], 2: ["0.5"], 3: ["0.5"], 4: ["0.9"]}
    form = rows["o_orderkey"] % 5
    return pd.DataFrame({"o_orderkey": rows["o_orderkey"], "labels": form.map(labels), "scores": form.map(scores)})


@register(
    "single_purposes",
    """SELECT o_orderkey, (['Theory:0.4;MethodUse:0.3','Survey:1.0','Background:0.4','Background:0.4','DataTool:0.4;Theory:0.4'])[o_orderkey % 5 + 1] AS purposes FROM orders""",
)
def single_purposes(spark, d):
    """EXT-08: an injected model's labels of each citation, made sound."""
    rows = x.call_model(table(spark, d, "orders").select("o_orderkey"), _purpose_model, "o_orderkey long, labels array<string>, scores array<string>", 64)
    pairs = c.single_purpose(F.col("labels"), F.col("scores"))
    return rows.select("o_orderkey", F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["label"], p["score"].cast("string"))), ";").alias("purposes"))


@register(
    "summary_steps",
    """WITH s AS (SELECT unnest(['Background','Problem','Method','Experiment','Result','Conclusion']) AS step_type, unnest([0,1,2,3,4,5]) AS i)
    SELECT item_id, step_type, CASE WHEN i % 2 = 0 THEN trim(substr(text, i * 10 + 1, 40)) ELSE '' END AS summary, CASE WHEN i = 2 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM benchmark, s""",
)
def summary_steps(spark, d):
    """EXT-06: half of the steps come from a stand-in of a model, the others are filled."""
    b = table(spark, d, "benchmark")
    found = b.select("item_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))).alias("i"), "text")
    found = found.select("item_id", F.array(*map(F.lit, x.SUMMARY_STEPS))[F.col("i")].alias("step_type"), F.substr("text", F.col("i") * 10 + 1, F.lit(40)).alias("summary"), F.when(F.col("i") == 2, 0.8).when(F.col("i") == 4, 0.0).alias("confidence"))
    return x.summary_steps(b, found, "item_id")


@register(
    "keyed_claims",
    r"""WITH c AS (SELECT '/runs/' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN ' 10.1/AB' || doc_id ELSE '' END AS doi, trim(string_split(text, chr(10))[1]) AS text FROM documents)
    SELECT substr(sha256(path || chr(0) || text), 1, 24) AS claim_id, substr(sha256(lower(trim(doi)) || chr(0) || regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.;。；\s]+$', '')), 1, 24) AS claim_key, text, 0.5::DOUBLE AS confidence FROM c WHERE text <> ''""",
)
def keyed_claims(spark, d):
    """EXT-06: the first line of each document as its claim."""
    doc = F.col("doc_id")
    doi = F.when(doc % 2 == 0, F.concat(F.lit(" 10.1/AB"), "doc_id"))
    rows = table(spark, d, "documents").select(F.concat(F.lit("/runs/"), "doc_id", F.lit(".md")).alias("path"), doi.alias("doi"), F.split("text", "\n")[0].alias("text"), F.lit(None).cast("double").alias("confidence"))
    return x.keyed_claims(rows)


@register(
    "rename_triggers",
    """WITH p AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(replace(p_type, ' ', '_')) WHEN p_size % 3 = 1 THEN lower(replace(p_type || ' of ' || p_brand || ' in parts of many kinds', ' ', '_')) ELSE lower(replace(p_type, ' ', '_')) END AS pattern_id, p_size % 5 = 0 AS abstract FROM part)
    SELECT pattern_id, CASE WHEN pattern_id = upper(pattern_id) THEN 'upper' ELSE 'long_stitched' END AS reason, length(pattern_id)::INT AS len FROM p
    WHERE NOT abstract AND (pattern_id = upper(pattern_id) AND length(pattern_id) > 4 OR length(pattern_id) >= 45 AND len(string_split(pattern_id, '_')) > 2)""",
)
def rename_triggers(spark, d):
    """EXT-14: patterns whose names have grown unwieldy."""
    kind = F.replace("p_type", F.lit(" "), F.lit("_"))
    long_ = F.replace(F.concat("p_type", F.lit(" of "), "p_brand", F.lit(" in parts of many kinds")), F.lit(" "), F.lit("_"))
    name = F.when(F.col("p_size") % 3 == 0, F.upper(kind)).when(F.col("p_size") % 3 == 1, F.lower(long_)).otherwise(F.lower(kind))
    return x.rename_triggers(table(spark, d, "part").select(name.alias("pattern_id"), (F.col("p_size") % 5 == 0).alias("abstract")).distinct(), ["defines", "measures"])


@register(
    "split_groups",
    """WITH e AS (SELECT DISTINCT l_suppkey AS pattern, l_partkey AS edge FROM lineitem), g AS (SELECT l_suppkey AS pattern, l_linenumber AS grp, l_partkey AS edge FROM lineitem WHERE l_linenumber < 4 AND l_quantity > 25),
    f AS (SELECT pattern, edge, min(grp) AS grp FROM g GROUP BY 1, 2), m AS (SELECT pattern, max(grp) + 1 AS rest FROM g GROUP BY 1),
    p AS (SELECT pattern, edge, coalesce(f.grp, rest, 0)::INT AS grp FROM e LEFT JOIN f USING (pattern, edge) LEFT JOIN m USING (pattern)),
    n AS (SELECT pattern, grp, count(*) AS n FROM p GROUP BY 1, 2), l AS (SELECT pattern, count(*) FILTER (n >= 3) >= 2 AS fires FROM n GROUP BY 1) SELECT pattern, edge, grp, fires FROM p JOIN l USING (pattern)""",
)
def split_groups(spark, d):
    """EXT-14: edges of each pattern under the groups named for them."""
    li = table(spark, d, "lineitem")
    edges = li.select(F.col("l_suppkey").alias("pattern"), F.col("l_partkey").alias("edge"))
    groups = li.where("l_linenumber < 4 and l_quantity > 25").select(F.col("l_suppkey").alias("pattern"), F.col("l_linenumber").alias("grp"), F.col("l_partkey").alias("edge"))
    return x.split_groups(edges, groups.unionByName(groups.limit(1).withColumn("edge", F.lit(-1).cast("long"))))


@register(
    "layered_settings",
    """SELECT c_custkey, least(64, greatest(1, CASE WHEN c_custkey % 3 = 0 THEN floor(c_acctbal / 100) WHEN c_custkey % 3 = 1 THEN c_nationkey ELSE 4 END))::DOUBLE AS workers,
    least(1, greatest(0, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal / 1000 ELSE 0.5 END))::DOUBLE AS least FROM customer""",
)
def layered_settings(spark, d):
    """EXT-27: settings of a profile under those of a run, some of them no numbers."""
    cust, form = table(spark, d, "customer"), F.col("c_custkey") % 3
    row = lambda layer, key, value: F.struct(F.lit(layer).alias("layer"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    rows = F.array(
        row(0, "workers", F.when(form < 2, F.col("c_nationkey"))), row(1, "workers", F.when(form == 0, F.floor(F.col("c_acctbal") / 100).cast("string")).otherwise(F.lit("many"))),
        row(1, "least", F.when(form == 1, F.col("c_acctbal") / 1000)), row(1, "color", F.lit("3")),
    )
    layers = cust.select("c_custkey", F.explode(rows).alias("r")).select("c_custkey", "r.*")
    return x.layered_settings(layers, "c_custkey", {"workers": (4, 1, 64), "least": (0.5, 0, 1)})


@register(
    "paper_workers",
    """SELECT c_custkey, greatest(1, least(32, greatest(1, floor(c_nationkey * 4 / 6.0)), CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 * 5 ELSE 7 END))::INT AS workers FROM customer""",
)
def paper_workers(spark, d):
    """EXT-27: the worker count that follows from other settings."""
    n, i = F.col("c_nationkey"), F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", x.paper_workers(n * 4, F.lit(6), i % 4 * 5, F.lit(7), 1, 32).alias("workers"))


@register(
    "schema_faults",
    """WITH s AS (SELECT c_custkey, (['research','poem'])[c_custkey % 2 + 1] AS t, c_custkey % 3 AS f, c_nationkey % 9 AS e FROM customer)
    SELECT c_custkey AS schema_id, array_to_string(list_filter([CASE WHEN t = 'poem' THEN 'paper_type' END, CASE WHEN f > 0 THEN 'steps' END, CASE WHEN e = 0 THEN 'claims_per_paper' END,
      CASE WHEN e > 6 OR e < 2 THEN 'machine_evidence' END, CASE WHEN e > 3 THEN 'citation_context_sentence_window' END], lambda x: x IS NOT NULL), ';') AS faults FROM s""",
)
def schema_faults(spark, d):
    """HG-15: schemas with repeated or malformed steps and rules out of bounds."""
    i, e = F.col("c_custkey"), (F.col("c_nationkey") % 9).cast("int")
    steps = F.when(i % 3 == 0, F.array(F.lit("setup"), F.lit("result"))).when(i % 3 == 1, F.array(F.lit("setup"), F.lit("setup"))).otherwise(F.array(F.lit("2nd step")))
    pairs = {"claims_per_paper_min": F.lit(1), "claims_per_paper_max": e, "machine_evidence_min": F.lit(2), "machine_evidence_max": e, "logic_evidence_max": F.lit(8), "citation_context_sentence_window": e}
    rules = F.create_map(*[y for k, v in pairs.items() for y in (F.lit(k), v)])
    kind = F.array(F.lit("research"), F.lit("poem"))[(i % 2).cast("int")]
    rows = table(spark, d, "customer").select(i.alias("schema_id"), kind.alias("paper_type"), steps.alias("steps"), F.array(F.lit("Gap"), F.lit("Result")).alias("claim_kinds"), rules.alias("rules"))
    return x.schema_faults(rows).select("schema_id", F.array_join("faults", ";").alias("faults"))


@register("store_rewrite", "SELECT vec_id, label, CASE WHEN label = 1 THEN 'new' ELSE 'old' END AS state, len(embedding)::INT AS width FROM embeddings")
def store_rewrite(spark, d):
    """SRC-12, SINK-19: a store of vectors by label, written, one label rewritten, and read again."""
    rows, store = table(spark, d, "embeddings"), shared_folder(spark, "store")
    x.write_partition(rows.withColumn("state", F.lit("old")), store, "label")
    x.write_partition(rows.where("label = 1").withColumn("state", F.lit("new")), store, "label")
    return spark.read.parquet(store).select("vec_id", F.col("label").cast("int").alias("label"), "state", F.size("embedding").alias("width"))


#: The schema that a run begins with, and how many levels a paper of eight sections can have.
_TYPES = [f"T{i}" for i in range(4)]
_LEVELS = 8
_SECTIONS = """e AS (SELECT DISTINCT p_partkey AS src, dst FROM (SELECT p_partkey, unnest([p_partkey + p_size % 3 + 1, p_partkey + 3]) AS dst FROM part) WHERE p_partkey // 8 = dst // 8)"""


def _part_model(rows):
    """A model that reads what it is given: the sum of the numbers in its context, and whether its schema knows the type."""
    import json
    import re

    import pandas as pd

    out = []
    for r in rows.itertuples():
        kind, span = r.text.split("|")
        total = (int(r.node) + sum(int(x) for x in re.findall(r"\] (\d+)", r.context))) % 1000
        known = kind in r.schema.split(": ")[1].split(", ")
        atom = {"layer": "L1", "entity_type": kind.lower(), "evidence_span": span, "confidence": 0.9 if known else 0.5}
        out.append((r.paper_id, r.node, json.dumps([atom]), str(total)))
    return pd.DataFrame(out, columns=["paper_id", "node", "atoms", "summary"])


@register(
    "chained_extraction",
    f"""WITH RECURSIVE {_SECTIONS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON r.node = e.src),
    l AS (SELECT node, node // 8 AS paper, max(level)::INT AS level, 'T' || (node % 9) AS kind, node % 5 <> 0 AS proof FROM r GROUP BY 1),
    g AS (SELECT *, min(level) FILTER (proof) OVER (PARTITION BY paper, kind) AS first FROM l),
    s0 AS MATERIALIZED (SELECT node, node % 1000 AS v FROM l WHERE level = 0)"""
    + "".join(
        f""", s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT l.node, ((l.node + sum(p.v)) % 1000)::BIGINT FROM l JOIN e ON e.dst = l.node JOIN s{k - 1} p ON p.node = e.src WHERE level = {k} GROUP BY l.node)"""
        for k in range(1, _LEVELS)
    )
    + f""" SELECT paper::VARCHAR AS paper_id, node::VARCHAR AS node, level, v::VARCHAR AS summary, CASE WHEN kind IN ('T0', 'T1', 'T2', 'T3') OR first < level THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence,
    kind NOT IN ('T0', 'T1', 'T2', 'T3') AND coalesce(first >= level, true) AS gap FROM g JOIN s{_LEVELS - 1} USING (node)""",
)
def chained_extraction(spark, d):
    """EXT-10: an injected model called level by level, with the summaries before it and a schema that grows in the run."""
    k = F.col("p_partkey")
    e = table(spark, d, "part").select(k.alias("src"), F.explode(F.array(k + F.col("p_size") % 3 + 1, k + 3)).alias("dst")).where("src div 8 = dst div 8").distinct()
    paper = lambda c: (F.col(c) / 8).cast("long").cast("string")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    text = F.concat(F.lit("T"), F.col("n") % 9, F.lit("|"), F.when(F.col("n") % 5 != 0, "shown").otherwise(""))
    sections = nodes.select(paper("n").alias("paper_id"), F.col("n").cast("string").alias("node"), F.lit("definition").alias("role"), text.alias("text"))
    deps = e.select(paper("dst").alias("paper_id"), F.col("dst").cast("string").alias("node"), F.col("src").cast("string").alias("dep"), F.col("src").alias("pos"))
    base = spark.createDataFrame([("entity_type", t) for t in _TYPES], "kind string, value string")
    run = chained.extract_chained(sections, deps, base, _part_model)
    atoms = run.atoms.select("paper_id", "node", F.get_json_object("atom", "$.confidence").cast("double").alias("confidence"))
    gaps = run.gaps.select("paper_id", "node", F.lit(True).alias("gap"))
    section = ["paper_id", "node"]
    out = run.calls.select("paper_id", "node", "level").join(run.summaries.hint("merge"), section).join(atoms.hint("merge"), section).join(gaps.hint("merge"), section, "left")
    return out.select("paper_id", "node", "level", "summary", "confidence", F.coalesce("gap", F.lit(False)).alias("gap"))


def _atom_file(spark, d):
    """A line for each order with an atom for each of its items; some lines are cut short, blank, or lack the paper."""
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 != 0, "CONTRIBUTION_RELATION").otherwise("CONTRIBUTION")
    relation = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "N", "conflicts").otherwise("extends")
    name = F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("claim "), F.col("l_suppkey") % 3))
    atom = F.struct(
        F.lit("L3").alias("layer"), kind.alias("type"), name.alias("from"), relation.alias("relation"), F.concat(F.lit("t"), "l_partkey").alias("to"),
        F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("q"), "l_linenumber")).alias("qualifier"),
    )
    # items of equal number are told apart by all that they hold
    atoms = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.to_json(atom).alias("atom")))).alias("xs"))
    body = F.concat(F.lit('"atoms": ["not an object", '), F.array_join(F.transform("xs", lambda x: x.atom), ", "), F.lit("]}"))
    k = F.col("l_orderkey")
    line = F.when(k % 17 == 0, F.concat(F.lit('{"paper_id": "cut", '), F.substring(body, 1, 40))).when(k % 19 == 0, "  ").when(k % 23 == 0, F.concat(F.lit("{"), body))
    return atoms.select(k.alias("line_no"), line.otherwise(F.concat(F.lit('{"paper_id": "p'), k, F.lit('", '), body)).alias("line"))


@register(
    "claim_relations",
    """WITH a AS (SELECT l_orderkey, l_linenumber, 'claim ' || (l_suppkey % 3) AS claim, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'N' THEN 'conflicts' ELSE 'extends' END || '>t' || l_partkey || '>' || CASE WHEN l_linenumber % 2 = 1 THEN 'q' || l_linenumber ELSE '' END AS r
      FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_suppkey % 5 <> 0 AND l_orderkey % 17 <> 0 AND l_orderkey % 19 <> 0 AND l_orderkey % 23 <> 0)
    SELECT 'p' || l_orderkey AS paper_id, claim, count(*) AS n, array_to_string(list_sort(list(r)), ';') AS relations FROM a GROUP BY l_orderkey, claim""",
)
def claim_relations(spark, d):
    """SRC-13, COL-07: atoms read by their schema, and the relations of each claim gathered."""
    found = payloads.claim_relations(_atom_file(spark, d))
    flat = F.transform("relations", lambda x: F.concat_ws(">", x.relation, x.to, F.coalesce(x.qualifier, F.lit(""))))
    return found.select("paper_id", "claim", F.size("relations").cast("long").alias("n"), F.array_join(F.array_sort(flat), ";").alias("relations"))


@register(
    "payload_faults",
    """SELECT CASE WHEN l_orderkey % 17 = 0 THEN 'malformed' WHEN l_orderkey % 19 = 0 THEN 'blank' WHEN l_orderkey % 23 = 0 THEN 'missing paper_id' ELSE 'none' END AS fault, count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem) GROUP BY 1""",
)
def payload_faults(spark, d):
    """COL-07: how many payloads their schema refuses, and why."""
    return payloads.atom_lines(_atom_file(spark, d)).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


def _answers(rows):
    import pandas as pd

    return pd.DataFrame({"o_orderkey": rows["o_orderkey"].to_numpy(), "answer": [p and p.lower() for p in rows["o_orderpriority"]]})


def _refuses(rows):
    raise OSError("busy")


@register(
    "routed_calls",
    """WITH f AS (SELECT *, (['a', 'b', 'c', 'a', 'c', 'a'])[o_orderkey % 6 + 1] AS w FROM orders)
    SELECT o_orderkey, lower(o_orderpriority) AS answer, CASE WHEN w = 'b' THEN (['a', 'c', 'a', 'c', 'a'])[o_orderkey % 5 + 1] ELSE w END AS worker, CASE WHEN w = 'b' THEN 2 ELSE 1 END AS attempt FROM f""",
)
def routed_calls(spark, d):
    """§2.14: calls dealt over the slots of four workers, one of them off, another one down."""
    workers = [routing.Worker("a", _answers, 3), routing.Worker("off", _answers, 9, False), routing.Worker("b", _refuses), routing.Worker("c", _answers, 2)]
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return routing.routed_calls(rows, "o_orderkey", workers, "o_orderkey long, answer string", place=F.col("o_orderkey"))[0]


def _long_lines(rows):
    """A model of the query: the lines of over 100 characters are claims; it fails on papers whose id ends in 3."""
    if int(rows["paper_id"].iloc[0]) % 10 == 3:
        raise ValueError("no answer")
    return rows[rows["text"].str.len() > 100].assign(confidence=0.5)


@register(
    "batch_ingest",
    """WITH d AS (SELECT doc_id, text, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') = '' AS blank, min(doc_id) OVER (PARTITION BY text) AS first FROM documents),
    s AS (SELECT *, CASE WHEN blank THEN 'empty' WHEN first <> doc_id THEN 'duplicate' WHEN doc_id % 10 = 3 THEN 'failed' ELSE 'ingested' END AS status FROM d),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM s WHERE status IN ('failed', 'ingested')),
    n AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (length(line) > 100 AND doc_id % 10 <> 3) AS n_claims FROM l WHERE trim(line) <> '' GROUP BY 1)
    SELECT doc_id AS paper_id, status, CASE WHEN status = 'failed' THEN 'no answer' END AS error, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_claims, 0) AS n_claims FROM s LEFT JOIN n USING (doc_id)""",
)
def batch_ingest(spark, d):
    """EXT-18: the documents ingested as one batch, with what became of each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    chunks = spark.createDataFrame([], "paper_id long, chunk_id string, pos int, text string")
    return ingest.ingest_documents(docs, chunks, spark.createDataFrame([], ingest.CLAIM), _long_lines).report
