"""Queries of graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graph as g
from quillspark.operators import sampling
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import spread, table


def _edges(spark, d):
    """Customers and suppliers as nodes of one graph, by large orders."""
    o = table(spark, d, "orders").where("o_totalprice > 460000").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select((F.col("o_custkey") + 1000000).alias("u"), F.col("l_suppkey").alias("v")).distinct()


_EDGES = "e AS (SELECT DISTINCT o_custkey + 1000000 AS u, l_suppkey AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 460000), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e)"


@register(
    "khop_expand",
    f"""WITH RECURSIVE {_EDGES}, r(node, hop) AS (SELECT 7::BIGINT, 0 UNION SELECT b.v, r.hop + 1 FROM r JOIN b ON r.node = b.u WHERE r.hop < 3)
    SELECT node, min(hop)::INT AS hop FROM r WHERE node <> 7 GROUP BY 1""",
)
def khop_expand(spark, d):
    """GRAPH-03"""
    return g.k_hop(_edges(spark, d), spark.createDataFrame([(7,)], "node long"), 3)


@register(
    "connected_components",
    f"""WITH RECURSIVE {_EDGES}, r(s, node) AS (SELECT u, u FROM b UNION SELECT r.s, b.v FROM r JOIN b ON r.node = b.u) SELECT s AS node, min(node) AS component FROM r GROUP BY 1""",
)
def connected_components(spark, d):
    """GRAPH-07, GRAPH-16"""
    return g.connected_components(_edges(spark, d), "u", "v")


_TREE = "t AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0)"


@register(
    "subclass_closure",
    f"WITH RECURSIVE {_TREE}, c(child, ancestor, depth) AS (SELECT child, parent, 1 FROM t UNION ALL SELECT c.child, t.parent, c.depth + 1 FROM c JOIN t ON c.ancestor = t.child) SELECT child, ancestor, min(depth)::INT AS depth FROM c GROUP BY 1, 2",
)
def subclass_closure(spark, d):
    """GRAPH-17"""
    t = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    return g.transitive_closure(t)


@register(
    "topological_levels",
    f"""WITH RECURSIVE {fx.LAYERS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    r(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON r.node = e.src) SELECT node, max(level)::INT AS level FROM r GROUP BY 1""",
)
def topological_levels(spark, d):
    """GRAPH-18"""
    e = fx.layers(spark, d)
    return g.topological_levels(e, e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())


@register(
    "ego_graph_weights",
    f"""WITH {_EDGES}, c AS (SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS n FROM e GROUP BY 1, 2), s AS (SELECT x.u AS a, y.u AS b, count(*) AS n FROM e x JOIN e y ON x.v = y.v AND x.u < y.u GROUP BY 1, 2),
    z AS (SELECT a, b, n::DOUBLE AS w FROM c UNION ALL SELECT a, b, 0.6 * n FROM s) SELECT a, b, round(sum(w), 6) AS weight FROM z GROUP BY 1, 2""",
)
def ego_graph_weights(spark, d):
    """GRAPH-04: citations plus 0.6 for each shared neighbour, on canonical pairs."""
    e = _edges(spark, d)
    c = e.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").cast("double").alias("w"))
    s = e.select(F.col("u").alias("a"), "v").join(e.select(F.col("u").alias("b"), "v"), "v").where("a < b").groupBy("a", "b").agg((0.6 * F.count("*")).alias("w"))
    return c.unionByName(s).groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"))


_CAND = """s AS (SELECT l_suppkey AS source, l_partkey % 100 AS target, l_discount AS score FROM lineitem WHERE l_linenumber = 1),
h AS (SELECT l_partkey % 100 AS source, l_suppkey AS target, NULL::DOUBLE AS score FROM lineitem WHERE l_linenumber = 2), c AS (SELECT l_suppkey AS source, l_suppkey + 1 AS target, NULL::DOUBLE AS score FROM lineitem WHERE l_linenumber = 3),
u AS (SELECT source, target, score FROM s UNION ALL SELECT source, target, coalesce(score, 0.15) FROM h UNION ALL SELECT source, target, coalesce(score, 0.05) FROM c),
cand AS (SELECT least(source, target) AS source, greatest(source, target) AS target, round(sum(score), 6) AS weight FROM u WHERE source <> target GROUP BY 1, 2)"""


def _sources(spark, d):
    """Similar, shared and cited edges, and their nodes with paper_id."""
    li = table(spark, d, "lineitem")
    null = F.lit(None).cast("double").alias("score")
    p = (F.col("l_partkey") % 100).alias("p")
    s = li.where("l_linenumber = 1").select(F.col("l_suppkey").alias("source"), p.alias("target"), F.col("l_discount").alias("score"))
    h = li.where("l_linenumber = 2").select(p.alias("source"), F.col("l_suppkey").alias("target"), null)
    c = li.where("l_linenumber = 3").select(F.col("l_suppkey").alias("source"), (F.col("l_suppkey") + 1).alias("target"), null)
    nodes = s.select(F.explode(F.array("source", "target")).alias("node")).unionByName(h.select(F.explode(F.array("source", "target")).alias("node"))).unionByName(c.select(F.explode(F.array("source", "target")).alias("node"))).distinct()
    return s, h, c, nodes.withColumn("paper_id", F.col("node") % 4)


@register("candidate_graph", f"WITH {_CAND} SELECT * FROM cand WHERE weight > 0 AND source % 4 <> target % 4")
def candidate_graph(spark, d):
    """GRAPH-08"""
    s, h, c, nodes = _sources(spark, d)
    return g.candidate_graph(s, h, c, nodes)


@register(
    "community_rebuild",
    f"""WITH {_CAND}, e AS (SELECT * FROM cand WHERE weight > 0 AND source % 4 <> target % 4), n AS (SELECT source || '|' || target AS community_id, weight, unnest([source, target]) AS node FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, community_id) AS rank FROM n), k AS (SELECT *, count(*) OVER (PARTITION BY community_id) AS n FROM r WHERE rank <= 2),
    m AS (SELECT community_id, node, node % 4 AS paper_id, rank = 1 AS core, coalesce(p_name, '') AS text FROM k LEFT JOIN part ON p_partkey = node WHERE n = 2),
    t AS (SELECT community_id, token, count(*) AS n FROM (SELECT community_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM m) GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY n DESC, token) AS rank FROM t), l AS (SELECT community_id, string_agg(token, ' ' ORDER BY rank) AS label FROM q WHERE rank <= 3 GROUP BY 1)
    SELECT community_id, count(*) AS member_count, count(DISTINCT paper_id) AS paper_count, count(*) FILTER (core) AS core_member_count, coalesce(any_value(label), '') AS label FROM m LEFT JOIN l USING (community_id) GROUP BY 1""",
)
def community_rebuild(spark, d):
    """GRAPH-10: communities from three edge sources, with members counted and labels."""
    s, h, c, nodes = _sources(spark, d)
    named = nodes.join(table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("text")), "node", "left").na.fill("", ["text"])
    return g.rebuilt_communities(named, s, h, c)[1]


@register(
    "pair_communities",
    """WITH e AS (SELECT l_suppkey AS source, l_partkey + 10000 AS target, round(sum(l_discount), 6) AS weight FROM lineitem GROUP BY 1, 2),
    n AS (SELECT source || '|' || target AS community_id, weight, unnest([source, target]) AS node_id FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY weight DESC, community_id)::INT AS rank FROM n),
    k AS (SELECT *, count(*) OVER (PARTITION BY community_id) AS n FROM r WHERE rank <= 2) SELECT community_id, weight, node_id, rank FROM k WHERE n = 2""",
)
def pair_communities(spark, d):
    """GRAPH-09"""
    li = table(spark, d, "lineitem")
    n = li.count()
    pairs = spread(li.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 10000).alias("target"), "l_discount"), n, "source", "target")
    return g.pair_communities(pairs.groupBy("source", "target").agg(F.round(F.sum("l_discount"), 6).alias("weight")), rows=n)


@register(
    "fusion_communities",
    """WITH RECURSIVE e AS (SELECT p_partkey AS source, (p_partkey * 7 + 3) % 900 AS target, p_size / 50.0::DOUBLE AS weight FROM part), n AS (SELECT p_partkey AS node, p_name AS text FROM part UNION SELECT (p_partkey * 7 + 3) % 900, 'x' FROM part WHERE (p_partkey * 7 + 3) % 900 NOT IN (SELECT p_partkey FROM part)),
    g AS (SELECT * FROM e WHERE weight >= 0.7 AND source <> target), b AS (SELECT source u, target v FROM g UNION SELECT target, source FROM g),
    r(s, node) AS (SELECT node, node FROM n UNION SELECT r.s, b.v FROM r JOIN b ON r.node = b.u), k AS (SELECT s AS node, min(node) AS component FROM r GROUP BY 1),
    dg AS (SELECT node, count(*) AS degree FROM (SELECT unnest([source, target]) AS node FROM g) GROUP BY 1), c AS (SELECT component, avg(weight) AS confidence FROM g JOIN k ON g.source = k.node GROUP BY 1),
    q AS (SELECT component, node, row_number() OVER (PARTITION BY component ORDER BY coalesce(degree, 0) DESC, length(text) DESC, node) AS rn, count(*) OVER (PARTITION BY component) AS size FROM n JOIN k USING (node) LEFT JOIN dg USING (node))
    SELECT component, size, node AS representative, round(coalesce(confidence, 0.5), 6) AS confidence FROM q LEFT JOIN c USING (component) WHERE rn = 1""",
)
def fusion_communities(spark, d):
    """GRAPH-07, GRAPH-15: components with confidence and representative."""
    part = table(spark, d, "part")
    to = (F.col("p_partkey") * 7 + 3) % 900
    e = part.select(F.col("p_partkey").alias("source"), to.alias("target"), (F.col("p_size") / 50).alias("weight")).where("source != target")
    own = part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("text"))
    other = part.select(to.alias("node"), F.lit("x").alias("text")).distinct().join(own, "node", "left_anti")
    return g.communities(own.unionByName(other), e, 0.7).drop("community_id")


@register("louvain_local")
def louvain_local(spark, d):
    """GRAPH-05, GRAPH-06: local moving in rounds within each of 25 trade graphs."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    e = li.groupBy((F.col("l_suppkey") % 25).cast("long").alias("grp"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 30 + 100000).alias("target")).agg(F.count("*").cast("double").alias("weight"))
    return g.local_moving(e, "grp")


@register("label_propagation")
def label_propagation(spark, d):
    """GRAPH-11"""
    return g.label_propagation(_edges(spark, d).withColumn("weight", F.lit(1.0)), 4)


@register(
    "overview_links",
    """WITH k AS (SELECT DISTINCT p_brand AS community_id, p_type AS keyword FROM part) SELECT a.community_id AS a, b.community_id AS b, count(*) AS shared, round(least(0.96, 0.34 + 0.16 * count(*))::DOUBLE, 6) AS weight
    FROM k a JOIN k b USING (keyword) WHERE a.community_id < b.community_id GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def overview_links(spark, d):
    """GRAPH-12, SET-03"""
    return g.overview_links(table(spark, d, "part").select(F.col("p_brand").alias("community_id"), F.col("p_type").alias("keyword")).distinct())


@register(
    "logic_trace",
    fx.sql("step") + ", c AS (SELECT paper_id, step_type, count(*) AS n, string_agg(claim_id, ';' ORDER BY pos) AS claims FROM claim GROUP BY 1, 2) SELECT paper_id, logic_step_id, step_order, n, claims FROM step JOIN c USING (paper_id, step_type)",
)
def logic_trace(spark, d):
    """GRAPH-20: each step with its claims nested."""
    c = fx.claims(spark, d).groupBy("paper_id", "step_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "claim_id"))).alias("xs"))
    out = fx.logic_steps(spark, d).join(c, ["paper_id", "step_type"])
    return out.select("paper_id", "logic_step_id", "step_order", "n", F.array_join(F.transform("xs", lambda x: x.claim_id), ";").alias("claims"))


def _book(spark, d):
    """A textbook's graph: suppliers and parts, with a relation for each line item, of the line's flag."""
    sup = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name"), F.lit("suppliers").alias("chapter"))
    part = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("chapter"))
    rel = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("rel_type"))
    return sup.unionByName(part), rel


_BOOK = """n AS (SELECT 's' || s_suppkey AS node, s_name AS name, 'suppliers' AS chapter FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name, p_brand FROM part),
    r AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS rel_type FROM lineitem),
    v AS (SELECT r.* FROM r JOIN n a ON a.node = source JOIN n b ON b.node = target)"""


@register(
    "textbook_sample",
    f"""WITH {_BOOK}, d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM v UNION ALL SELECT target FROM v) GROUP BY 1),
    e AS (SELECT source, target, rel_type, row_number() OVER (ORDER BY -(a.degree + b.degree), rel_type, source, target) AS pos FROM (SELECT DISTINCT * FROM v) JOIN d a ON a.node = source JOIN d b ON b.node = target),
    met AS (SELECT node, min(pos) AS pos FROM (SELECT source AS node, pos FROM e UNION ALL SELECT target, pos FROM e) GROUP BY 1),
    cum AS (SELECT e.pos, (SELECT count(*) FROM met WHERE met.pos <= e.pos) AS k FROM e WHERE e.pos <= 1000),
    pa AS (SELECT max(pos) AS pos, max(k) AS k FROM cum WHERE k <= 260), sa AS (SELECT node FROM met, pa WHERE met.pos <= pa.pos),
    nx AS (SELECT min(e.pos) AS pos FROM e, pa WHERE e.pos > pa.pos AND pa.k = 259 AND (source IN (FROM sa)) <> (target IN (FROM sa))),
    sb AS (SELECT node FROM sa UNION SELECT unnest([source, target]) FROM e JOIN nx USING (pos)),
    g AS (SELECT e.* FROM e, pa, nx WHERE e.pos <= pa.pos OR e.pos = nx.pos OR (source IN (FROM sa) AND target IN (FROM sa)) OR (e.pos > nx.pos AND source IN (FROM sb) AND target IN (FROM sb)) ORDER BY e.pos LIMIT 520),
    s0 AS (SELECT DISTINCT unnest([source, target]) AS node FROM g),
    f AS (SELECT n.node, chapter, row_number() OVER (PARTITION BY chapter ORDER BY coalesce(degree, 0) DESC, name, n.node) AS place FROM n LEFT JOIN d USING (node) WHERE n.node NOT IN (FROM s0)),
    s1 AS (FROM s0 UNION ALL (SELECT node FROM f ORDER BY place, chapter LIMIT greatest(0, 260 - (SELECT count(*) FROM s0)))),
    more AS (SELECT source, target, rel_type FROM e WHERE pos NOT IN (SELECT pos FROM g) AND source IN (FROM s1) AND target IN (FROM s1) ORDER BY pos LIMIT greatest(0, 520 - (SELECT count(*) FROM g)))
    SELECT 'node' AS kind, node AS source, NULL AS target, NULL AS rel_type, name, chapter, (SELECT count(*) FROM n) AS total_nodes, (SELECT count(*) FROM r) AS total_edges FROM n WHERE node IN (FROM s1)
    UNION ALL SELECT 'edge', source, target, rel_type, NULL, NULL, (SELECT count(*) FROM n), (SELECT count(*) FROM r) FROM (SELECT source, target, rel_type FROM g UNION ALL FROM more)""",
)
def textbook_sample(spark, d):
    """WIN-09, GRAPH-13: 260 nodes and 520 edges of a textbook's graph, with the totals."""
    nodes, edges = _book(spark, d)
    kept, taken = sampling.connected_sample(nodes, edges)
    nothing = F.lit(None).cast("string")
    rows = kept.select(F.lit("node").alias("kind"), F.col("node").alias("source"), nothing.alias("target"), nothing.alias("rel_type"), "name", "chapter")
    rows = rows.unionByName(taken.select(F.lit("edge").alias("kind"), "source", "target", "rel_type", nothing.alias("name"), nothing.alias("chapter")))
    return rows.withColumns({"total_nodes": F.lit(nodes.count()).cast("long"), "total_edges": F.lit(edges.count()).cast("long")})


@register(
    "fusion_graph",
    """WITH n AS (SELECT 2 * o_orderkey AS no, 'o' || o_orderkey AS id, 'LogicStep' AS label FROM orders UNION ALL SELECT 2 * c_custkey + 1, 'c' || c_custkey, 'KnowledgeEntity' FROM customer),
    e0 AS (SELECT o_orderkey AS no, 'o' || o_orderkey AS source, 'c' || o_custkey AS target, CASE o_orderstatus WHEN 'F' THEN 'EXPLAINS' WHEN 'O' THEN 'HAS_CLAIM' ELSE 'OTHER' END AS type, (floor(o_totalprice)::BIGINT % 100) / 100.0::DOUBLE AS weight FROM orders),
    e AS (SELECT e0.* FROM e0 JOIN customer ON target = 'c' || c_custkey), d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1),
    k AS (SELECT e.*, row_number() OVER (ORDER BY CASE type WHEN 'EXPLAINS' THEN 5 WHEN 'HAS_CLAIM' THEN 3 ELSE 0 END + weight DESC, degree DESC, no) AS pos FROM e JOIN d ON d.id = target),
    met AS (SELECT id, min(pos) AS pos FROM (SELECT source AS id, pos FROM k UNION ALL SELECT target, pos FROM k) GROUP BY 1),
    cum AS (SELECT pos, (SELECT count(*) FROM met WHERE met.pos <= k.pos) AS c FROM k WHERE pos <= 3000), pa AS (SELECT max(pos) AS pos, max(c) AS c FROM cum WHERE c <= 1000), sa AS (SELECT id FROM met, pa WHERE met.pos <= pa.pos),
    nx AS (SELECT min(k.pos) AS pos FROM k, pa WHERE k.pos > pa.pos AND pa.c = 999 AND (source IN (FROM sa)) <> (target IN (FROM sa))), sb AS (SELECT id FROM sa UNION SELECT unnest([source, target]) FROM k JOIN nx USING (pos)),
    s1 AS (FROM sb UNION ALL (SELECT id FROM n WHERE id NOT IN (FROM sb) ORDER BY no LIMIT greatest(0, 1000 - (SELECT count(*) FROM sb))))
    SELECT source, target, type, weight FROM k WHERE source IN (FROM s1) AND target IN (FROM s1) ORDER BY pos LIMIT 3000""",
)
def fusion_graph(spark, d):
    """WIN-09, GRAPH-14: the best 3000 edges between 1000 nodes of several labels."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    step = orders.select((2 * F.col("o_orderkey")).alias("no"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("LogicStep").alias("label"), F.col("o_orderpriority").alias("text"))
    entity = customers.select((2 * F.col("c_custkey") + 1).alias("no"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("KnowledgeEntity").alias("label"), F.col("c_name").alias("text"))
    kind = F.when(F.col("o_orderstatus") == "F", "EXPLAINS").when(F.col("o_orderstatus") == "O", "HAS_CLAIM").otherwise("OTHER")
    weight = F.floor("o_totalprice") % 100 / 100
    edges = orders.select(F.col("o_orderkey").alias("no"), F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"), kind.alias("type"), weight.alias("weight"))
    return sampling.fusion_sample(step.unionByName(entity), edges)[1]


_PROJECTED = """ent AS (SELECT 'e' || p_partkey AS id, p_name AS text FROM part WHERE p_partkey % 13 <> 0),
    rel AS (SELECT 'e' || p_partkey AS source, 'e' || dst AS target, CASE WHEN p_size % 4 = 0 THEN 'RELATES_TO' ELSE p_type END AS relation FROM (SELECT *, unnest([p_partkey + p_size % 7 + 1, p_partkey + 3]) AS dst FROM part) WHERE p_partkey // 32 = dst // 32)"""


def _projection(spark, d):
    """Parts as entities, a thirteenth of them without a name; their layers as relations; steps and claims of the papers."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    entities = part.select(F.concat(F.lit("e"), k).alias("entity_id"), F.when(k % 13 != 0, F.col("p_name")).alias("name"), F.lit(None).cast("string").alias("description"))
    pairs = part.select(k, "p_size", "p_type", F.explode(F.array(k + F.col("p_size") % 7 + 1, k + 3)).alias("dst")).where("p_partkey div 32 = dst div 32")
    relations = pairs.select(F.concat(F.lit("e"), k).alias("start_id"), F.concat(F.lit("e"), "dst").alias("end_id"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("rel_type"))
    return g.typed_projection(entities, relations, fx.logic_steps(spark, d), fx.claims(spark, d))


@register(
    "typed_projection",
    fx.sql("step") + f""", {_PROJECTED} SELECT source, target, relation, count(*) AS n FROM (
      SELECT rel.* FROM rel JOIN ent a ON a.id = source JOIN ent b ON b.id = target
      UNION ALL SELECT logic_step_id, claim_id, 'HAS_CLAIM' FROM step s JOIN claim c ON c.paper_id = s.paper_id AND c.step_type = s.step_type WHERE trim(summary) <> '') GROUP BY 1, 2, 3""",
)
def typed_projection(spark, d):
    """GRAPH-11: the typed multigraph of entities, steps and claims, parallel edges counted."""
    return _projection(spark, d)[1].groupBy("source", "target", "relation").agg(F.count("*").alias("n"))


@register("community_tree")
def community_tree(spark, d):
    """GRAPH-11: a hierarchy of communities over the typed multigraph; an edge weighs as often as it stands there."""
    edges = _projection(spark, d)[1].groupBy("source", "target").agg(F.count("*").cast("double").alias("weight")).withColumn("graph", F.lit(0))
    return g.community_tree(edges, "graph").drop("graph")
