"""Graph operators as iterated joins: expansion, closure, levels, candidate graphs, communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillspark.operators.aggregates import keyword_top, materialize_communities
from quillspark.operators.components import connected_components
from quillspark.session import materialize, spread, stored


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions, each once."""
    return edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).distinct()


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """GRAPH-03: (node, hop) for nodes within `hops` steps of start (node), the start excluded; a node's least hop."""
    both = materialize(undirected(edges))  # every hop reads them
    seen = frontier = start.select("node", F.lit(0).alias("hop")).distinct()
    for h in range(1, hops + 1):
        reached = frontier.join(both, frontier.node == both.u).select(F.col("v").alias("node")).distinct()
        frontier = materialize(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def transitive_closure(edges: DataFrame, max_rounds: int = 20) -> DataFrame:
    """GRAPH-17: (child, ancestor, depth) from (child, parent); paths double each round; cycles end at known pairs.

    A shortest path longer than all known ones begins with one of the longest known length, so only pairs of that depth
    are extended.
    """
    known = materialize(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    n = known.count()
    for r in range(max_rounds):  # 20 doublings reach paths of a million edges
        a, b = spread(known.where(F.col("depth") == 2**r), n, "ancestor").alias("a"), spread(known, n, "child").alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.child")).select(
            F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth")
        )
        known = materialize(spread(known.unionByName(longer), 2 * n, "child", "ancestor").groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        m = known.count()
        if m == n:
            return known
        n = m
    raise RuntimeError(f"paths still grew after {max_rounds} rounds")


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRAPH-18: (node, level): the longest path from a source; a cycle is an error, as no level of it is the last."""
    level = materialize(nodes.select("node", F.lit(0).alias("level")))
    rounds = level.count()  # no path without a cycle has as many edges
    for _ in range(rounds):
        # merge joins, as a broadcast would send the levels of every round through the driver
        pushed = edges.join(level.hint("merge"), edges.src == level.node).groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("up"))
        new = materialize(level.join(pushed.hint("merge"), "node", "left").select("node", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.coalesce("up", F.lit(0)) > F.col("level")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        level = new.drop("moved")
        if not moved:
            return level
    if rounds:
        raise ValueError("the graph has a cycle")
    return level


def candidate_graph(similar: DataFrame, shared: DataFrame, cited: DataFrame, papers: DataFrame, shared_default: float = 0.15, cited_default: float = 0.05) -> DataFrame:
    """GRAPH-08: canonical pairs with summed scores of three edge sources; pairs inside a paper and sums not above 0 go.

    The edge sources are (source, target, score); papers is (node, paper_id).
    """
    parts = similar.select("source", "target", "score")
    parts = parts.unionByName(shared.select("source", "target", F.coalesce("score", F.lit(shared_default)).alias("score")))
    parts = parts.unionByName(cited.select("source", "target", F.coalesce("score", F.lit(cited_default)).alias("score")))
    summed = parts.where("source != target").groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.round(F.sum("score"), 6).alias("weight"))
    a = papers.select(F.col("node").alias("source"), F.col("paper_id").alias("pa"))
    b = papers.select(F.col("node").alias("target"), F.col("paper_id").alias("pb"))
    return summed.where("weight > 0").join(a, "source").join(b, "target").where("pa != pb").select("source", "target", "weight")


def pair_communities(edges: DataFrame, per_node: int = 2, rows: int | None = None) -> DataFrame:
    """GRAPH-09: one community of two for each edge; a node keeps its heaviest ones, and communities that lose a member go.

    The id is the pair itself, so that no global numbering is needed. With the number of edges, or a larger one, as rows,
    a task ranks a bounded part of them.
    """
    ends = edges.select("source", "target", "weight", F.explode(F.array("source", "target")).alias("node_id"))
    ends = (spread(ends, 2 * rows, "node_id") if rows else ends).select(F.concat_ws("|", "source", "target").alias("community_id"), "weight", "node_id")
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("weight"), "community_id"))
    kept = ends.withColumn("rank", rank).where(F.col("rank") <= per_node)
    whole = kept.groupBy("community_id").agg(F.count("*").alias("n")).where("n = 2")
    return kept.join(whole, "community_id", "left_semi")


def rebuilt_communities(nodes: DataFrame, similar: DataFrame, shared: DataFrame, cited: DataFrame, words: int = 3) -> tuple[DataFrame, DataFrame]:
    """GRAPH-10: (members, communities) anew from three edge sources; nodes: (node, paper_id, text).

    Members: (community_id, member_id, paper_id, weight, core), core where the pair is the node's heaviest. Communities:
    counts of members, papers and core members, and a label, the most frequent words of the members' texts.
    """
    pairs = pair_communities(candidate_graph(similar, shared, cited, nodes.select("node", "paper_id")))
    members = pairs.join(nodes, pairs["node_id"] == nodes["node"]).select("community_id", F.col("node_id").alias("member_id"), "paper_id", "weight", (F.col("rank") == 1).alias("core"), "text")
    tokens = members.select("community_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    top = keyword_top(tokens, "community_id", words).groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("xs"))
    label = top.select("community_id", F.array_join(F.transform("xs", lambda x: x.token), " ").alias("label"))
    return members.drop("text"), materialize_communities(members).join(label, "community_id", "left").na.fill("", ["label"])


def communities(nodes: DataFrame, edges: DataFrame, least_weight: float = 0.5) -> DataFrame:
    """GRAPH-07: components of the edges from a weight on, with size, mean weight and representative (degree, text length, id).

    nodes: (node, text); edges: (source, target, weight). Nodes without such edges are communities of one, confidence 0.5.
    """
    strong = edges.where(F.col("weight") >= least_weight)
    found = connected_components(strong, "source", "target")
    member = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    degree = strong.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    inner = strong.join(found, strong.source == found.node).groupBy("component").agg(F.avg("weight").alias("confidence"))
    ranked = member.join(degree, "node", "left").na.fill(0, ["degree"])
    best = ranked.groupBy("component").agg(
        F.count("*").alias("size"),
        F.max_by("node", F.struct("degree", F.length("text"), -F.col("node"))).alias("representative"),
        # members in any order give one hash, without a list of them
        F.sha2(F.concat_ws("|", F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))), F.count("*")), 256).alias("h"),
    )
    return best.join(inner, "component", "left").select(
        F.concat(F.lit("fc:"), F.substring("h", 1, 12)).alias("community_id"), "component", "size", "representative", F.round(F.coalesce("confidence", F.lit(0.5)), 6).alias("confidence")
    )


def _both_ways(edges: DataFrame, by: str) -> DataFrame:
    """(by, u, v, weight): edges (by, source, target, weight) in both directions, equal ones summed; loops and weights of 0 or less go."""
    both = edges.where("source != target and weight > 0")
    both = both.select(by, F.col("source").alias("u"), F.col("target").alias("v"), "weight").unionByName(both.select(by, F.col("target").alias("u"), F.col("source").alias("v"), "weight"))
    return materialize(both.groupBy(by, "u", "v").agg(F.sum("weight").alias("weight")))


def _turns(u: str, rounds: int) -> Column:
    """One bit for each two rounds: in which of them the node may move."""
    bits = [F.shiftleft(F.pmod(F.xxhash64(u, F.lit(k)), F.lit(2)), k) for k in range((rounds + 1) // 2)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))


def _whole(both: DataFrame, by: str) -> DataFrame:
    """(by, whole): the weight of each graph, derived once and not in each round."""
    return materialize(both.groupBy(by).agg(F.sum("weight").alias("whole")))


def _moved(both: DataFrame, whole: DataFrame, by: str, rounds: int, tolerance: float) -> DataFrame:
    """(by, u, community) after moves over both (by, u, v, weight, turns); a row from a node to itself counts for its degree alone.

    In a round only the edges of nodes whose turn it is are sent, once to the communities at their other ends and
    once back; sizes of communities travel with them. What a node does next comes from the one join that brings it what is around.
    """
    around_of = both.where("u != v")
    home = both.groupBy(by, "u").agg(F.sum("weight").alias("degree")).withColumn("community", F.col("u"))
    home, still = materialize(home), 0
    for r in range(rounds):
        held = home.groupBy(by, "community").agg(F.sum("degree").alias("held"))
        placed = home.join(held, [by, "community"]).select(by, F.col("u").alias("v"), "community", "held")
        asked = around_of.where(F.shiftright("turns", r // 2).bitwiseAND(F.lit(1)) == r % 2).select(by, "u", "v", "weight")
        # dealt by node, so that what follows needs no further shuffle of edges
        met = asked.join(placed, [by, "v"]).select(by, "u", "community", "weight", "held").repartition(by, "u")
        around = met.groupBy(by, "u", "community").agg(F.sum("weight").alias("pull"), F.max("held").alias("held"))
        seen = home.select(by, "u", "degree", F.col("community").alias("own")).join(around, [by, "u"], "left").join(F.broadcast(whole), by)
        others = F.col("held") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(0.0)
        seen = seen.withColumn("gain", F.col("pull") - others * F.col("degree") / F.col("whole"))
        best = seen.groupBy(by, "u", "degree", "own").agg(
            F.min_by("community", F.struct(-F.round("gain", 9), F.col("community"))).alias("to"), F.max("gain").alias("gain"),
            F.coalesce(F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))), F.lit(0.0)).alias("stay"),
        )
        goes = F.coalesce(F.col("gain") > F.greatest("stay", F.lit(0.0)) + tolerance, F.lit(False))
        home = best.select(by, "u", "degree", F.when(goes, F.col("to")).otherwise(F.col("own")).alias("community"), goes.alias("moved"))
        seen_moves = Observation()
        home = stored(home.observe(seen_moves, F.count_if("moved").alias("moved"))).drop("moved")
        still = 0 if seen_moves.get["moved"] else still + 1
        if still == 2:
            break
    return home.select(by, "u", "community")


def local_moving(edges: DataFrame, by: str, rounds: int = 12, tolerance: float = 1e-9) -> DataFrame:
    """GRAPH-05: one level of modularity moves in rounds of joins, each graph (by) on its own; (by, node, community), largest community first.

    In each round half of the nodes, chosen anew by a hash, may move to the neighbouring community that
    gains most: the weight to it less what its degrees let expect. It ends when both halves rest, or
    after `rounds`. Nodes that move together see the communities as they were before, so results may
    differ from those of moves one by one; groups of any size are spread over the tasks.
    """
    both = _both_ways(edges, by)
    home = _moved(both.withColumn("turns", _turns("u", rounds)), _whole(both, by), by, rounds, tolerance)
    sizes = home.groupBy(by, "community").agg(F.count("*").alias("size"), F.min("u").alias("least"))
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("size"), "least")) - 1
    return home.join(sizes.select(by, "community", order.alias("no")), [by, "community"]).select(by, F.col("u").alias("node"), F.col("no").alias("community"))


def community_tree(edges: DataFrame, by: str, levels: int = 10, rounds: int = 12, tolerance: float = 1e-9) -> DataFrame:
    """GRAPH-11: (by, node, level, community) of a hierarchy: moves, then the communities as nodes of a smaller graph, and again.

    Edges inside a community stay with it as its own weight. It ends where a level unites nothing more, which is left
    out, or after `levels`. A community is named by one of its nodes; nodes without edges are in none.
    """
    both = _both_ways(edges, by)
    # numbers in the order of the nodes, so that names are not shuffled in each round
    names = stored(both.select(F.col("u").alias("name")).distinct().orderBy("name").select("name", F.monotonically_increasing_id().alias("no"), _turns("name", rounds).alias("turns")))
    both = both.join(names.select(F.col("name").alias("u"), F.col("no").alias("nu"), "turns"), "u").join(names.select(F.col("name").alias("v"), F.col("no").alias("nv")), "v")
    both = stored(both.select(by, F.col("nu").alias("u"), F.col("nv").alias("v"), "weight", "turns"))
    whole = _whole(both, by)
    place, found, last = None, [], -1
    for level in range(levels):
        home = stored(_moved(both, whole, by, rounds, tolerance))
        if not home.where("u != community").limit(1).count():
            break
        last = level
        step = home.select(by, F.col("u").alias("was"), "community")
        now = home.select(by, F.col("u").alias("node"), "community") if place is None else place.withColumnRenamed("community", "was").join(step, [by, "was"]).select(by, "node", "community")
        ends = both.drop("turns").join(step.select(by, F.col("was").alias("u"), F.col("community").alias("cu")), [by, "u"]).join(step.select(by, F.col("was").alias("v"), F.col("community").alias("cv")), [by, "v"])
        summed = stored(ends.groupBy(by, F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("weight").alias("weight")))
        # a community without edges to others stays as it is on all further levels, and none of them looks at it again
        opened = summed.where("u != v").select(by, F.col("u").alias("community")).distinct().withColumn("open", F.lit(True))
        placed = stored(now.join(opened, [by, "community"], "left").select(by, "node", "community", F.lit(level).alias("level"), F.coalesce("open", F.lit(False)).alias("open")))
        found.append(placed)
        place = placed.where("open").select(by, "node", "community")
        both = summed.join(opened.select(by, F.col("community").alias("u")), [by, "u"], "left_semi")
        both = stored(both.join(names.select(F.col("no").alias("u"), "turns"), "u"))
        if not both.limit(1).count():
            break
    if not found:
        found, last = [both.select(by, F.col("u").alias("node"), F.col("u").alias("community"), F.lit(0).alias("level"), F.lit(True).alias("open")).distinct()], 0
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.join(names.select(F.col("no").alias("node"), F.col("name").alias("node_name")), "node").join(names.select(F.col("no").alias("community"), F.col("name").alias("community_name")), "community")
    # names are joined before what stays is repeated for its levels
    until = F.when(F.col("open"), F.col("level")).otherwise(F.lit(last))
    return out.select(by, F.col("node_name").alias("node"), F.explode(F.sequence("level", until)).alias("level"), F.col("community_name").alias("community"))


def typed_projection(entities: DataFrame, relations: DataFrame, steps: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRAPH-11: nodes (node, label, text) and edges (source, target, relation) of one multigraph.

    entities (entity_id, name, description), relations (start_id, end_id, rel_type), steps (logic_step_id, paper_id, step_type, summary),
    claims (claim_id, paper_id, step_type, text). Rows without an id or text go; relations need both entities and are
    RELATES_TO where they have no type; a claim hangs on the steps of its paper and type. Parallel edges stay.
    """
    strip = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    ids = {"KnowledgeEntity": ("entity_id", F.coalesce(F.nullif(strip("name"), F.lit("")), strip("description")), entities), "LogicStep": ("logic_step_id", strip("summary"), steps), "Claim": ("claim_id", strip("text"), claims)}
    nodes = {label: rows.select(strip(i).alias("node"), F.lit(label).alias("label"), text.alias("text"), *[c for c in ("paper_id", "step_type") if c in rows.columns]).where("node != '' and text != ''") for label, (i, text, rows) in ids.items()}
    known = nodes["KnowledgeEntity"].select("node").distinct()
    edges = relations.select(strip("start_id").alias("source"), strip("end_id").alias("target"), F.coalesce(F.nullif(strip("rel_type"), F.lit("")), F.lit("RELATES_TO")).alias("relation"))
    for end in ("source", "target"):
        edges = edges.join(known.withColumnRenamed("node", end), end, "left_semi")
    at = {label: nodes[label].select(F.col("node").alias(label), strip("paper_id").alias("paper_id"), strip("step_type").alias("step_type")) for label in ("LogicStep", "Claim")}
    hung = at["LogicStep"].where("paper_id != '' and step_type != ''").join(at["Claim"], ["paper_id", "step_type"])
    edges = edges.select("source", "target", "relation").unionByName(hung.select(F.col("LogicStep").alias("source"), F.col("Claim").alias("target"), F.lit("HAS_CLAIM").alias("relation")))
    out = nodes["KnowledgeEntity"].select("node", "label", "text")
    for label in ("LogicStep", "Claim"):
        out = out.unionByName(nodes[label].select("node", "label", "text"))
    return out, edges


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """GRAPH-11: (node, label) after synchronous rounds; each node takes the heaviest label around it, ties to the least.

    Stands in for the external tree clustering, which is not available; results differ from it.
    """
    both = F.array(F.struct("u", "v", "weight"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    both = materialize(edges.select(F.inline(both)))  # every round reads them
    label = both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(label, both.v == label.node).select("u", "label", F.col("weight").alias("w"))
        own = label.select(F.col("node").alias("u"), "label", F.lit(1e-9).alias("w"))
        # dealt by node once for both sums
        best = votes.unionByName(own).repartition("u").groupBy("u", "label").agg(F.sum("w").alias("w")).groupBy("u").agg(F.max_by("label", F.struct(F.round("w", 6), -F.col("label"))).alias("label"))
        label = materialize(best.select(F.col("u").alias("node"), "label"))
    return label


def overview_links(keywords: DataFrame, least: int = 2) -> DataFrame:
    """GRAPH-12: links of communities (community_id, keyword) by shared keywords; weight min(0.96, 0.34 + 0.16 score)."""
    a, b = keywords.withColumnRenamed("community_id", "a"), keywords.withColumnRenamed("community_id", "b")
    score = a.join(b, "keyword").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return score.withColumn("weight", F.round(F.least(F.lit(0.96), 0.34 + 0.16 * F.col("shared")), 6))
