"""Community trees against modularity counted one edge at a time, and seeded or random operators against their definitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph

EDGES = "grp int, source string, target string, weight double"


def modularity(edges, of):
    whole = 2 * sum(w for _, _, w in edges)
    inside, degree = {}, {}
    for u, v, w in edges:
        degree[of[u]] = degree.get(of[u], 0) + w
        degree[of[v]] = degree.get(of[v], 0) + w
        if of[u] == of[v]:
            inside[of[u]] = inside.get(of[u], 0) + 2 * w
    return sum(inside.get(c, 0) / whole - (d / whole) ** 2 for c, d in degree.items())


def levels_of(spark, edges):
    rows = graph.community_tree(spark.createDataFrame([(0, *e) for e in edges], EDGES), "grp").collect()
    out = {}
    for r in rows:
        out.setdefault(r.level, {})[r.node] = r.community
    return [out[k] for k in sorted(out)]


def test_rings_of_cliques(spark):
    # eight cliques of five in a ring; its best partition unites neighbours only if that gains
    edges = [(f"{c}.{i}", f"{c}.{j}", 1.0) for c in range(8) for i, j in itertools.combinations(range(5), 2)]
    edges += [(f"{c}.0", f"{(c + 1) % 8}.1", 1.0) for c in range(8)]
    levels = levels_of(spark, edges)
    scores = [modularity(edges, of) for of in levels]
    assert scores == sorted(scores) and scores[-1] >= modularity(edges, {n: n.split(".")[0] for e in edges for n in e[:2]}) - 1e-9
    for low, high in itertools.pairwise(levels):  # a community stays together
        assert len({(low[n], high[n]) for n in low}) == len(set(low.values()))
    assert all(len({levels[0][f"{c}.{i}"] for i in range(5)}) == 1 for c in range(8))


def best_of_all(edges):
    nodes = sorted({n for e in edges for n in e[:2]})

    def partitions(k, parts):
        if k == len(nodes):
            yield dict(zip(nodes, parts, strict=True))
            return
        for c in range(max(parts, default=-1) + 2):
            yield from partitions(k + 1, [*parts, c])

    return max(modularity(edges, of) for of in partitions(0, []))


@pytest.mark.parametrize("seed", range(2))
def test_small_graphs_come_near_the_best_partition(spark, seed):
    r = random.Random(seed)
    edges = [(u, v, r.choice([0.5, 1.0, 2.0])) for u, v in itertools.combinations("abcdefg", 2) if r.random() < (0.9 if (u < "d") == (v < "d") else 0.2)]
    assert modularity(edges, levels_of(spark, edges)[-1]) >= 0.8 * best_of_all(edges)


def test_tree_of_nothing_and_of_single_edges(spark):
    assert levels_of(spark, []) == []
    assert len(set(levels_of(spark, [("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 5.0)])[-1].values())) == 1


def test_typed_projection(spark):
    e = spark.createDataFrame([("e1", "Bubble", None), ("e2", " ", "described"), ("e3", None, None), (" ", "x", None)], "entity_id string, name string, description string")
    r = spark.createDataFrame([("e1", "e2", None), ("e1", "e2", "CAUSES"), ("e1", "e2", "CAUSES"), ("e1", "e3", "CAUSES"), ("ghost", "e1", "X")], "start_id string, end_id string, rel_type string")
    s = spark.createDataFrame([("s1", "p", "Method", "sum"), ("s2", "p", "Method", "more"), ("s3", "p", "Result", " ")], "logic_step_id string, paper_id string, step_type string, summary string")
    c = spark.createDataFrame([("c1", "p", "Method", "t"), ("c2", "p", "Result", "t"), ("c3", "p", "Method", "")], "claim_id string, paper_id string, step_type string, text string")
    nodes, edges = graph.typed_projection(e, r, s, c)
    assert sorted((n.node, n.label, n.text) for n in nodes.collect()) == [
        ("c1", "Claim", "t"), ("c2", "Claim", "t"), ("e1", "KnowledgeEntity", "Bubble"), ("e2", "KnowledgeEntity", "described"), ("s1", "LogicStep", "sum"), ("s2", "LogicStep", "more"),
    ]
    assert sorted(tuple(x) for x in edges.collect()) == [("e1", "e2", "CAUSES"), ("e1", "e2", "CAUSES"), ("e1", "e2", "RELATES_TO"), ("s1", "c1", "HAS_CLAIM"), ("s2", "c1", "HAS_CLAIM")]


def test_closure_that_does_not_end_in_time_raises(spark):
    chain = spark.range(40).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    assert graph.transitive_closure(chain).count() == 40 * 41 // 2
    with pytest.raises(RuntimeError, match="3 rounds"):
        graph.transitive_closure(chain, 3)


def test_label_propagation_one_by_one(spark):
    r = random.Random(3)
    edges = [(u, v, float(r.randrange(1, 4))) for u, v in itertools.combinations(range(12), 2) if r.random() < 0.25]
    label = {n: n for e in edges for n in e[:2]}
    for _ in range(3):
        votes = {n: {label[n]: 1e-9} for n in label}
        for u, v, w in edges:
            votes[u][label[v]] = votes[u].get(label[v], 0) + w
            votes[v][label[u]] = votes[v].get(label[u], 0) + w
        label = {n: min(x, key=lambda c: (-round(x[c], 6), c)) for n, x in votes.items()}
    got = graph.label_propagation(spark.createDataFrame(edges, "u long, v long, weight double"), 3)
    assert {x.node: x.label for x in got.collect()} == label
