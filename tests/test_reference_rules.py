"""Rules of the reference, retyped as rows, and operators against versions that go one by one."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evidence, sampling


def plan_of(spark, question, answer):
    row = spark.createDataFrame([(question, answer)], "q string, a string").select(evidence.query_plan(F.col("q"), F.col("a")).alias("p")).first().p
    return row.intent, row.retrieval_plan, row.main_query, row.community_query, row.fallback


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"intent":"foundational","retrieval_plan":"textbook_first_then_paper","paper_query":"p"}', None),
        ('{"intent":"unknown","retrieval_plan":"not_a_plan","main_query":"m"}', None),
        ('{"intent":"foundational","retrieval_plan":"proposition_first","main_query":"m","proposition_query":"cluster"}', ("foundational", "community_first", "m", "cluster", False)),
        ('noise {"intent":"comparison","retrieval_plan":"hybrid_parallel","main_query":"m"} noise', ("comparison", "hybrid_parallel", "m", None, False)),
        ('{"intent":"comparison","retrieval_plan":"hybrid","main_query":"m"}', None),
        ('{"intent":"comparison","retrieval_plan":" claim_first ","main_query":"m"}', None),
        ('{"intent":"comparison","retrieval_plan":"claim_first","main_query":"m","reason":4}', None),
        ('{"intent":"comparison","retrieval_plan":"claim_first","main_query":"m","extra":4,"z_query":"z","a_query":"a"}', ("comparison", "claim_first", "m", "z", False)),
        ('{"intent":"comparison","retrieval_plan":"x","main_query":"m","old_query":null}', ("comparison", "community_first", "m", "None", False)),
        ("[1, 2]", None), ("", None), (None, None), ("{broken", None),
    ],
)
def test_query_plan(spark, answer, want):
    assert plan_of(spark, " asked? ", answer) == (want or ("paper_detail", "paper_first_then_textbook", "asked?", None, True))


def one_by_one(edges, node_limit, edge_limit):
    taken, nodes = [], set()
    for e in edges:
        if len(taken) >= edge_limit:
            break
        if len(nodes) + (e[0] not in nodes) + (e[1] not in nodes) <= node_limit:
            taken.append(e)
            nodes |= {e[0], e[1]}
    return taken, nodes


def brute_connected(nodes, edges, node_limit, edge_limit):
    ids = {n[0]: n for n in nodes}
    valid = [e for e in edges if e[0] != e[1] and e[0] in ids and e[1] in ids]
    degree = dict.fromkeys(ids, 0)
    for e in valid:
        degree[e[0]] += 1
        degree[e[1]] += 1
    order = sorted(set(valid), key=lambda e: (-degree[e[0]] - degree[e[1]], e[2], e[0], e[1]))
    taken, chosen = one_by_one(order, node_limit, edge_limit)
    chapters = {}
    for n in sorted((n for n in nodes if n[0] not in chosen), key=lambda n: (-degree[n[0]], n[1] or n[0], n[0])):
        chapters.setdefault(n[2], []).append(n[0])
    while len(chosen) < node_limit and any(chapters.values()):
        for c in sorted(chapters):
            if chapters[c] and len(chosen) < node_limit:
                chosen.add(chapters[c].pop(0))
    for e in order:
        if len(taken) < edge_limit and e not in taken and e[0] in chosen and e[1] in chosen:
            taken.append(e)
    return chosen, taken


@pytest.mark.parametrize("seed", range(4))
def test_connected_sample_matches_one_by_one(spark, seed):
    r = random.Random(seed)
    nodes = [(f"n{i}", r.choice(["", f"name{r.randrange(5)}"]), f"c{r.randrange(3)}") for i in range(30)]
    edges = [(f"n{r.randrange(32)}", f"n{r.randrange(32)}", r.choice("xy")) for _ in range(60)]
    n, e = spark.createDataFrame(nodes, "node string, name string, chapter string"), spark.createDataFrame(edges, "source string, target string, rel_type string")
    for node_limit, edge_limit in [(1, 5), (2, 3), (7, 100), (8, 4), (15, 20), (100, 100)]:
        kept, taken = sampling.connected_sample(n, e, node_limit, edge_limit)
        want = brute_connected(nodes, edges, node_limit, edge_limit)
        assert ({x.node for x in kept.collect()}, sorted(tuple(x) for x in taken.collect())) == (want[0], sorted(want[1])), (node_limit, edge_limit)


def brute_fusion(nodes, edges, node_limit, edge_limit):
    ids, seen, rows = {}, set(), []
    for n in nodes:
        ids.setdefault(n[1], n)
    for e in edges:
        if e[1] in ids and e[2] in ids and e[1:4] not in seen:
            seen.add(e[1:4])
            rows.append(e)
    if len(ids) <= node_limit and len(rows) <= edge_limit:
        return set(ids), [e[1:] for e in rows]
    degree = dict.fromkeys(ids, 0)
    for e in rows:
        degree[e[1]] += 1
        degree[e[2]] += 1
    order = [e[1:] for e in sorted(rows, key=lambda e: (-sampling.TYPE_BONUS.get(e[3], 0) - e[4], -max(degree[e[1]], degree[e[2]]), e[0]))]
    _, chosen = one_by_one(order, node_limit, edge_limit)
    rest = [i for i in ids if i not in chosen] if chosen else sorted(ids, key=lambda i: -degree[i])
    chosen |= set(rest[: node_limit - len(chosen)])
    return chosen, [e for e in order if e[0] in chosen and e[1] in chosen][:edge_limit]


@pytest.mark.parametrize("seed", range(3))
def test_fusion_sample_matches_one_by_one(spark, seed):
    r = random.Random(seed)
    nodes = [(i, f"n{i % 25}", "LogicStep", "t") for i in range(30)]
    edges = [(i, f"n{r.randrange(27)}", f"n{r.randrange(25)}", r.choice(["EXPLAINS", "HAS_CLAIM", "odd"]), r.randrange(4) / 4) for i in range(60)]
    n, e = spark.createDataFrame(nodes, "no long, id string, label string, text string"), spark.createDataFrame(edges, "no long, source string, target string, type string, weight double")
    for node_limit, edge_limit in [(1, 5), (2, 3), (6, 50), (9, 4), (100, 20), (100, 100)]:
        kept, taken = sampling.fusion_sample(n, e, node_limit, edge_limit)
        want = brute_fusion(nodes, edges, node_limit, edge_limit)
        assert ({x.id for x in kept.collect()}, sorted(tuple(x) for x in taken.collect())) == (want[0], sorted(want[1])), (node_limit, edge_limit)


def test_fusion_sample_keeps_the_connected_backbone(spark):
    n = spark.createDataFrame([(i, x, "K", x) for i, x in enumerate(["isolated-a", "isolated-b", "logic-1", "entity-1"])], "no long, id string, label string, text string")
    e = spark.createDataFrame([(0, "logic-1", "entity-1", "EXPLAINS", 0.96), (1, "ghost", "entity-1", "EXPLAINS", 0.8)], "no long, source string, target string, type string, weight double")
    kept, taken = sampling.fusion_sample(n, e, 2, 10)
    assert {x.id for x in kept.collect()} == {"logic-1", "entity-1"} and taken.count() == 1


def test_noise_filter_rules(spark):
    texts = [
        "Figure 1: a flow", "Fig. 2. Entropy of flow", "Viscosity is a measure", "Entropy is defined as disorder", "Stress is the force is a load", "Speed increases", "Stress refers to force", "It grew", "C++ is a language is the tool",
    ]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, pos int, text string")
    kept, stats = evidence.noise_filter(df, F.col("text").rlike("^Fig"), "doc", "pos", ["entropy", " ", "c++"])
    assert [r.pos for r in kept.orderBy("pos").collect()] == [1, 3, 4, 5, 7, 8]
    assert stats.first().asDict() == {
        "raw_count": 9, "filtered_count": 6, "caption_filtered": 1, "definition_filtered": 2, "whitelist_preserved": 3, "context_preserved": 1, "filter_rate": 3 / 9,
    }
    none, stats = evidence.noise_filter(df, F.col("text").rlike("^Fig"), "doc", "pos", None, False, False)
    assert none.count() == 9 and stats.first().filter_rate == 0.0


@pytest.mark.parametrize("least", [0.05, 0.5, 0.8, 1.0])
def test_jaccard_join_matches_all_pairs(spark, least):
    from quillspark.operators.relational import jaccard_join

    r = random.Random(2)
    sets = [(i, r.sample("the of and aa bb cc dd ee ff gg hh".split(), r.randrange(0, 9))) for i in range(60)]
    got = {(x.a, x.b): round(x.score, 9) for x in jaccard_join(spark.createDataFrame(sets, "k long, s array<string>"), "k", least).collect()}
    want = {}
    for i, x in sets:
        for j, y in sets:
            if i < j and (union := len({*x, *y})) and (both := len({*x} & {*y})) and both / union >= least:
                want[(i, j)] = round(both / union, 9)
    assert got == want


def test_surface_norms(spark):
    from quillspark.functions import kernels

    texts = [" Granular  Materials. ", "granular_materials", "(μ(I)-rheology)", "ﬁne/grained", "①:", "İx", "", None, "é ǘ", "a⃝ b", "x \ty"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", kernels.norm_surface("t").alias("s"), kernels.norm_for_match("t").alias("m")).orderBy("i").collect()
    assert [r.s for r in got][:5] == ["granular materials", "granular materials", "μ(i) rheology", "fine/grained", "1"]
    assert got[6].s == got[7].s == got[6].m == got[7].m == ""
    # a mark that encloses takes space and stays
    assert [r.m for r in got][8:] == ["e u", "a⃝ b", "x y"] and got[5].m == "Ix"


def test_seeded_sample(spark):
    from quillspark.sources.documents import seeded_sample

    rows = spark.range(300).withColumnRenamed("id", "k")
    hashes = {r.k: r.h for r in rows.select("k", F.xxhash64(F.col("k").cast("string"), F.lit(7)).alias("h")).collect()}
    assert [r.k for r in seeded_sample(rows, "k", 7, 20).collect()] == sorted(hashes, key=lambda k: (hashes[k], k))[:20]
    assert {r.k for r in seeded_sample(rows.repartition(7), "k", 7, 20).collect()} == {r.k for r in seeded_sample(rows, "k", 7, 20).collect()}
    assert seeded_sample(rows, "k", 8, 20).collect() != seeded_sample(rows, "k", 7, 20).collect() and seeded_sample(rows, "k", 7, 999).count() == 300


def test_surfaces_merge_across_marks_and_widths(spark):
    from quillspark.operators.hypergraph import merge_surfaces

    rows = [(1, 1, "Granular Materials", ["A"]), (2, 2, " granular_materials.", ["B"]), (2, 3, "ｇranular  materials", ["A"]), (1, 4, "μ(I)", ["C"]), (1, 5, "(Μ(I))", ["C"]), (1, 6, None, ["D"]), (1, 7, "x/y", [])]
    got = {r.key: (r.surface, r.labels, r.papers) for r in merge_surfaces(spark.createDataFrame(rows, "paper_id int, nid int, surface string, labels array<string>")).collect()}
    assert got["granular materials"] == ("Granular Materials", ["A", "B"], 2) and got["x/y"] == ("x/y", [], 1) and set(got) == {"granular materials", "μ(i", "x/y", ""}


ANCHORED = [
    ("Cats sleep. Dogs run far; they bark! Dogs run.", "dogs run"), ("One. Two? Three", "zzz"), ("Alpha beta gamma " * 20 + ". Short end.", "beta"), ("速度增加。压力 降低！ 温度不变", "压力"), ("x. ... !!", "!!"), ("", "a"), (None, None),
    ("Only one sentence without an end " * 12, ""), ("a:b c-d. 12.5 kg; 3_4", "12.5"),
]


def python_best(text, anchor, most=220):
    import re

    compact = lambda s: re.sub(r"\s+", " ", s or "").strip()

    def tokens(s):
        return set(re.findall("[一-鿿]", s)) or {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_:+./-]*|\d[\d_./-]*", s)}

    def score(s):
        a, b = tokens(s), tokens(compact(anchor))
        if a and b:
            return len(a & b)
        return len(compact(anchor)) if compact(anchor) and compact(anchor).lower() in s.lower() else 0

    parts = [p for p in re.split(r"(?<=[.!?。！？;；])\s+", compact(text)) if p]
    if not parts:
        return ""
    best = max(enumerate(parts), key=lambda p: (score(p[1]), -len(p[1]), -p[0]))[1]
    if len(best) <= most:
        return best
    window = best[:most]
    for mark in ".!?。！？;；":
        if (at := window.rfind(mark)) >= most // 2:
            return window[: at + 1].strip()
    return window.rstrip(" ,;:") + "..."


def test_best_sentence_and_truncation(spark):
    from quillspark.functions import text as tx

    df = spark.createDataFrame([(i, *x) for i, x in enumerate(ANCHORED)], "i int, t string, a string")
    got = [r.s for r in df.select("i", tx.best_sentence(F.col("t"), F.col("a"), 40).alias("s")).orderBy("i").collect()]
    assert got == [python_best(t, a, 40) for t, a in ANCHORED]


def test_operation_phrases(spark):
    from quillspark.functions import text as tx

    texts = ["Uses a finite-element solver for drag.", "We use X", "Proposed  graph (v2) model via tokens", "by hand", "- leveraging - it -", "Applies to", None, "toward forms"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", tx.operation_phrase(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == ["a finite-element solver", "we use x", "graph v2 model", "", "leveraging - it", "", "", "toward forms"]


def test_sentence_chunks_and_segments():
    from quillspark.functions.kernels import segments, sentence_chunks

    text = "One two. Three four? Five six seven eight nine! " * 3
    assert sentence_chunks("short. text", 20) == ["short. text"] and "".join(sentence_chunks(text, 20)) == text.rstrip()  # a blank rest goes
    # from the half of the length up to twice that length, full stops first
    assert sentence_chunks("aaaa bbbb cccc. dddd? eeee. ffff", 12)[0] == "aaaa bbbb cccc."
    assert sentence_chunks("x" * 500, 100) == ["x" * 300, "x" * 200]
    assert segments("  ab cd  ", 20, 5) == ["ab cd"] and segments(" \n", 20, 5) == []
    assert segments("aaaa bbbb cccc dddd", 10, 2) == ["aaaa bbbb", "b cccc", "c dddd"]
