"""Behavioural cases with hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import kernels as k
from quillspark.functions import text as tx
from quillspark.operators import aggregates as a
from quillspark.operators import citations as c
from quillspark.operators import evidence as e
from quillspark.operators import extraction as x
from quillspark.operators import graph as g
from quillspark.operators import hypergraph as h
from quillspark.operators import vectors as v
from quillspark.operators import windows as w
from quillspark.operators.components import connected_components
from quillspark.sources import documents as s


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_candidate_graph_drops_pairs_of_one_paper(spark):
    similar = spark.createDataFrame([("a", "b", 0.91), ("a", "c", 0.97)], "source string, target string, score double")
    none = spark.createDataFrame([], "source string, target string, score double")
    papers = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p1")], "node string, paper_id string")
    assert [tuple(r) for r in g.candidate_graph(similar, none, none, papers).collect()] == [("a", "b", 0.91)]


def test_levels_of_long_paths_and_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(53)], "src long, dst long")
    levels = g.topological_levels(edges, spark.range(54).toDF("node"))
    assert {x.node: x.level for x in levels.collect()} == {i: i for i in range(54)}
    with pytest.raises(ValueError, match="cycle"):
        g.topological_levels(spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"), spark.range(2).toDF("node"))


def test_overlapping_communities(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.88)], "source string, target string, weight double")
    assert g.pair_communities(edges).where("node_id = 'a'").count() == 2


def test_backbone_prefers_connected(spark):
    nodes = spark.createDataFrame([("new", 2026), ("newer", 2025), ("mid", 2024), ("hub", 2020), ("bridge", 2019), ("peer", 2019)], "id string, year int")
    edges = spark.createDataFrame([("hub", "bridge", 8), ("hub", "peer", 6), ("bridge", "peer", 5)], "source string, target string, total_mentions int")
    assert {r.id for r in w.backbone(nodes, edges, 3).collect()} == {"hub", "bridge", "peer"}
    assert [r.id for r in w.backbone(nodes, edges.limit(0), 2).collect()] == ["new", "newer"]


def test_rank_fusion(spark):
    one_ = spark.createDataFrame([("c1", 1), ("c2", 2)], "id string, pos int")
    two = spark.createDataFrame([("c2", 1), ("c3", 2)], "id string, pos int")
    got = v.reciprocal_rank_fusion([one_, two], "id", [F.col("pos")]).orderBy(F.desc("score")).collect()
    assert [r.id for r in got] == ["c2", "c1", "c3"]


def test_first_reference_wins(spark):
    refs = spark.createDataFrame([(1, 1, "First ref entry", 0), (1, 1, "Duplicate of ref 1", 1)], "paper_id int, ref_num int, raw string, pos int")
    assert [r.raw for r in a.first_references(refs).collect()] == ["First ref entry"]


def test_claims_collapse_into_the_earliest_step(spark):
    rows = [(1, "Background", "Same claim.", ["A"], "k1", 0.7), (1, "Method", "same  claim", ["B"], "k2", 0.9), (1, "Method", "other", [], "k3", 0.5)]
    df = spark.createDataFrame(rows, "paper_id int, step_type string, text string, kinds array<string>, chunk_id string, confidence double")
    got = {r.key: r for r in a.merge_claims(df, ["Background", "Problem", "Method"]).collect()}
    assert got["same claim"].step == "background" and got["same claim"].confidence == 0.7
    assert got["same claim"].chunks == ["k1", "k2"] and len(got) == 2


def test_components_and_louvain(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert connected_components(edges.limit(0)).count() == 0
    two = [(0, a_, b_, 1.0) for x in ((1, 2, 3), (7, 8, 9)) for a_ in x for b_ in x if a_ < b_] + [(0, 3, 7, 0.1)]
    got = g.local_moving(spark.createDataFrame(two, "grp long, source long, target long, weight double"), "grp").collect()
    assert {frozenset(r.node for r in got if r.community == i) for i in (0, 1)} == {frozenset({1, 2, 3}), frozenset({7, 8, 9})}


def test_citation_semantics(spark):
    labels = F.array(F.lit("CritiqueLimit"), F.lit("FutureDirection"))
    assert one(spark, c.polarity(labels)) == "negative"
    assert one(spark, c.signals(labels)) == ["gap_hint", "future_opportunity_hint"]
    assert one(spark, c.scopes(labels)) == ["paper", "claim", "gap"]
    assert one(spark, c.clean_purposes(F.array(F.lit("Nope")), F.array(F.lit(0.9))))[0].label == "Unknown"


def test_merge_of_resolved_keeps_four_of_five(spark):
    rows = [("a", "b", 1, ["1"], ["e1", "e2", "e3"])]
    old = spark.createDataFrame(rows, "src string, dst string, total_mentions int, ref_nums array<string>, evidence array<string>")
    new = spark.createDataFrame([("a", "b", 2, ["2"], ["e3", "e4", "e5", "e6"])], old.schema)
    got = c.merge_resolved(old, new).first()
    assert got.total_mentions == 3 and got.evidence == ["e1", "e2", "e3", "e4"] and got.ref_nums == ["1", "2"]


def test_pattern_matching_counts_roles(spark):
    inc = spark.createDataFrame([(1, "output"), (1, "input"), (1, "input"), (2, "object"), (2, "object"), (2, "instrument")], "eid int, role string")
    slots = spark.createDataFrame([(p, i, r, x) for i, (p, rs) in enumerate(h.SEED_PATTERNS.items()) for r, x in rs], "pattern string, ord int, role string, repeatable boolean")
    assert {r.eid: r.pattern for r in h.match_patterns(inc, slots).collect()} == {1: "constitutive_law"}


def test_text_functions(spark):
    assert one(spark, tx.expand_citation_body(F.lit("13-15, 19, 14"))) == [13, 14, 15, 19]
    assert one(spark, tx.tokens(F.lit("The 深度学习 model2 of it"))) == ["深", "度", "学", "习", "model", "2", "it"]
    assert one(spark, tx.norm_text(F.lit("  a \n b. ;"))) == "a b"
    assert one(spark, tx.truncate_to_sentence(F.lit("One two. Three four five."), 12)) == "One two."
    assert one(spark, tx.best_sentence(F.lit("Cats sleep. Dogs run far."), F.lit("dogs run"))) == "Dogs run far."
    assert one(spark, s.chapter_number(F.lit("第二十三章 结论"))) == 23 and one(spark, s.chapter_number(F.lit("Chapter 7: x"))) == 7
    assert one(spark, tx.doi_of(F.lit("see doi:10.1234/AbC.5."))) == "10.1234/abc.5"
    assert one(spark, tx.render_template("{{a}}-{{b}}", {"a": F.lit(1)})) == "1-{{b}}"


def test_kernels(spark):
    df = spark.createDataFrame([("x" * 50, "text"), ("short", "text")], "text string, other string")
    parts = k.segmented(df, most=20, overlap=5).collect()
    assert [p.segment_count for p in parts].count(1) == 1 and all(len(p.segment) <= 20 for p in parts)
    quote = spark.createDataFrame([("the quick brown fox jumps", "see The  quick\nbrown fox jumps.")], "q string, t string")
    span = quote.select(k.quote_span("q", "t").alias("x")).first().x
    assert (span.start, span.mode) == (4, "normalized")


def test_sections_and_chapters(spark):
    text = "# Intro\nbody a\n\n```\n# no heading\n```\n# Method\nbody b"
    rows = s.sections(s.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id"), "doc_id")
    got = s.paragraphs(rows, "doc_id").orderBy("start_line").collect()
    assert [(r.section, r.text) for r in got][0] == ("Intro", "body a") and got[-1].section == "Method"
    assert s.chapters(rows, "doc_id").count() == 2


def test_definitions_and_comparisons(spark):
    method = "Machine learning is a method of data analysis"
    cases = [
        (method, None, True), ("Deep learning is a subset of machine learning", None, True), ("This term refers to the process of optimization", None, True),
        ("Accuracy is defined as the ratio of correct predictions", None, True), ("This metric represents what is measured in the study", None, True),
        ("The model achieves better performance and reduces errors significantly", None, False), ("This approach outperforms previous methods", None, False),
        ("Increasing temperature causes faster reactions", None, False), ("The model improves performance significantly", None, False),
        ("This method is leading to better results", None, False), ("Moreover, entropy is a measure of uncertainty", None, True),
        ("Leadership is a quality of effective management", None, True), (None, None, False), ("", None, False), ("The samples were dry", None, False),
        (method, "This approach outperforms previous methods", False), (method, "Deep learning is a subset of machine learning", True),
        ("It refers to the same", "This approach outperforms previous methods", True),
    ]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n string").select("i", e.is_pure_definition(F.col("t"), F.col("n")).alias("d"))
    assert [r.d for r in df.orderBy("i").collect()] == [d for *_, d in cases]
    dem = spark.createDataFrame([("DEM is a numerical method for computing",), ("C++ is a language",), ("ODEM is a numerical method",)], "t string")
    assert [r.d for r in dem.select(e.is_pure_definition(F.col("t"), exempt=["DEM", "C++"]).alias("d")).collect()] == [False, False, True]


def test_mojibake_is_read_again(spark):
    right = "引言，摘要，方法。，"
    wrong = right.encode().decode("gb18030")
    texts = [wrong, right, "plain", None, "", "锛 one sign", "锛锛锛 no bytes of UTF-8"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(k.recover_mojibake("t").alias("t")).collect()]
    assert got == [right, *texts[1:]]


def test_local_moving_keeps_graphs_apart(spark):
    clique = lambda g, ids: [(g, a_, b_, 1.0) for a_ in ids for b_ in ids if a_ < b_]
    rows = clique(0, range(1, 6)) + clique(0, range(11, 15)) + [(0, 1, 11, 0.2), (0, 3, 3, 9.0), (0, 1, 14, -1.0)] + clique(1, range(1, 4))
    got = g.local_moving(spark.createDataFrame(rows, "grp long, source long, target long, weight double"), "grp").collect()
    of = lambda grp, no: {r.node for r in got if r.grp == grp and r.community == no}
    assert of(0, 0) == {1, 2, 3, 4, 5} and of(0, 1) == {11, 12, 13, 14} and of(1, 0) == {1, 2, 3} and len(got) == 12


def test_degree_cap_equals_greedy(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(30), 100 + rng.randrange(30)) for _ in range(400)})
    edges = [(a, b, rng.randrange(6) / 4) for a, b in pairs]
    degree, want = {}, set()
    for a, b, weight in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if degree.get(a, 0) < 3 and degree.get(b, 0) < 3:
            want.add((a, b, weight))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    df = spark.createDataFrame([*edges, (7, 7, 99.0)], "source long, target long, weight double")
    assert {tuple(r) for r in w.degree_capped(df, 3).collect()} == want
    assert w.degree_capped(df.limit(0), 3).count() == 0


def test_char_budget_batches_carry_over(spark):
    rows = [("a", i, "x" * (i % 7)) for i in range(20_000)] + [(None, 0, None), (None, 1, "y" * 50), ("b", 0, "z")]
    got = w.char_budget_batches(spark.createDataFrame(rows, "g string, pos int, text string"), "g", "pos", 12, 5).collect()
    batch, held, n, want = 0, 0, 0, {}
    for _, i, t in rows[:20_000]:
        if n and (held + len(t) > 12 or n >= 5):
            batch, held, n = batch + 1, 0, 0
        held, n = held + len(t), n + 1
        want["a", i] = batch
    want |= {(None, 0): 0, (None, 1): 1, ("b", 0): 0}
    assert {(r.g, r.pos): r.batch for r in got} == want and len(got) == len(rows)


def test_topk_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = spark.createDataFrame([(i, i % 5, vec.tolist()) for i, vec in enumerate(data)], "node_id long, paper_id long, vec array<double>")
    monkeypatch.setattr(v, "VALUES_PER_BLOCK", 256)
    monkeypatch.setattr(v, "QUERIES_PER_BLOCK", 10)
    got = {(r.src, r["rank"]): (r.dst, r.score) for r in v.cross_group_topk(rows, rows.where("node_id % 7 = 0"), 4).collect()}
    for q in range(0, 300, 7):
        best = sorted((-data[q] @ data[j], j) for j in range(300) if j % 5 != q % 5)[:4]
        assert [got[q, i + 1] for i in range(4)] == [(j, -score) for score, j in best]


def test_chapter_numbers(spark):
    titles = {"第 十 二 章": None, "第十二章 流": 12, "第一百零三章": 103, "第二十章": 20, "第百章": 100, "第$ 7 $章": 7, "chapter x 9 of 10": 9, "Chapter one": None, "第章": None, "": None}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r.t: r.n for r in df.select("t", s.chapter_number(F.col("t")).alias("n")).collect()} == titles


def test_markdown_files(spark, tmp_path):
    def found(*names):
        for name in names:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text("# " + name)
        return {(r.path.split(str(tmp_path) + "/")[1], r.text) for r in s.markdown_files(spark, str(tmp_path)).collect()}

    def named(*names):
        return {(n, "# " + n) for n in names}

    assert found("a/full.md", "a/README.md", "node_modules/x.md", "b/c/D.MD", "b/e.txt", "root.md") == named("a/full.md", "b/c/D.MD", "root.md")
    assert found("docs/y.md") == named("a/full.md", "b/c/D.MD")  # a project's root
    assert found("b/c/images/1.png") == named("b/c/D.MD")  # papers have images


def test_single_purpose(spark):
    rows = [(["Theory", "Nope", "Survey"], ["0.2", "0.9", "x"]), (["Theory", "Survey"], ["0.9"]), ([], []), (["Nope"], ["1"]), (None, None), (["Theory", "Survey", "DataTool", "MethodUse"], ["-1", "9", "0.5", "0.5"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<string>, s array<string>")
    got = [[(p.label, p.score) for p in r.p] for r in df.orderBy("i").select(c.single_purpose(F.col("l"), F.col("s")).alias("p")).collect()]
    none = [("Background", 0.4)]
    assert got == [[("Survey", 0.4), ("Theory", 0.2)], [("Theory", 0.4), ("Survey", 0.4)], none, none, none, [("Survey", 1.0), ("DataTool", 0.5), ("MethodUse", 0.5)]]


def test_settings_and_schemas(spark):
    layers = spark.createDataFrame([("p", 0, "n", "7"), ("p", 1, "n", "nan"), ("p", 2, "n", None), ("p", 1, "x", "9"), ("q", 0, "n", "1e9"), ("r", 0, "other", "1")], "by string, layer int, key string, value string")
    got = {r.by: (r.n, r.x) for r in x.layered_settings(layers, "by", {"n": (4, 1, 64), "x": (0.5, 0, 1)}).collect()}
    assert got == {"p": (7.0, 1.0), "q": (64.0, 0.5), "r": (4.0, 0.5)}
    good = {"claims_per_paper_min": 1, "claims_per_paper_max": 2}
    rows = [(1, "review", ["a"], ["b"], good), (2, None, [], None, None), (3, "review", ["a", "a"], ["1"], good | {"targets_per_claim_max": 6, "machine_evidence_min": 3, "machine_evidence_max": 2}), (4, "review", ["a-1"], ["b" * 48], good | {"phase1_claim_worker_count": 0}), (5, "review", ["b" * 49], ["b"], good | {"phase1_claim_batch_size": 0})]
    df = spark.createDataFrame(rows, "schema_id int, paper_type string, steps array<string>, claim_kinds array<string>, rules map<string,int>")
    faults = {r.schema_id: r.faults for r in x.schema_faults(df).collect()}
    assert faults == {1: [], 2: ["paper_type", "steps", "claim_kinds", "claims_per_paper"], 3: ["steps", "claim_kinds", "machine_evidence", "targets_per_claim_max"], 4: [], 5: ["steps", "phase1_claim_batch_size"]}


def test_groups_of_a_split_are_a_partition(spark):
    edges = spark.createDataFrame([("p", i) for i in range(7)] + [("q", 1)], "pattern string, edge long")
    groups = spark.createDataFrame([("p", 0, 0), ("p", 0, 1), ("p", 0, 2), ("p", 1, 2), ("p", 1, 3), ("p", 1, 99)], "pattern string, grp int, edge long")
    got = {(r.pattern, r.edge): (r.grp, r.fires) for r in x.split_groups(edges, groups).collect()}
    assert got == {**{("p", i): (g_, True) for i, g_ in enumerate([0, 0, 0, 1, 2, 2, 2])}, ("q", 1): (0, False)}


def test_recheck_and_quotes(spark):
    atoms = spark.createDataFrame([(1, 1, ["red cat"], False, 0.2), (2, 1, ["dog"], False, 0.9), (3, 1, ["red"], True, 0.3), (4, 1, ["red"], True, 0.9)], "id long, doc long, values array<string>, grounded boolean, confidence double")
    verdicts = spark.createDataFrame([(1, "confirmed", "a  red cat"), (2, "confirmed", "a red"), (3, "unsupported", ""), (4, "confirmed", "nowhere")], "id long, verdict string, span string")
    texts = spark.createDataFrame([(1, "There is a red\ncat here.")], "doc long, text string")
    got = {r.id: (r.grounded, r.confidence, r.unsupported) for r in x.recheck(atoms, verdicts, texts, "id", "doc").collect()}
    assert got == {1: (True, 0.6, False), 2: (False, 0.9, False), 3: (True, 0.3, True), 4: (True, 0.9, False)}
