"""Cases behind the findings of the third review that project a run to larger tables."""

import re

from pyspark.sql import functions as F

from quillspark.operators import graph, hypergraph, routing


def plans_of(monkeypatch, module, names=("materialize", "stored")):
    """The optimized plans that the functions of a module cut off, as they come."""
    plans = []
    for name in names:
        keep = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, keep=keep: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    return plans


def test_f10_edges_are_sent_twice_in_a_round_of_moves(spark, monkeypatch):
    plans = plans_of(monkeypatch, graph)
    edges = spark.range(60).select(F.lit(0).alias("g"), F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), (F.col("id") * 7 + 1) % 60).alias("target"), F.lit(1.0).alias("weight"))
    tree = graph.community_tree(edges, "g").collect()
    assert {r.node for r in tree if r.level == 0} == {f"n{i}" for i in range(60)} == {r.node for r in tree} and {r.community for r in tree} <= {r.node for r in tree}
    rounds = [p for p in plans if "shiftright(turns" in p and "moved" in p]
    # only edges of the nodes whose turn it is, dealt anew by the node alone
    assert rounds and all("RepartitionByExpression [g" in p for p in rounds)


def test_f12_patterns_need_one_aggregation(spark):
    rows = [(1, "s"), (1, "t"), (2, "s"), (2, "s"), (2, "t"), (3, "s"), (4, "s"), (4, "x"), (5, None), (6, "s"), (6, None), (None, "s"), (7, "t"), (7, "t"), (7, "s")]
    inc = spark.createDataFrame(rows, "eid int, role string")
    slots = spark.createDataFrame([("fan", 2, "s", True), ("fan", 2, "t", True), ("pair", 1, "s", False), ("pair", 1, "t", False), ("one", 3, "s", False)], "pattern string, ord int, role string, repeatable boolean")
    found = hypergraph.match_patterns(inc, slots)
    assert {r.eid: r.pattern for r in found.collect()} == {1: "pair", 2: "fan", 3: "one", 7: "fan"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_f20_pairs_of_signature_and_node_are_the_state(spark, tmp_path):
    from quillspark.streaming import recurrence

    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "y")], "signature string, node string")
    for i in range(2):
        rows.write.parquet(str(tmp_path / f"in/{i}"))
        recurrence.start_recurrence(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/*")), str(tmp_path / "q")).awaitTermination()
    assert {(r.signature, r.nodes, r.n) for r in recurrence.recurrence_table(spark, str(tmp_path / "q")).collect()} == {("a", 2, 6), (None, 1, 2)}
    stream = recurrence.recurrence_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/*")))
    assert "Aggregate" in stream._jdf.queryExecution().analyzed().toString()


def test_f22_answers_of_many_calls_leave_a_task_in_one_frame():
    import pandas as pd

    def answers(rows):
        if rows["k"].iloc[0] % 32 == 0:
            raise OSError("busy")
        return rows[["k"]].assign(answer=rows["k"] * 2)

    frame = pd.DataFrame({"k": range(100), "slot": 0, "worker": ["a"] * 60 + ["b"] * 40})
    out = list(routing.served(iter([frame]), {"a": answers, "b": answers}, 4))
    assert [f["worker"].unique().tolist() for f in out] == [["a"], ["b"]]
    assert [k for f in out for k in f["k"]] == [k for k in range(100) if k // 4 % 8] and all((f["answer"] == 2 * f["k"]).all() for f in out)


def test_f19_f23_edges_are_derived_once(spark, monkeypatch):
    plans = plans_of(monkeypatch, graph)
    edges = spark.range(40).select((F.col("id") % 8).alias("u"), (100 + F.col("id") % 13).alias("v")).distinct()
    reached = graph.k_hop(edges, spark.createDataFrame([(3,)], "node long"), 3)
    got = {(r.node, r.hop) for r in reached.collect()}
    assert len(got) == len({n for n, _ in got}) and min(h for _, h in got) == 1
    graph.label_propagation(edges.withColumn("weight", F.lit(1.0)), 2).collect()
    assert sum("Range (0, 40" in p for p in plans) == 2 and all(p.count("Range (0, 40") <= 1 for p in plans)


def test_f21_f24_f25_tasks_hold_bounded_rows(spark, monkeypatch):
    from quillspark import registry, session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 1000)
    for name, keys in (("pair_communities", {"node_id", "source"}), ("coauthor_pairs", {"a", "l_orderkey"})):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        dealt = re.findall(r"RepartitionByExpression \[(\w+)#.*\], (\d+)", plan)
        assert {k for k, _ in dealt} == keys and all(int(n) >= 6 for _, n in dealt)
    chain = spark.range(1, 200).select(F.col("id").alias("child"), F.floor(F.col("id") / 3).alias("parent"))
    plans = plans_of(monkeypatch, graph)
    closure = {(r.child, r.ancestor): r.depth for r in graph.transitive_closure(chain).collect()}
    want = {}
    for i in range(1, 200):
        up, depth = i, 0
        while up:
            up, depth = up // 3, depth + 1
            want[(i, up)] = depth
    assert closure == want
    # only pairs of the longest known depth are extended
    assert sum("depth" in p and "= 2)" in p for p in plans) and sum("= 4)" in p for p in plans)


def test_f11_labels_come_from_the_fullest_buckets(spark, monkeypatch):
    import random
    from collections import Counter

    from quillspark.operators import aggregates
    from tests.test_findings_r03 import shuffled

    r = random.Random(7)
    rows = [(g, " ".join(r.choice("abcdefghijklmnopqrst") + str(r.randrange(20)) for _ in range(300))) for g in "xyz" for _ in range(10)] + [("x", "one two three " * 9)]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    want = {}
    for g in "xyz":
        n = Counter()
        for h, t in rows:
            w = t.split()
            if h == g:
                n.update(" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
        want[g] = max((c, len(p), p) for p, c in n.items())
    for buckets, full in ((1 << 16, 16), (64, 1), (8, 1)):  # groups without a frequent phrase need every bucket
        monkeypatch.setattr(aggregates, "NGRAM_BUCKETS", buckets)
        monkeypatch.setattr(aggregates, "FULL_BUCKETS", full)
        got = {x.lang: (x.n, len(x.title), x.title) for x in aggregates.ngram_label(texts, "lang", []).collect()}
        assert got == want
    monkeypatch.setattr(aggregates, "NGRAM_BUCKETS", 64)
    often = spark.range(40).select(F.lit("x").alias("lang"), F.concat(F.repeat(F.lit("one two three "), 30), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), F.col("id") * 1000 + i)))).alias("text")).repartition(4)
    # no phrase of one occurrence is a row of a shuffle, but for those of a few buckets
    monkeypatch.setattr(aggregates, "FULL_BUCKETS", 2)
    assert shuffled(spark, lambda: aggregates.ngram_label(often, "lang", [])) < 6000


def test_f27_f28_long_texts_stay_in_the_jvm(spark):
    import random

    from quillspark.functions import kernels

    r = random.Random(11)
    bits = ["a", "b", "é", "漢", "𝄞", " ", " ", "\n", "\n\n", ". ", "? ", "! ", "; ", "</p>", "</tr>", "><", "\xa0", "　", ".", "x" * 9]
    texts = ["", None, " ", "\n" * 50, "x" * 95, " " * 70 + "end", "\xa0" * 60 + "y" + " " * 50] + ["".join(r.choices(bits, k=r.randrange(1, 200))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most, overlap in ((20, 4), (21, 30), (7, 0)):
        found = kernels.segmented(rows, most=most, overlap=overlap)
        got = {}
        for x in found.orderBy("doc_id", "segment_index").collect():
            got.setdefault(x.doc_id, []).append(x.segment)
        for i, t in enumerate(texts):
            if len((t or "").strip("\t\n\x0b\f\r ")) > most:
                assert got.get(i, []) == kernels.segments((t or "").strip("\t\n\x0b\f\r "), most, overlap)
        chunked = kernels.sentence_chunked(rows, most=most)
        got = {}
        for x in chunked.orderBy("doc_id", "chunk_index").collect():
            got.setdefault(x.doc_id, []).append(x.chunk)
        assert all(got.get(i, []) == kernels.sentence_chunks(t or "", most) for i, t in enumerate(texts))
    assert all("Python" not in df._jdf.queryExecution().executedPlan().toString() for df in (found, chunked))


def test_f14_f17_embedding_takes_few_tasks_and_sends_texts_once(spark, tmp_path, monkeypatch):
    import numpy as np

    from quillspark.operators import corpus_index

    assert [corpus_index.embed_tasks(n) for n in (0, 1, 4001, 800_000, 2_000_000, 50_000_000)] == [1, 1, 3, 400, 400, 2500]
    r = np.random.default_rng(3)
    vectors, centroids = r.random((700, 8)), r.random((90, 8))
    cell, far = corpus_index._nearest(vectors, centroids)
    exact = np.sqrt(((vectors[:, None] - centroids[None]) ** 2).sum(2))
    assert np.allclose(far, exact.min(1)) and np.array_equal(far, np.sqrt(((vectors - centroids[cell]) ** 2).sum(1)))
    plans = plans_of(monkeypatch, corpus_index)
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("k").alias("kind"), F.lit("s").alias("paper_source"), F.lit(None).cast("string").alias("meta"), F.concat(F.lit("text "), "id").alias("text"))
    corpus_index.build_index({"c": rows}, lambda texts: [[float(len(t)), float(t[-1])] for t in texts], str(tmp_path))
    assert any("ArrowEvalPython" in p or "assign(text" in p for p in plans) and not any("MapInPandas" in p for p in plans)


def test_f18_no_round_of_extraction_is_broadcast(spark, monkeypatch):
    import random

    import pandas as pd

    from quillspark import registry
    from quillspark.operators import chained

    r = random.Random(5)
    plans = plans_of(monkeypatch, chained, ["materialize"])
    deps = [(p, f"s{i}", f"s{j}", i - j) for p in "pq" for i in range(1, 5) for j in sorted({r.randrange(i), r.randrange(i)})]
    sections = [(p, f"s{i}", "claim", "" if (p, i) == ("p", 2) else "fails" if (p, i) == ("q", 3) else f"K{i % 3}") for p in "pq" for i in range(5)]

    def model(rows):
        if "fails" in set(rows["text"]):
            raise OSError("model")
        atoms = [f'[{{"layer": "L1", "entity_type": "{t}", "evidence_span": "{n}"}}]' for n, t in zip(rows["node"], rows["text"])]
        # the call of the first section speaks for a later one, too
        own = pd.DataFrame({"paper_id": rows["paper_id"], "node": rows["node"], "atoms": atoms, "summary": [f"{n}({c[22:]})" for n, c in zip(rows["node"], rows["context"])]})
        more = own[(rows["node"] == "s0").to_numpy()].assign(node="s3", atoms="[]", summary="early")
        return pd.concat([own, more])

    base = spark.createDataFrame([("entity_type", "K0")], "kind string, value string")
    run = chained.extract_chained(spark.createDataFrame(sections, "paper_id string, node string, role string, text string"), spark.createDataFrame(deps, "paper_id string, node string, dep string, pos long"), base, model, batch=1)
    told, want = {}, {}
    for p, n, _, t in sections:
        before = sorted((pos, f"[{d}] {s}") for q, m, d, pos in deps if (q, m) == (p, n) for s in told[(p, d)])
        context = "Predecessor extracts:\n" + "\n".join(x for _, x in before) if before else ""
        if t:
            want[(p, n)] = context
        told[(p, n)] = [f"{n}({context[22:]})" if t not in ("", "fails") else ""] + ["early"] * (n == "s3")
    assert {(c.paper_id, c.node): c.context for c in run.calls.collect()} == want
    assert {(g.node, g.value) for g in run.gaps.collect()} >= {("s1", "K1")} and {x.value for x in run.extensions.collect()} == {"K1", "K2"}
    query = registry.QUERIES["chained_extraction"](spark, "/root/testdata/sf0.001")
    joins = [line for p in [*plans, query._jdf.queryExecution().optimizedPlan().toString()] for line in p.splitlines() if "Join " in line]
    assert len(joins) > 20 and all("strategy=merge" in j for j in joins)
