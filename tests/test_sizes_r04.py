"""Cases behind the findings of the fourth review."""

import random
import re

import numpy as np
from pyspark.sql import functions as F


def test_f1_documents_are_scored_many_at_once(spark, monkeypatch):
    from quillspark import registry
    from quillspark.functions import text as tx
    from quillspark.operators import lexical_index

    r = random.Random(5)
    words = ["aa", "a", "aaaa", "b", "banana", "ana", "nan", "12", "2121", "the", "漢字", "é", "x"]
    texts = {d: ["".join(r.choice(words) + r.choice(["", " ", "-"]) for _ in range(r.randrange(12))) for _ in range(r.randrange(9))] for d in range(40)}
    asked = {d: [" ".join(r.choices([*words, "zz"], k=r.randrange(5))) for _ in range(4)] for d in range(40)}
    # a unit has one name in all documents
    units = spark.createDataFrame([(d, f"u{i}", q) for d, own in asked.items() for i, q in enumerate(own)], "by long, unit_id string, query string")
    chunks = spark.createDataFrame([(d, 100 * d + i, i, t) for d, own in texts.items() for i, t in enumerate(own)], "by long, chunk_id long, pos int, text string")
    tokens = {q: t for q, t in units.select("query", tx.tokens(F.col("query"))).collect()}

    def tenths(q, text):
        n = [text.count(t) for t in tokens[q]] if tokens[q] else [text.count(q.strip())] if q.strip() else []
        return sum(10 + 3 * min(5, x) for x in n if x)

    want = []
    for d, own in asked.items():
        for i, q in enumerate(own):
            hits = sorted((-tenths(q, t), c) for c, t in enumerate(texts[d]) if tenths(q, t))[:2]
            want.append((f"u{i}", [100 * d + c for _, c in hits], -hits[0][0] / 10 if hits else None))
    key = lambda x: (x[0], x[1], x[2] or 0)
    for batch in (200_000, 60):
        monkeypatch.setattr(lexical_index, "BATCH", batch)
        got = [(x.unit_id, x.chunk_ids, x.score) for x in lexical_index.lexical_evidence(units, chunks, "by").collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    held = [d for d in texts if texts[d]]
    for entries in (1_000_000, 7):
        monkeypatch.setattr(lexical_index, "ENTRIES", entries)
        own = [[{"tokens": tokens[q], "whole": q.strip()} for q in asked[d]] for d in held]
        found = [x for _, _, part in lexical_index._scores(own, [texts[d] for d in held]) for x in part.tolist()]
        assert found == [tenths(q, t) for d in held for q in asked[d] for t in texts[d]]
    # words of one document are not found in another one's, whatever their hash
    lists = [["aa", "b"], ["a", "b"]]
    runs, tokens_of = (lexical_index._numbered(x, [0, 1])[0] for x in (lists, lists[::-1]))
    assert sorted(zip(*map(np.ndarray.tolist, lexical_index._places(runs, tokens_of)))) == [(0, 0), (0, 0), (1, 1), (3, 3)]
    # claims with a model's pick ask nothing
    plan = registry.QUERIES["claim_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN NOT \(\(?pos#\d+ % 3\)? = 0\)", plan)



def test_f4_f6_sets_of_a_large_group_are_sent_a_few_times(spark, monkeypatch):
    import itertools

    from quillspark.operators import aggregates, relational
    from tests.test_findings_r03 import shuffled

    r = random.Random(9)
    rows = [(i, "g", sorted({f"w{r.randrange(150)}" for _ in range(6)}) + ["all"] * (i % 9 == 0), r.choice([-1, 1])) for i in range(600)]
    claims = spark.createDataFrame(rows, "claim_id long, grp string, tokens array<string>, p int").repartition(4)
    want = {(a, b): len({*s} & {*t}) for (a, _, s, _), (b, _, t, _) in itertools.combinations(rows, 2) if len({*s} & {*t}) >= 2}
    sign = {i: p for i, _, _, p in rows}
    monkeypatch.setattr(relational, "BLOCK", 16)
    pairs = lambda: relational.pairs_in_group(claims, ["grp"], 2, F.col("tokens"))
    assert {(x.a, x.b): x.shared for x in pairs().collect()} == want
    stats = aggregates.token_conflicts(claims, ["grp"], 2, F.col("tokens"), F.col("p")).first()
    assert (stats.comparable, stats.conflicts) == (len(want), sum(sign[a] != sign[b] for a, b in want))
    # each set went to all of 38 blocks before
    assert shuffled(spark, lambda: aggregates.token_conflicts(claims, ["grp"], 2, F.col("tokens"), F.col("p"))) < 600 * 10
    monkeypatch.setattr(relational, "MOST_SETS", 100)
    assert {(x.a, x.b): x.shared for x in pairs().collect()} == want
    # all words of two frames at once, few, or one row after the other: the same sets meet
    frame = claims.toPandas().sample(frac=1, random_state=1).assign(lo=0, hi=0, block=0)
    frame["words"] = [np.array(sorted(hash(t) for t in x)) for x in frame["tokens"]]
    names = frame["claim_id"].to_numpy()
    for common in (10_000_000, 500, 1):
        monkeypatch.setattr(relational, "COMMON", common)
        got = {(min(names[x], names[y]), max(names[x], names[y])): n for i, j, m in relational._meetings(frame, 2) for x, y, n in zip(i, j, m)}
        assert got == want


def test_f2_finished_communities_are_not_looked_at_again(spark, monkeypatch):
    from quillspark.operators import graph

    levels, keep = [], graph._moved
    monkeypatch.setattr(graph, "_moved", lambda both, *args: levels.append(both.collect()) or keep(both, *args))
    star = [("hub", f"leaf{i}", 1.0) for i in range(20)]
    ring = [(f"r{i}", f"r{(i + 1) % 64}", 1.0) for i in range(64)]
    edges = spark.createDataFrame([("g", *e) for e in star + ring], "g string, source string, target string, weight double")
    rows = graph.community_tree(edges, "g").collect()
    at = {(r.node, r.level): r.community for r in rows}
    last = max(level for _, level in at)
    assert len(at) == len(rows) == 85 * (last + 1) and last >= 1
    for level in range(last):
        # a community is inside of one of the next level
        assert len({(at[(n, level)], at[(n, level + 1)]) for n, _ in at}) == len({at[(n, level)] for n, _ in at})
    assert len({at[(f"leaf{i}", last)] for i in range(20)} | {at[("hub", last)]}) == 1
    assert len(levels) > 1 and all({r.u for r in own if r.u != r.v} == {r.u for r in own} for own in levels)


def test_f3_steps_are_sent_to_a_few_blocks(spark, monkeypatch):
    from quillspark.operators import relational
    from tests.test_findings_r03 import shuffled

    r = random.Random(4)
    own = {f"s{s}": {e: r.choice([None, r.random()]) for e in r.sample(range(300), 3)} for s in range(400)}
    rows = [(e, s, int(s[1:]) % 3, x) for s, held in own.items() for e, x in held.items()]
    want = {}
    for a in own:
        for b in own:
            both = own[a].keys() & own[b].keys()
            if a < b and int(a[1:]) % 3 != int(b[1:]) % 3 and both:
                sums = [own[a][e] + own[b][e] for e in both if own[a][e] is not None and own[b][e] is not None]
                want[(a, b)] = round(sum(sums) / len(sums) / 2 + 0.05 * len(both), 6) if sums else None
    explains = spark.createDataFrame(rows, "entity_id long, step_id string, paper_id int, score double").repartition(4)
    monkeypatch.setattr(relational, "STEP_BLOCK", 16)
    got = relational.shared_entity_edges(explains).collect()
    assert len(got) == len(want) and {(x.a, x.b): x.score if x.score is None else round(x.score, 6) for x in got} == want
    # each step went to all of 25 blocks before
    assert shuffled(spark, lambda: relational.shared_entity_edges(explains)) < 400 * 8 + 3 * 1200
    monkeypatch.setattr(relational, "MOST_ENTRIES", 100)
    assert {(x.a, x.b) for x in relational.shared_entity_edges(explains).collect()} == set(want)


def test_f5_texts_of_an_index_are_shuffled_once(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from quillspark.operators import corpus_index
    from tests.test_findings_r03 import shuffled

    rows = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("k").alias("kind"), F.lit("s").alias("paper_source"), F.lit(None).cast("string").alias("meta"), F.concat(F.repeat(F.lit("ab"), (F.col("id") % 41).cast("int")), F.lit(" x"), "id").alias("text"))
    counts = []

    def build():
        counts.append(corpus_index.build_index({"c": rows}, lambda texts: [[float(t.count("a")), float(len(t))] for t in texts], str(tmp_path)))
        return spark.range(1)

    moved = shuffled(spark, build)
    assert [tuple(c) for c in counts[0].collect()] == [("c", 3000, 3000)]
    # the texts once; before, once to be embedded and once more by their cells
    assert moved < 3000 * 1.5
    files = [pq.read_table(f, partitioning=None) for f in glob.glob(f"{tmp_path}/vectors/corpus=c/*.parquet")]
    assert sum(f.num_rows for f in files) == 3000 and all(f["cell"].to_pylist() == sorted(f["cell"].to_pylist()) for f in files)
    cells = spark.read.parquet(f"{tmp_path}/cells").collect()
    assert len(cells) > 20 and sum(c.n for c in cells) == 3000
    far = {}
    for f in files:
        for c, x in zip(f["cell"].to_pylist(), f["far"].to_pylist()):
            far[c] = max(far.get(c, 0), x)
    assert {c.cell: c.radius for c in cells} == far
