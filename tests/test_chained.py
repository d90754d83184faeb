"""Extraction level by level against one section at a time, and the inverted index against counting."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import chained, lexical_index

SECTIONS = "paper_id string, node string, role string, text string"
DEPS = "paper_id string, node string, dep string, pos long"


def model(rows):
    """Atoms as the text lists them; the summary repeats what the call was given."""
    out = []
    for r in rows.itertuples():
        if r.text == "fails":
            raise OSError("model")
        summary = f"{r.node}<{r.context.replace(chr(10), '|')}>{r.schema}"
        out.append((r.paper_id, r.node, r.text, summary))
    return pd.DataFrame(out, columns=["paper_id", "node", "atoms", "summary"])


def entity(kind, span="seen"):
    return {"layer": "L1", "entity_type": kind, "evidence_span": span}


def test_contexts_schema_and_gaps(spark):
    a = json.dumps([entity("new"), entity("OLD"), {"layer": "L3", "type": "CONTRIBUTION", "subtypes": ["Model", "Extra"], "evidence_span": "e"}])
    b = json.dumps([entity("new"), entity("blank", " "), {"layer": "L3", "type": "CONTRIBUTION_RELATION", "relation": "Refutes", "evidence_span": "r"}])
    rows = [("p", "s1", "definition", a), ("p", "s2", "observation", b), ("p", "s3", "claim", json.dumps([entity("blank")])), ("p", "s4", "odd", "  "), ("q", "s1", "claim", "[]"), ("q", "s2", "claim", "fails")]
    deps = [("p", "s2", "s1", 0), ("p", "s3", "s2", 0), ("p", "s3", "s1", 1), ("p", "s4", "s3", 0), ("q", "s2", "s1", 0)]
    base = spark.createDataFrame([("entity_type", "OLD"), ("contribution_subtype", "model")], "kind string, value string")
    run = chained.extract_chained(spark.createDataFrame(rows, SECTIONS), spark.createDataFrame(deps, DEPS), base, model, batch=1)
    calls = {(c.paper_id, c.node): (c.level, c.context, c.schema) for c in run.calls.collect()}
    plain = "contribution_subtype: model\nentity_type: OLD"
    grown = "contribution_subtype: extra, model\nentity_type: NEW, OLD"
    assert calls[("p", "s1")] == (0, "", plain) and calls[("q", "s1")] == (0, "", plain) and calls[("q", "s2")][2] == plain
    assert calls[("p", "s2")][::2] == (1, grown) and calls[("p", "s3")][2] == grown + "\nrelation_type: refutes"
    summaries = {(s.paper_id, s.node): s.summary for s in run.summaries.collect()}
    assert calls[("p", "s3")][1] == f"Predecessor extracts:\n[s2] {summaries[('p', 's2')]}\n[s1] {summaries[('p', 's1')]}"
    assert ("p", "s4") not in calls and summaries[("p", "s4")] == summaries[("q", "s2")] == ""
    gaps = {(g.node, g.gap_type, g.value): (g.cross_node, g.score) for g in run.gaps.collect()}
    assert gaps == {
        ("s1", "entity_type", "NEW"): (1, 1.5), ("s1", "contribution_subtype", "extra"): (1, 1.5), ("s2", "entity_type", "BLANK"): (1, 0.7), ("s2", "relation_type", "refutes"): (1, 0.7),
        ("s3", "entity_type", "BLANK"): (2, 2.4),
    }
    assert sorted((x.kind, x.value, x.level) for x in run.extensions.collect()) == [
        ("contribution_subtype", "extra", 0), ("entity_type", "BLANK", 2), ("entity_type", "NEW", 0), ("relation_type", "refutes", 1),
    ]


def test_confirmation_corrects_and_rejects(spark):
    text = json.dumps([entity("A"), entity("B")])
    base = spark.createDataFrame([("entity_type", "OLD")], "kind string, value string")
    rows, deps = spark.createDataFrame([("p", "s1", "claim", text)], SECTIONS), spark.createDataFrame([], DEPS)

    def confirm(gaps):
        return gaps[gaps["value"] == "A"].assign(gap_type="relation_type")

    run = chained.extract_chained(rows, deps, base, model, confirm)
    assert [(x.kind, x.value) for x in run.extensions.collect()] == [("relation_type", "A")]
    still = chained.extract_chained(rows, deps, base, model, evolve=False)
    assert still.extensions.count() == still.gaps.count() == 0 and still.atoms.count() == 2
    assert chained.extract_chained(rows.limit(0), deps, base, model).calls.count() == 0


def brute_scores(units, chunks, spark):
    tokens = {r.unit_id: r.t for r in spark.createDataFrame(units, "unit_id string, by string, query string").select("unit_id", tx.tokens(F.col("query")).alias("t")).collect()}
    out = {}
    for u, by, query in units:
        asked = tokens[u] or [(query or "").lower().strip(" ")]
        for c, of, _, text in chunks:
            counts = [(text or "").lower().count(t) for t in asked if t]
            score = sum(1 + 0.3 * min(5, n) for n in counts if n)
            if of == by and score:
                out[(u, c)] = round(score, 6)
    return out


def test_inverted_index_counts_tokens_inside_words(spark):
    r = random.Random(1)
    words = ["art", "start", "cart", "arts", "aa", "aaaa", "a", "42", "1425", "流体", "计算流体力学", "x-art", "éart", "the", "banana", "ana"]
    chunks = [(f"c{i}", r.choice("pq"), i, " ".join(r.choices(words, k=r.randrange(12))) if i else None) for i in range(40)]
    units = [(f"u{i}", r.choice("pqz"), " ".join(r.choices(words, k=r.randrange(1, 5)))) for i in range(25)] + [("stop", "p", "the"), ("none", "p", "  "), ("null", "p", None), ("marks", "q", "é")]
    u, c = spark.createDataFrame(units, "unit_id string, by string, query string"), spark.createDataFrame(chunks, "chunk_id string, by string, pos int, text string")
    want = brute_scores(units, chunks, spark)
    assert {(x.unit_id, x.chunk_id): x.score for x in lexical_index.lexical_scores(u, c, "by").collect()} == want
    found = {x.unit_id: (x.chunk_ids, x.weak) for x in lexical_index.lexical_evidence(u, c, "by").collect()}
    for name, by, query in units:
        best = sorted(((-s, int(k[1:]), k) for (n, k), s in want.items() if n == name))[:2]
        assert found[name] == ([k for _, _, k in best], bool((query or "").strip()) and (not best or -best[0][0] < 2.0)), name
    picked = spark.createDataFrame([("u0", ["own1", "own2", "own3"], True), ("u1", [], True)], "unit_id string, chunk_ids array<string>, weak boolean")
    got = {x.unit_id: (x.chunk_ids, x.weak) for x in lexical_index.claim_evidence(u, c, picked, "by").collect()}
    assert got["u0"] == (["own1", "own2"], True) and got["none"] == ([], False) and got["u2"] == (found["u2"][0], bool(found["u2"][0]))
