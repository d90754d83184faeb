"""Slots of workers and payloads by schema, on rows written by hand."""

import json

from pyspark.sql import functions as F

from quillspark.operators import evidence, routing
from quillspark.sources import payloads

SCHEMA = "k long, answer string"


def answers(rows):
    return rows[["k"]].assign(answer=rows["k"].astype(str))


def refuses_odd(rows):
    if (rows["k"] % 2).any():
        raise OSError("odd")
    return answers(rows)


def test_slots_level_by_level():
    w = [routing.Worker("a", answers, 2), routing.Worker("b", answers, 0), routing.Worker("off", answers, 4, False), routing.Worker("c", answers, 99), routing.Worker(" ", answers)]
    slots = routing.worker_slots(w)
    assert slots[:6] == ["a", "b", "c", "a", "c", "c"] and len(slots) == 2 + 1 + routing.MOST_SLOTS


def test_failed_rows_go_to_other_workers_until_none_is_left(spark):
    rows = spark.range(40).select(F.col("id").alias("k"))
    half = [routing.Worker("x", refuses_odd, 2), routing.Worker("y", refuses_odd)]
    got, left = routing.routed_calls(rows, "k", half, SCHEMA, 1)
    assert sorted(r.k for r in got.collect()) == list(range(0, 40, 2)) and sorted(r.k for r in left.collect()) == list(range(1, 40, 2))
    got, left = routing.routed_calls(rows, "k", [*half, routing.Worker("z", answers)], SCHEMA, 4)
    found = got.collect()
    assert sorted(r.k for r in found) == list(range(40)) and left.count() == 0 and {r.worker for r in found if r.k % 2} <= {"x", "y", "z"}
    assert max(r.attempt for r in found) <= 3 and all(r.answer == str(r.k) for r in found)
    none, left = routing.routed_calls(rows, "k", [], SCHEMA)
    assert none.count() == 0 and left.count() == 40


def test_payloads(spark):
    rel = {"layer": "L3", "type": "CONTRIBUTION_RELATION", "from": "c1", "relation": "supports", "to": "t"}
    lines = [
        json.dumps({"paper_id": "p", "atoms": [rel, "text", 7, None, rel | {"from": ""}, rel | {"layer": "L2"}, rel | {"relation": "extends", "qualifier": "q"}, rel | {"from": "c2"}]}),
        '{"paper_id": "p", "atoms": [', "", None, '{"atoms": []}', '{"paper_id": "p", "atoms": "none"}', "[1]",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert {r.line_no: r.fault for r in payloads.atom_lines(df).collect()} == {0: None, 1: "malformed", 2: "blank", 3: "blank", 4: "missing paper_id", 5: "malformed", 6: "malformed"}
    got = {r.claim: [tuple(x) for x in r.relations] for r in payloads.claim_relations(df).collect()}
    assert got == {"c1": [("supports", "t", None), ("extends", "t", "q")], "c2": [("supports", "t", None)]}


def test_permutation_and_sample_by_their_definition(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 3 if i % 4 else 5) for i in range(200)], "id long, label int, predicted int")
    got = evidence.permuted_accuracy(rows, 7).first()
    assert got.accuracy == 150 / 200
    order = [r.id for r in rows.orderBy(F.xxhash64("id", F.lit(7)), "id").collect()]
    held = {r.id: r for r in rows.collect()}
    right = sum(held[a].label == held[b].predicted for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert abs(got.permuted - right / 200) < 1e-12


def test_batch_ingest(spark):
    from quillspark.operators import ingest

    docs = spark.createDataFrame([(1, "a\n \nlong line"), (2, "a\n \nlong line"), (3, "fails"), (4, " \n"), (5, None), (6, "b")], "paper_id long, text string")
    chunks = spark.createDataFrame([(1, "1:9", 9, "old"), (3, "3:9", 9, "old"), (7, "7:0", 0, "kept")], "paper_id long, chunk_id string, pos int, text string")
    claims = spark.createDataFrame([(1, "1:9", "old", 0.1), (3, "3:9", "old", 0.1), (7, "7:0", "kept", 0.1)], ingest.CLAIM)

    def model(rows):
        if rows["text"].iloc[0] == "fails":
            raise OSError("down")
        assert rows["pos"].is_monotonic_increasing
        return rows[rows["text"].str.contains("long")].assign(confidence=0.7)

    out = ingest.ingest_documents(docs, chunks, claims, model)
    assert {r.paper_id: (r.status, r.error, r.n_chunks, r.n_claims) for r in out.report.collect()} == {
        1: ("ingested", None, 2, 1), 2: ("duplicate", None, 0, 0), 3: ("failed", "down", 1, 0), 4: ("empty", None, 0, 0), 5: ("empty", None, 0, 0), 6: ("ingested", None, 1, 0),
    }
    assert sorted(r.chunk_id for r in out.chunks.collect()) == ["1:0", "1:2", "3:0", "6:0", "7:0"]
    assert sorted((r.paper_id, r.text) for r in out.claims.collect()) == [(1, "long line"), (3, "old"), (7, "kept")]
