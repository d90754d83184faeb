"""The vector index against scans one by one, and its fallback."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus_index as ci

ROWS = "id string, kind string, paper_source string, meta string, text string"


def embed(texts):
    """Four numbers from the letters of a text."""
    return [[float(t.count(c)) for c in "abcd"] for t in texts]


def corpus(spark, n=200, seed=1):
    r = random.Random(seed)
    rows = [(f"r{i}", "claim", r.choice(["A", "B", None]), None, "".join(r.choices("abcd", k=r.randrange(1, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, ("blank", "claim", "A", None, "  "), ("null", "claim", "A", None, None)], ROWS), rows


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def brute(rows, question, k, allowed=None):
    q = np.array(embed([question])[0])
    near = sorted((round(float(((np.array(embed([t])[0]) - q) ** 2).sum()), 9), i, s) for i, _, s, _, t in rows)[:k]
    kept = [x for x in near if allowed is None or (x[2] or "") in allowed]
    return [(i, d) for d, i, s in sorted(kept, key=lambda x: (-x[0], x[2] or "", x[1]))]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_vector_search_is_exact(spark, tmp_path, k):
    df, rows = corpus(spark)
    counts = ci.build_index({"claims": df}, embed, str(tmp_path / "i")).collect()
    assert [tuple(c) for c in counts] == [("claims", 200, 200)]
    questions = ["aabb", "dddd", "", "abcdabcdabcd"]
    for allowed in (None, ["A"]):
        got = {}
        for x in ci.search_corpus(asked(spark, *questions), str(tmp_path / "i"), "claims", df, k, embed, allowed).orderBy("qid", "rank").collect():
            got.setdefault(x.qid, []).append((x.id, x.score))
            assert x.mode == "vector"
        assert got == {i: b for i, q in enumerate(questions) if (b := brute(rows, q, k, allowed))}


def test_cells_hold_all_that_can_be_near():
    r = np.random.default_rng(3)
    data, centroids = r.normal(size=(2000, 3)), r.normal(size=(40, 3))
    cell, far = ci._nearest(data, centroids)
    radius, n = np.array([far[cell == c].max(initial=0) for c in range(40)]), np.bincount(cell, minlength=40)
    questions = r.normal(size=(20, 3))
    needed = ci.cells_needed(questions, centroids, radius, n, 5)
    for q, some in zip(questions, needed, strict=True):
        best = np.argsort(((data - q) ** 2).sum(1))[:5]
        assert some[cell[best]].all()
    assert needed.mean() < 0.9


def test_long_texts_are_segments_and_a_rebuild_clears(spark, tmp_path):
    df = spark.createDataFrame([("long", "chunk", "A", None, "word " * 4000), ("short", "chunk", "A", None, "abc")], ROWS)
    folder = str(tmp_path / "i")
    assert [tuple(c) for c in ci.build_index({"old": df, "empty": df.limit(0)}, embed, folder).collect()] == [("old", 2, 5)]
    ci.build_index({"new": df.where("id = 'short'")}, embed, folder)
    with pytest.raises(ci.IndexMissing):
        ci.search_index(asked(spark, "a"), folder, "old", 3, embed)
    # of the segments of one row the best stays
    ci.build_index({"old": df}, embed, folder)
    assert ci.search_corpus(asked(spark, "d" * 900), folder, "old", df, 5, embed).count() == 2


def test_fallback_without_an_index_or_an_embedder(spark, tmp_path):
    rows = spark.createDataFrame(
        [("b1", "community", "", None, "Blank source textbook community."), ("o", "community", "paper-B", None, "Other finite paper"), ("y", "community", "paper-A", None, "Allowed finite element paper"), ("x", "community", "paper-A", None, "none")],
        ROWS,
    )
    got = ci.search_corpus(asked(spark, "finite element method method"), str(tmp_path / "none"), "communities", rows, 4, embed, ["paper-A"]).orderBy("rank").collect()
    assert [(x.id, x.score, x.mode) for x in got] == [("y", round(2 / 3, 9), "lexical"), ("x", 0.0, "lexical")]
    ci.build_index({"communities": rows}, embed, str(tmp_path / "i"))

    def broken(texts):
        raise OSError("no network")

    got = ci.search_corpus(asked(spark, "method method finite"), str(tmp_path / "i"), "communities", rows, 2, broken, attempts=2, delay=0.0).orderBy("rank").collect()
    assert [(x.id, x.score, x.mode) for x in got] == [("y", 0.5, "lexical"), ("o", 0.5, "lexical")]


def test_embedder_is_called_again(spark):
    calls = []

    def shaky(texts):
        calls.append(len(texts))
        if len(calls) in (1, 2):
            raise OSError("busy")
        return embed(texts)

    assert len(ci.call_embedder(shaky, ["a"] * 100, delay=0.0)) == 100 and calls == [64, 64, 64, 36]
    with pytest.raises(RuntimeError, match="2 times"):
        ci.call_embedder(lambda t: 1 / 0, ["a"], attempts=2, delay=0.0)
    with pytest.raises(RuntimeError, match="vectors"):
        ci.call_embedder(lambda t: [], ["a"])


def test_questions_in_rounds(spark, tmp_path, monkeypatch):
    df, rows = corpus(spark, 60)
    ci.build_index({"claims": df}, embed, str(tmp_path / "i"))
    monkeypatch.setattr(ci, "QUESTIONS", 3)
    questions = ["a" * i for i in range(10)]
    got = ci.search_corpus(asked(spark, *questions), str(tmp_path / "i"), "claims", df, 2, embed).groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert {x.qid: x.ids for x in got.collect()} == {i: sorted(b for b, _ in brute(rows, q, 2)) for i, q in enumerate(questions)}
