"""The pipeline against its stages' plain meaning, on a small fixture."""

import random

import pytest

from tests.llm.test_operators import BYTE, base_spans, brute_scores, near_copies


@pytest.fixture
def corpus(spark, tmp_path):
    r = random.Random(11)
    clean = [". ".join(" ".join(f"{c}{r.randrange(4000)}a" for c in "abcdefgh") for _ in range(6)) for _ in range(60)]
    junk = [" ".join(f"j{r.randrange(900)}###" for _ in range(50)) for _ in range(40)]
    copies = near_copies(4, 8, [0, 1])
    texts = clean + junk + copies + [clean[0], clean[1] + " mail me@here.org now"]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not 60 <= i < 100), 0) for i in range(len(texts)) if i % 10 < 8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), texts


def test_stages(spark, corpus):
    import corpus_pipeline as p

    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = p.keep_quality(spark, docs, path).cache()
    assert good.columns == docs.columns
    kept = {x.doc_id for x in good.select("doc_id").collect()}
    assert set(range(60)) <= kept and not kept & set(range(60, 100))
    once = p.drop_near_copies(spark, good, path).cache()
    assert once.columns == docs.columns
    left = {x.doc_id for x in once.select("doc_id").collect()}
    assert set(range(60)) <= left and len(left & set(range(100, 108))) < 8 and 108 not in left
    clean = {x.doc_id: x for x in p.redact_pii(spark, once, path).collect()}
    assert set(clean) == left
    for i, x in clean.items():
        assert "me@here.org" not in x.text and x.n_chars == len(x.text)
        assert x.text == texts[i] or "[EMAIL]" in x.text
    run = p.run(spark, path).toPandas()
    assert set(run.doc_id) == left and run.groupby("sequence_id").length.sum().max() <= 2048


def test_awkward_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, None, "a"), (None, "x y", "b"), (2, "", "c"), (2, "", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, __score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").drop("__score").withColumnRenamed("text", "text")
    assert p.keep_quality(spark, docs, str(tmp_path)).count() == 4
    assert p.drop_near_copies(spark, docs, str(tmp_path)).count() == 4
    assert p.redact_pii(spark, docs, str(tmp_path)).columns == docs.columns
    assert p.pack(spark, docs, str(tmp_path)).count() == 4


def five(t):
    w = t.lower().split()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline_matches_brute_force(spark, corpus):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    path, texts = corpus
    labels = [(i, int(not 60 <= i < 100)) for i in range(len(texts)) if i % 10 < 8]
    kept = [(i, t) for (i, t), s in zip(enumerate(texts), brute_scores(list(enumerate(texts)), labels), strict=True) if s >= 0.7]
    sets, root = {i: five(t) for i, t in kept}, {i: i for i, _ in kept}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    single = [(i, t) for i, t in kept if find(i) == i]
    assert 60 <= len(single) < len(kept) < len(texts)
    tokenizer, want = Tokenizer.from_file(BYTE), {}
    for i, t in single:
        for kind, a, b in sorted(base_spans(t), key=lambda s: -s[1]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        want[i] = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    got = p.run(spark, path).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()


def test_near_copies_with_equal_or_no_ids(spark, tmp_path):
    import corpus_pipeline as p

    a, b = near_copies(21, 2, [0, 1]), near_copies(22, 2, [0, 1])
    rows = [(5, a[0]), (5, b[0]), (5, a[0]), (6, a[1]), (4, b[1]), (None, a[0]), (7, None), (7, ""), (7, ""), (8, "x y")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, hash int")
    left = p.drop_near_copies(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in left.collect()) == sorted([(0, a[0]), (4, b[1]), (5, a[0]), (7, ""), (7, ""), (7, ""), (8, "x y")])
    none = docs.where("false")
    assert p.drop_near_copies(spark, none, "").count() == 0 and p.redact_pii(spark, none, "").columns == docs.columns
