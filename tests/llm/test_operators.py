"""Each operator against a brute-force version or a defined result, on small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import bpe, knn, lm_score, near_dup, packing, pii, quality, simhash, token_counts, url_filter
from quillspark.llm._encode import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 30000 + "x" * 70000
#: Awkward texts, some of them twice, with columns that clash with names used inside the operators.
TEXTS = [None, "", " ", "a", "a b", "A b", "one two three four five six", "one two three four five six", LONG, "é😀 \n\n tail  ", "don't <|endoftext|> stop"]
CLASH = "doc_id long, text string, n long, key long, salt int, rank int, words string, pii string, h long, stats string, part int, row int"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "w", "p", 5, "s", 6, 7) for i, t in enumerate(texts)], CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)


# 1


def brute_knn(rows, k):
    ok = {i: [math.floor(64 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q)
            out[q] = [(c, -s) for s, c in scored[:k]]
    return out


@pytest.mark.parametrize("case", ["spread", "ties", "few", "hot"])
def test_knn_matches_brute_force(spark, case):
    r = random.Random(3)
    n = 12 if case == "few" else 400
    rows = [(i, [round(r.gauss(0, 1), 1 if case == "ties" else 4) for _ in range(4)]) for i in range(n)]
    if case == "hot":
        rows = [(i, rows[0][1] if i % 3 else v) for i, v in rows]
    rows += [(1000, None), (1020, [1.0, None, 0.0, 0.0]), (1040, [float("nan")] * 4), (1060, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    got = defaultdict(list)
    for x in knn.knn_join(df, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    assert dict(got) == {q: v for q, v in brute_knn(rows, 5).items() if v}


def test_knn_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.knn_join(df, F.col("vec_id") % 20 == 0, 5).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert knn.knn_join(one, F.col("vec_id") % 20 == 0, 5).count() == 0


def test_knn_repeated_ids_and_other_dimensions(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [3.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0]), (3, [0.5, 0.5]), (None, [9.0, 9.0]), (20, [1.0, 2.0, 3.0])]
    got = [tuple(x) for x in knn.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).orderBy("rank").collect()]
    # id 0 asks once, with its least vector; both rows of id 1 answer
    assert got == [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 192), (0, 3, 3, 2 * 64 * 32)]


def test_knn_splits_hold_all_rows():
    begin, parts, n = knn._splits(np.array([5, 0, 100, 7, 3, 4]), [0, 2, 3, 1, 4, 5], 10)
    held = sorted(s for c in (0, 2, 3, 4, 5) for s in range(begin[c], begin[c] + parts[c]))
    assert parts.tolist() == [1, 1, 10, 1, 1, 1] and set(held) == set(range(n)) and n == 13


# 2


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


PII_TEXTS = [
    "a@b.c_x@d.e a@b.c.@e.f  x@y a.b@c@d.ee", "1.2.3.4.5.6.7.8 001.002.003.0004 256.1.1.1 " + "1" * 3000 + ".2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "+1 (864) 555-0138. +49..30 +12345678901234567 ++123456789 ", "account DE89 3704 0044 0532 0130 00 and GB82WEST12345698765433", "é😀 a@b.cd 😀+1 (864) 555-0138",
    "1 " * 5000 + "a." * 6000 + "@x.y " + "a@b.c " * 50, 'token = "2100a60029d9170a161913d4d0199300"', "ssn 123-45-6789, 123-45-6789",
]


def test_pii_base_matches_regex(spark):
    texts = TEXTS + PII_TEXTS
    rows = pii.find_pii(docs(spark, texts), out="found").collect()
    for x in rows:
        got = [(pii.KINDS[s.kind].name, s.start, s.end) for s in x.found if pii.KINDS[s.kind].base]
        assert got == base_spans(x.text or ""), x.doc_id
        assert x.pii == "p"
    kinds = {pii.KINDS[s.kind].name for x in rows for s in x.found}
    assert {"iban", "secret", "ssn"} <= kinds


def test_pii_many_matches(spark):
    text = " ".join(f"u{i}@host{i}.org 10.0.{i % 300}.7" for i in range(20_000))
    found = pii.find_pii(docs(spark, [text])).first().pii
    assert [(pii.KINDS[s.kind].name, s.start, s.end) for s in found] == base_spans(text)


def test_pii_context_and_checksum(spark):
    found = {x.doc_id: [pii.KINDS[s.kind].name for s in x.found] for x in pii.find_pii(docs(spark, PII_TEXTS), out="found").collect()}
    assert found[4] == ["iban"]
    assert found[8] == ["ssn"]  # a context ends at the match before
    assert pii.find_pii(empty(spark)).count() == 0


def test_redact(spark):
    got = {x.doc_id: x.text for x in pii.redact(docs(spark, [None, "", "mail a@b.cd now", "+4111 1111 1111 1111 é", 'token = "2100a60029d9170a161913d4d0199300"'])).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "mail [EMAIL] now"
    assert got[3] == "+[CARD] é"  # sixteen digits are no phone number
    assert got[4] == 'token = "[SECRET]"'


# 3


def test_quality_learns_and_holds_out(spark):
    r = random.Random(1)
    good = lambda: ". ".join(" ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(12)) for _ in range(8))
    bad = lambda: " ".join(r.choice(["x###", "y$$$", "z***"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, LONG)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(5, None, 0), (12345, 1, 0)], "doc_id long, quality int, toxic int")
    stats = quality.add_statistics(df).drop("text")
    model = quality.fit(stats, labels)
    scored = {x.doc_id: x.s for x in df.withColumn("s", model.score_column("text")).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == 303
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(scored[i] >= 0.7) == (i % 3 > 0) for i in held]) > 0.95
    none = quality.fit(stats, labels.where("quality = 1"))
    assert {x.s for x in df.select(none.score_column("text").alias("s")).collect()} == {0.5}


def brute_scores(rows, labels):
    """Scores by one set of normal equations over all rows and the max-min form of isotonic regression."""
    y = {}
    for i, q in labels:
        if q is not None:
            y[i] = max(q, y.get(i, q))
    part = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in rows}
    stats = np.array([quality.statistics(t) for _, t in rows])
    known = [k for k, (i, _) in enumerate(rows) if i in y and part[i] != 2]
    fits, calibrates = [k for k in known if part[rows[k][0]] != 3], [k for k in known if part[rows[k][0]] == 3]
    mean, spread = stats[known].mean(0), stats[known].std(0)
    x = np.clip((stats - mean) / np.where(spread > 1e-9, spread, 1), -6, 6)
    rng = np.random.default_rng(7)
    w, b = rng.normal(0, 1 / quality.WIDTH, (quality.N_STATS, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.hstack([np.cos(x @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones((len(x), 1))])
    target = np.array([y.get(i, 0) for i, _ in rows], float)
    ridge = np.diag([quality.RIDGE * len(fits)] * quality.FEATURES + [1e-9])
    raw = z @ np.linalg.solve(z[fits].T @ z[fits] + ridge, z[fits].T @ target[fits])
    bins = defaultdict(lambda: [0, 0.0])
    for k in calibrates:
        at = bins[int(min(max((raw[k] + 0.5) / 2 * quality.BINS, 0), quality.BINS - 1))]
        at[0], at[1] = at[0] + 1, at[1] + target[k]
    keys = sorted(bins)
    mean_of = lambda a, c: sum(bins[k][1] for k in keys[a : c + 1]) / sum(bins[k][0] for k in keys[a : c + 1])
    level = [max(min(mean_of(a, c) for c in range(i, len(keys))) for a in range(i + 1)) for i in range(len(keys))]
    knots, levels = [], []
    for v in sorted(set(round(v, 9) for v in level)):
        mine = [k for k, u in zip(keys, level, strict=True) if round(u, 9) == v]
        n, t = sum(bins[k][0] for k in mine), sum(bins[k][1] for k in mine)
        knots.append(sum(((k + 0.5) / quality.BINS * 2 - 0.5) * bins[k][0] for k in mine) / n)
        levels.append((t + 0.5) / (n + 1))
    return np.clip(0.999 * np.interp(raw, knots, levels) + 0.001 * np.clip(raw / 3 + 1 / 3, 0, 1), 0, 1)


def test_quality_matches_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "SUMS", 2)  # sums of sums
    r = random.Random(3)
    word = lambda junk: r.choice(["x###", "1234", "y$$"]) if r.random() < junk else r.choice(["alpha", "beta", "of", "the", "Gamma."])
    rows = [(i, " ".join(word(r.choice([0.1, 0.4]) if i % 2 else r.choice([0.3, 0.7])) for _ in range(r.randrange(5, 60)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, LONG), (7, rows[7][1]), (403, "a")]
    labels = [(i, i % 2) for i in range(0, 380)] + [(9, 0), (10, 1), (11, None), (5000, 1), (401, 0)]
    spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, stats string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op3_quality(spark, str(tmp_path)).toPandas().sort_values(["doc_id", "score"])
    want = sorted(zip([i for i, _ in rows], brute_scores(rows, labels), strict=True))
    assert len(got) == len(rows) and np.allclose(got.score, [s for _, s in want], atol=1e-6)
    assert (got.predicted == (got.score >= 0.7)).all() and (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in want]).all()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert quality.op3_quality(spark, f"{tmp_path}/e").count() == 0


def test_isotonic_never_falls():
    knots, levels = quality.isotonic(np.arange(6.0), np.array([5, 5, 5, 5, 5, 5.0]), np.array([0, 3, 1, 4, 2, 5.0]))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()


# 4


def test_packing_places_everything(spark):
    enc = Encoder(BYTE)
    texts = TEXTS + ["the cat " * n for n in (1, 5, 40, 300, 700, 5000)] + ["repeat"] * 30
    rows = packing.pack(packing.pieces(docs(spark, texts), BYTE), per_salt=7).toPandas()
    for i, t in enumerate(texts):
        raw = enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        mine = rows[rows.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(raw) and (mine.start == mine.length.cumsum() - mine.length).all()
        assert len(raw) > 2048 or len(mine) == 1
        assert (mine.length[1:] == 2048).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(raw[p.start : p.start + p.length], "<u4").tobytes())
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()
    assert packing.pack(packing.pieces(empty(spark), BYTE)).count() == 0


def test_plan_is_near_the_bound():
    r = np.random.default_rng(1)
    lengths = np.minimum(2048, (r.lognormal(6, 1, 20000)).astype(int) + 1)
    plan = packing.make_plan(np.bincount(lengths, minlength=2049))
    assert plan.sequences <= -(-lengths.sum() // 2048) * 1.005 + 1


# 5


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return set(zip(w, w[1:], w[2:], w[3:], strict=False)) if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_components(rows, percent=80):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(100)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.choice(edits)):
            w[r.randrange(100)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(5)
    line = " ".join(f"l{i}" for i in range(12))
    texts = TEXTS + near_copies(1, 90, [0, 1, 1, 2, 3, 4, 6]) + near_copies(2, 6, [1, 2]) + [" ".join(f"w{r.randrange(900)}" for _ in range(60)) + " " + line for _ in range(60)]
    texts += [texts[20]] * 5 + ["a b c d"] * 3 + ["A B C D e", "x y z", "X y z"]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert near_dup.near_duplicates(empty(spark), 4, 80).count() == 0


# 6


def test_overlapping_excerpts_match_brute_force(spark):
    """Windows over one text form a chain: every shingle is in a long list, and few pairs of its holders link."""
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words[2 * i : 2 * i + 100]) for i in range(250)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_near_duplicates_with_equal_or_no_ids(spark):
    a, b = near_copies(21, 2, [0, 1]), near_copies(22, 2, [0, 1])
    rows = [(5, a[0]), (5, b[0]), (5, a[0]), (6, a[1]), (4, b[1]), (None, a[0]), (7, None), (7, ""), (8, "x y z w")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    of = {i: {x.component_id for x in got if x.doc_id == i} for i in (4, 5, 6, 7, 8)}
    assert len(got) == 8 and of == {4: {4}, 5: {4, 5}, 6: {5}, 7: {7}, 8: {8}}


@pytest.mark.parametrize("case", ["footer", "chains"])
def test_long_lists_match_brute_force(spark, case):
    base, footer = " ".join(f"b{i}" for i in range(47)), " ".join(f"f{i}" for i in range(11))
    pages = [f"{base} own{i}" for i in range(60)] + [f"{base} {footer}", " ".join(f"o{i}" for i in range(30)) + f" {footer}"]
    texts = pages if case == "footer" else near_copies(3, 160, [1, 2, 3, 4])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_members_their_leader_refuses_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LEADERS", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 20)
    base, footer = " ".join(f"b{i}" for i in range(47)), " ".join(f"f{i}" for i in range(11))
    texts = [f"{base} own{i}" for i in range(60)] + [f"{base} {footer}", " ".join(f"o{i}" for i in range(30)) + f" {footer}"] + near_copies(3, 160, [1, 2, 3, 4])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_bpe_round_trip(spark):
    w = Encoder(WORD).tokenizer
    texts = TEXTS + ["日本語" * 300, "can't 's ''s" * 200, " " * 100 + "x"]
    texts += ["".join(chr(97 + i * i % 26) for i in range(60_000))]  # more pieces than a task joins
    got = bpe.encode_decode(docs(spark, texts), WORD, long=500, piece=171).collect()
    assert len(got) == len(texts)
    for x in got:
        ids = w.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(x.ids, "<u4").tolist() == ids
        assert x.decoded == w.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty(spark), WORD).count() == 0


def test_tree_joins_agree_with_whole_encoding():
    joiner, r = bpe.Joiner(Encoder(WORD)), random.Random(2)
    for _ in range(60):
        t = "".join(r.choice(["a", "B", " ", "'s", "1", "!!", "é", "<|endoftext|>", "́", "中", "can't", "\n"]) for _ in range(400))
        k = r.choice([7, 37, 113])
        assert joiner.tree([joiner.encode(t[i : i + k]) for i in range(0, len(t), k)]).ids.tolist() == joiner.encode(t).ids.tolist()


@pytest.mark.parametrize("kind", ["letters", "few", "special", "marks", "base64"])
def test_unsplit_text_joins_at_tokens(kind):
    """Where no word ends, joins agree on tokens; what they encode again stays small."""
    joiner, r = bpe.Joiner(Encoder(WORD)), random.Random(8)
    symbols = {"letters": [*"abcdefghijklmnopqrstuvwxyz"], "few": [*"aab"], "special": ["<|endoftext|>", "<|", "|>", "t", "'", "ll"],
               "marks": ["가", "\u11a8", "\u1100", "\u1161", "\u0301", "e", "İ", "ﬁ"], "base64": [*"ABCDEFabcdef0123456789+/"]}[kind]
    for _ in range(20):
        t = "".join(r.choice(symbols) for _ in range(900))
        k = r.choice([37, 113, 300])
        assert joiner.tree([joiner.encode(t[i : i + k]) for i in range(0, len(t), k)]).ids.tolist() == joiner.encode(t).ids.tolist()
    if kind in ("letters", "base64"):
        t, joiner.encoded = "".join(r.choice(symbols) for _ in range(1_000_000)), 0
        assert joiner.tree([joiner.encode(t[i : i + 25_000]) for i in range(0, len(t), 25_000)]).ids.tolist() == joiner.encode(t).ids.tolist()
        assert joiner.encoded <= 39 * 1024


@pytest.mark.parametrize("text", [" " * 1_000_001 + "x", "\n" * 1_000_001, "^" * 1_000_001, "a" + "\t" * 1_000_001 + "b"])
def test_long_runs_encode_as_the_library_does(text):
    e = Encoder(BYTE)
    whole = e.tokenizer.encode(text, add_special_tokens=False)
    assert e.ids(text).tolist() == whole.ids
    assert np.array_equal(e.spans(text), np.array(whole.offsets))


def test_byte_encoder_matches_library():
    e, r = Encoder(BYTE), random.Random(4)
    for _ in range(300):
        t = "".join(r.choice(["a", "B", " ", "  ", "\n", "'s", "1", "é", "<|endoftext|>", "中", "\t"]) for _ in range(12))
        assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# 7


def owners(tokenizer, text, rule):
    """Tokens and crossing tokens of each line, one token after the other, from the library's offsets."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] + [len(text)]
    line = lambda i: next((k for k, e in enumerate(ends) if i < e), len(ends) - 1)
    n, crossing = [0] * len(ends), [0] * len(ends)
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        lines = [line(i) for i in range(a, max(b, a + 1))]
        own = {"first": lines[0], "last": lines[-1], "most": max(sorted(set(lines)), key=lines.count)}[rule]
        n[own] += 1
        crossing[own] += lines[0] != lines[-1]
    return n, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_match_offsets(spark, rule):
    enc, r = Encoder(BYTE), random.Random(12)
    texts = ["".join(r.choice(["a", " ", "\n", "\n\n", " \n ", "é", "😀", "word", ".", "{\n", "\n\t"]) for _ in range(r.randrange(60))) for _ in range(80)]
    rows = token_counts.count_tokens(docs(spark, texts), BYTE, rule=rule).toPandas().sort_values(["doc_id", "section"])
    for i, t in enumerate(texts):
        mine = rows[rows.doc_id == i]
        assert (mine.n_tokens.tolist(), mine.n_crossing.tolist()) == owners(enc.tokenizer, t, rule)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up(spark, rule):
    enc = Encoder(BYTE)
    rows = token_counts.count_tokens(docs(spark), BYTE, rule=rule).toPandas()
    for i, t in enumerate(TEXTS):
        mine = rows[rows.doc_id == i].sort_values("section")
        assert mine.n_tokens.sum() == len(enc.ids(t or ""))
        assert len(mine) == (t or "").count("\n") + 1 and mine.end.iloc[-1] == len(t or "")
    assert token_counts.count_tokens(empty(spark), BYTE).count() == 0


def test_allocation_rules():
    spans, cuts = np.array([[0, 2], [2, 7], [7, 9]]), np.array([0, 3, 8])
    assert token_counts.allocate(spans, cuts, "first")[0].tolist() == [2, 1, 0]
    assert token_counts.allocate(spans, cuts, "last")[0].tolist() == [1, 1, 1]
    assert token_counts.allocate(spans, cuts, "most")[0].tolist() == [1, 2, 0]
    assert token_counts.allocate(spans, cuts, "first")[1].tolist() == [1, 1, 0]


def test_token_counts_of_fields(spark):
    df = spark.createDataFrame([(1, "a title", None, "the body\nof it")], "doc_id long, title string, note string, body string")
    rows = token_counts.count_tokens(df, BYTE, fields=("title", "note", "body"), lines=False).collect()
    assert [(x.field, x.section) for x in rows] == [("title", 0), ("note", 0), ("body", 0)]
    assert sum(x.n_tokens for x in rows) == len(Encoder(BYTE).ids("a title\n\nthe body\nof it"))


# 8


def brute_lm(texts, order=2):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in texts]
    count = defaultdict(int)
    for ws in words:
        for k in range(1, order + 1):
            for i in range(k, len(ws) + 1):
                count[tuple(ws[i - k : i])] += 1
    total = sum(map(len, words))

    def s(gram):
        if len(gram) == 1:
            return math.log(count[gram] / total)
        return math.log(count[gram] / count[gram[:-1]]) if count[gram] >= 2 else math.log(0.4) + s(gram[1:])

    return [(len(ws), sum(s(tuple(ws[max(0, i - order) : i])) for i in range(1, len(ws) + 1)) if ws else None) for ws in words]


@pytest.mark.parametrize(("order", "slice_chars"), [(2, 10**9), (2, 300), (3, 300)])
def test_lm_matches_brute_force(spark, order, slice_chars):
    r = random.Random(9)
    texts = TEXTS[:8] + [" ".join(r.choice("abcdefg") for _ in range(r.randrange(40))) for _ in range(60)]
    texts += ["the same text of some words again " * 3] * 40 + ["z" * 200_000 + " z", ""] + [None] * 30
    got = {x.doc_id: (x.n_words, x.log_score) for x in lm_score.score_documents(docs(spark, texts), order=order, slice_chars=slice_chars).collect()}
    for i, (n, s) in enumerate(brute_lm(texts, order)):
        assert got[i][0] == n and (got[i][1] is None if s is None else abs(got[i][1] - s) < 1e-6 * max(1, abs(s)))


def test_lm_rows_with_equal_or_no_id(spark):
    rows = [(1, "a b a b"), (1, "a b"), (None, "b"), (None, ""), (2, None)]
    got = {x.doc_id: x for x in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lm([t for _, t in rows])
    assert len(got) == 3 and got[1].n_words == 6 and got[None].n_words == 1 and got[2].log_score is None
    assert abs(got[1].log_score - want[0][1] - want[1][1]) < 1e-9
    assert lm_score.score_documents(empty(spark)).count() == 0


# 9


def brute_fingerprint(text):
    w = re.split(r"[ \t\n\v\f\r]+", text)
    total, votes = 0, [0] * 128
    for term in [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)] or w:
        weight = max(1, min(15, len(term)))
        low = xxhash.xxh64(term.encode(), seed=42).intdigest()
        high = xxhash.xxh64((1).to_bytes(4, "little"), seed=low).intdigest()
        total += weight
        for j in range(64):
            votes[64 + j] += weight * (low >> j & 1)
            votes[j] += weight * (high >> j & 1)
    return sum(1 << j for j in range(128) if 2 * votes[j] > total)


def test_next_documents_of_sparse_and_repeated_ids(spark, tmp_path):
    ids = [-(2**63), -5, -5, 0, 3, 2**40, 2**62, 2**63 - 1, None]
    rows = [(i, f"text {k} " * (k + 3)) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id, x.edited_sha256) for x in simhash.op9_simhash(spark, str(tmp_path)).collect())
    plain = sorted(x for x in rows if x[0] is not None)
    want = []
    for k, (i, t) in enumerate(plain):
        q = len(t) // 4
        want.append((i, hashlib.sha256((t[: len(t) - q] + plain[(k + 1) % len(plain)][1][:q]).encode()).hexdigest()))
    assert got == sorted(want)


def test_ranges_by_halving(spark):
    cuts = [3, 5, 9, 10, 40]
    got = [x.p for x in spark.range(50).select(simhash._place(F.col("id"), cuts).alias("p")).collect()]
    assert got == [sum(c <= i for c in cuts) for i in range(50)]


def test_fingerprints(spark, tmp_path):
    texts = TEXTS + near_copies(3, 4, [1])
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in simhash.op9_simhash(spark, str(tmp_path)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        q = len(t) // 4
        edited = t[: len(t) - q] + plain[(i + 1) % len(plain)][:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert int(got[i].fingerprint, 16) == brute_fingerprint(t)
        assert int(got[i].edited_fingerprint, 16) == brute_fingerprint(edited)
    assert len({got[i].fingerprint for i, t in enumerate(plain) if t == ""}) == 1
    assert got[6].fingerprint == got[7].fingerprint
    marks = [int(got[i].fingerprint, 16) for i in range(len(plain))]
    for i, m in enumerate(marks):
        assert got[i].n_near == sum(bin(m ^ o).count("1") <= simhash.RADIUS for j, o in enumerate(marks) if j != i)
        assert got[i].near_next == 1 - bin(m ^ marks[(i + 1) % len(marks)]).count("1") / 128
    empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert simhash.op9_simhash(spark, f"{tmp_path}/e").count() == 0


def test_block_tables_find_all_within_radius(spark):
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(6)]
    marks = [b ^ sum(1 << x for x in r.sample(range(128), r.randrange(7))) for b in base for _ in range(12)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(m >> 64), signed(m & (2**64 - 1))) for m in marks], "hi long, lo long")
    for radius in (3, 5, 7):
        got = {(x.hi, x.lo): x.n_near for x in simhash.near_counts(df, radius).collect()}
        for m in set(marks):
            assert got[(signed(m >> 64), signed(m & (2**64 - 1)))] == sum(bin(m ^ o).count("1") <= radius for o in marks) - 1


# 10


def test_url_parts_and_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://Www.Example.NET/en/x?q#f", "https://example.com/de/1", "https://notexample.com/de/1", "https://a.org/fr/", "https://a.org?x=/fr/", "ftp://u.net", "http://x.net/?a://b", "://h#://y"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: x for x in url_filter.judge_urls(df, url_filter.RULES, F.bool_or(F.col("url").contains("q"))).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5].rule == "example.com/de/" and got[6].rule is None and got[7].rule == "org/fr/" and got[8].rule is None
    assert got[9].path == "" and got[9].rule is None and got[10].rule == "net/" and got[11].host == "h"
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(none, url_filter.RULES, F.bool_or(F.lit(True))).count() == 0


def test_cascade_is_exact(spark):
    r = random.Random(7)
    listed = {f"h{i}": r.random() < 0.3 for i in range(3000)}
    df = spark.createDataFrame(list(listed.items()), "key string, listed boolean")
    cascade = url_filter.build_cascade(df)
    assert len(cascade.levels) >= 2
    for x in df.withColumn("held", cascade.holds(F.col("key"))).collect():
        assert x.held == x.listed
    assert url_filter.build_cascade(df, max_bits=64) is None


def test_lists_beyond_the_cascade_answer_alike(spark):
    urls = [f"http://h{i % 40}.org/{'?bad' if i % 7 == 0 and i % 3 else ''}" for i in range(200)] + ["bad", None, "http://h1.org/", "http://h1.org/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, __key string").drop("__key")
    listed = F.bool_or(F.col("url").contains("bad"))
    small, large = (sorted(url_filter.judge_urls(df, url_filter.RULES, listed, max_bits=m).collect(), key=lambda x: x.page_id) for m in (1 << 28, 64))
    assert small == large and len(small) == 204
    assert [x.verdict for x in small[200:202]] == ["allow", "allow"]  # no host, so not listed
    bad = {u.split("/")[2] for u in urls if u and "bad" in u and "://" in u}
    assert all((x.verdict == "block") == (x.host in bad) for x in small)
