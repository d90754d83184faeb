"""Importance resampling, spelling variants and page extraction against brute force, on small and awkward tables."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_extract, importance, spelling
from tests.llm.test_operators import CLASH, docs, empty

# 11


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(rows, target):
    found = {i: brute_features(t) for i, t in rows}
    s, t = Counter(x for _, f in found.values() for x in f), Counter(x for y in target for x in brute_features(y)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = {}
    for i, (n, f) in found.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        out[i] = [n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-x[3], i) for i, x in out.items() if x[0] >= 20)
    for r, (_, i) in enumerate(able[: 5 * len(able) // 100]):
        out[i][4] = r + 1
    return {i: tuple(x[1:]) for i, x in out.items()}


def test_importance_matches_brute_force(spark):
    r = random.Random(5)
    words = ["The", "cat", "É4", "x_y", "naïve", "z9", "😀", "É", "do"]
    texts = [None, "", "one", "A b C", "x " * 20_000, "İstanbul \x80 Ω", *[" ".join(r.choices(words, k=r.randrange(15, 40))) for _ in range(150)]]
    texts += texts[6:30]
    target = ["the cat do", None, "", "naïve z9 naïve z9"]
    df = docs(spark, texts)
    got = {x.doc_id: (x.n_features, x.weight, x.score, x.rank) for x in importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()}
    assert got == brute_resample(list(enumerate(texts)), target)


def test_importance_repeats_nulls_and_empty_tables(spark):
    text = "a b c d e " * 4
    rows = spark.createDataFrame([(None, text), (None, text), (7, text), (7, text), (7, "other " * 21), *[(i, text) for i in range(100, 200)]], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = importance.resample(rows, none).collect()
    assert len(got) == 105 and sorted(x.rank for x in got if x.rank) == [1, 2, 3, 4, 5]
    drawn = sorted((x.rank, x.score) for x in got if x.rank)
    assert [s for _, s in drawn] == sorted((x.score for x in got), reverse=True)[:5]
    assert importance.resample(empty(spark), none).count() == 0


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("s"), "id")
    got = [(x.s, x.id) for x in importance.with_ranks(df, F.col("s").desc(), F.col("id")).orderBy("rank").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and len(got) == 5000


# 12


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in df.collect()}


@pytest.mark.parametrize("shard_words", [7, 20_000])
def test_spelling_matches_brute_force(spark, shard_words):
    r = random.Random(2)
    base = ["aaaaaa", "abcabcabc", "Réserve", "ÀÉÎõüÿ", "colour", "banana", "ababababab"]
    letters = "abcéÀÿ"

    def changed(w):
        i = r.randrange(len(w) + 1)
        return r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]])

    vocab = base + [changed(r.choice(base)) for _ in range(120)] + [changed(changed(r.choice(base))) for _ in range(60)] + ["x" * 5000, "x" * 4999, "x" * 4000 + "y" + "x" * 999]
    texts = [None, "", " ", "ab-cd"]
    for w in vocab:
        texts += [" ".join([w] * r.choice([1, 5, 6, 30, 31, 160])) for _ in range(2)]
    df = docs(spark, texts)
    assert rows_of(spelling.variants(df, shard_words, 3)) == brute_variants(list(enumerate(texts)))


def test_spelling_chains_nulls_and_empty_tables(spark):
    # each form has five times the occurrences of the one before
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    texts = [" ".join([w] * 5 ** (k + 1)) for k, w in enumerate(words)]
    rows = [(None, t) for t in texts]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_variants(rows) and len({x[1] for x in got.values()}) == 1
    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(docs(spark, [None, "", "short words only"])).count() == 0


def test_trie_of_one_long_run():
    words = sorted("x" * k for k in range(6, 300))
    trie = spelling.Trie(words, [1] * len(words))
    assert sorted(trie.spelt(i) for i in trie.within_one("x" * 50)) == ["x" * 49, "x" * 51]
    assert [len(trie.spelt(i)) for i in trie.within_one("x" * 100_000)] == []


# 13


def blocks(source):
    return html_extract.split_lines(source)


def brute_shared(a, b):
    """All longest common subsequences by the table; here only their length."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [4, 1 << 27])
def test_common_lines_are_longest(monkeypatch, bits):
    monkeypatch.setattr(html_extract, "TABLE_BITS", bits)
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in "ab")
        found = html_extract.common_lines(a, b)
        rest = iter(b)
        assert len(set(found)) == brute_shared(a, b) == len(found) and all(any(a[i] == y for y in rest) for i in found)


def test_lines_of_awkward_markup():
    page = blocks("<title>no</title><p>a &amp; b&nbsp;\n c<br>d<p><b>open<p class='x>'>e &am &#233;</p><script>if (a < b) '</p>'</script>x < y<!-- gone --> z <i>i</i>j<td>k")
    assert page.lines == ["a & b c d", "open", "e &am é", "x < y z ij k"]
    assert blocks("<p>x <span class=ad>buy</span> y").lines == ["buy", "x y"]
    assert blocks("<p>cut <a href='").lines == ["cut"] and blocks("").lines == [] and blocks("plain\n text").lines == ["plain text"]


def test_markup_confirms():
    source = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><p>site</p></header><nav><li>menu</li></nav><div class="cookie-notice">we use</div>
      <article><header><h1>Title</h1></header><p>one</p><aside>see also</aside><p>two</p><form><p>mail</p></form><div id="comments"><article><p>reader</p></article></div></article>
      <div id=footerBox>f</div><footer>c</footer></body></html>"""
    page = blocks(source)
    assert html_extract.main_text(page.lines, page.said, set(range(99))) == "Title\n\none\n\ntwo"
    page = blocks('<body><div id="header">h</div><div class="post-content"><h1>T</h1><p>a</p></div><p>out</p>')
    assert html_extract.main_text(page.lines, page.said, set(range(99))) == "T\n\na"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], "page_id long, url string, html string, key string, part int")


def plain(*lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_unmarked_pages_lose_what_the_nearest_page_shares(spark):
    rows = [
        (1, "http://A.org/news/1?x", plain("menu", "same notice", "first story", "foot")), (2, "http://a.org/news/2", plain("menu", "second story", "same notice", "foot")),
        (3, "http://a.org/zoo", plain("menu", "other", "foot")), (4, "http://b.org/news/1", plain("menu", "alone", "foot")), (5, None, None), (6, "no url", ""),
        (7, "http://c.org/p", plain("x", "y")), (8, "http://c.org/p2", plain("x", "y")), (None, "http://d.org/", plain("z")),
    ]
    for size in (1, 3, 2000):
        got = {x.page_id: (x.text, x.n_shared, x.nearest_id) for x in html_extract.extract_text(table(spark, rows), size).collect()}
        assert got[1] == ("same notice\n\nfirst story", 2, 2) or got[1] == ("first story", 3, 2)
        assert got[2][0] in ("second story", "second story\n\nsame notice") and got[2][2] == 1
        assert got[3] == ("other", 2, 2) and got[4] == ("menu\n\nalone\n\nfoot", 0, None)
        assert got[5] == got[6] == ("", 0, None) and got[7][0] == got[8][0] == "x\n\ny" and got[None][0] == "z"


def brute_extract(rows):
    """One table in memory: the same order of pages, each with both its neighbours."""
    keyed = []
    for i, u, h in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        keyed.append((host.lower(), path, i, h or ""))
    keyed.sort(key=lambda x: x[:2])
    pages = [(host, path, html_extract.split_lines(h), i) for host, path, i, h in keyed]
    out = {}
    for k, (host, path, page, i) in enumerate(pages):
        near = [p for p in (pages[k - 1] if k else None, pages[k + 1] if k + 1 < len(pages) else None) if p and p[0] == host and p[2].lines != page.lines]
        best = max(near, key=lambda p: len(re.match(r"(.*)\0", "".join(a if a == b else "\0" for a, b in zip(path, p[1], strict=False)) + "\0").group(1).split("\0")[0]), default=None)
        shared = set(html_extract.common_lines(page.lines, best[2].lines)) if best else set()
        out[i] = (html_extract.main_text(page.lines, page.said, shared), None if best is None else best[3])
    return out


@pytest.mark.parametrize("size", [3, 50])
def test_ranges_and_hot_hosts_match_brute_force(spark, size):
    r = random.Random(4)
    rows = [(i, f"http://{'hot' if i % 3 else r.choice('abc')}.org/{r.choice('xyz')}/{i}", plain(*r.choices("abcdefgh", k=r.randrange(12)))) for i in range(200)]
    got = {x.page_id: (x.text, x.nearest_id) for x in html_extract.extract_text(table(spark, rows), size).collect()}
    assert got == brute_extract(rows)


def test_articles_of_the_table(spark):
    """The pages' articles, cut out by expressions that know this table's only template."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {x.page_id: x for x in html_extract.op13_html(spark, "/root/testdata/sf0.01").collect()}
    for x in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", x.html, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", y)).split()) for y in re.split(r"</?p>|</?h1>", article))
        assert got[x.page_id].text == "\n\n".join(p for p in parts if p) and got[x.page_id].n_chars == len(got[x.page_id].text)
    assert len(got) == pages.count() and html_extract.extract_text(pages.limit(0)).count() == 0


def test_clashing_names_are_of_no_account(spark):
    assert "key" in CLASH  # docs of the other tests bring them
    rows = table(spark, [(1, "http://a.org/", plain("x")), (1, "http://a.org/", plain("x")), (1, "http://a.org/", plain("y"))])
    assert sorted(x.text for x in html_extract.extract_text(rows).collect()) == ["x", "x", "y"]


# 5, 8


def thue_morse(k):
    w = "a"
    for _ in range(k):
        w += w.translate(str.maketrans("ab", "ba"))
    return w


def test_words_that_collide_in_a_polynomial_hash_differ(spark):
    from quillspark.llm import near_dup
    from quillspark.llm._shingles import word_hashes

    word = thue_morse(11)
    other = word.translate(str.maketrans("ab", "ba"))
    h, firsts = word_hashes([f"{word} x", None, f"{other} X"])
    words = [thue_morse(5)[:k] + c for k in range(1, 32) for c in "abé"] + ["z" * k for k in range(1, 200)]
    assert len(set(words)) == len(set(word_hashes([w])[0].item() for w in words)) == len(set(word_hashes([" ".join(words)])[0].tolist()))
    assert [word_hashes([f"q {w}\tq"])[0][1] for w in words] == word_hashes([" ".join(words)])[0].tolist()
    assert firsts.tolist() == [0, 2, 2, 4] and h[0] != h[2] and h[1] == h[3]
    got = near_dup.near_duplicates(spark.createDataFrame([(1, f"x y z {word}"), (2, f"x y z {other}"), (3, f"X y  z {word}")], "doc_id long, text string"), 4)
    assert {x.doc_id: (x.component_id, x.kept) for x in got.collect()} == {1: (1, True), 2: (2, True), 3: (1, False)}


# 10


def test_lists_beyond_the_cascade_keep_clashing_columns(spark):
    from quillspark.llm import url_filter

    urls = ["http://a.org/x", "http://b.org/y?utm_source=z", "http://b.org/", None]
    df = spark.createDataFrame([(i, u, f"k{i}", "l") for i, u in enumerate(urls)], "page_id long, url string, __key string, url_key string")
    listed = F.bool_or(F.col("url").contains("utm_source="))
    for most in (url_filter.MAX_BITS, 1):
        got = url_filter.judge_urls(df, [], listed, max_bits=most)
        assert got.columns == [*df.columns, "host", "path", "rule", "verdict"]
        assert sorted((x.page_id, x["__key"], x.url_key, x.verdict) for x in got.collect()) == [(0, "k0", "l", "allow"), (1, "k1", "l", "block"), (2, "k2", "l", "block"), (3, "k3", "l", "allow")]


# 4


def exact_fills(have, gap):
    """All multisets of one to three available lengths with this sum."""
    import itertools

    held = [x for x in range(1, gap + 1) if have[x]]
    return [c for k in (1, 2, 3) for c in itertools.combinations_with_replacement(held, k) if sum(c) == gap and all(c.count(x) <= have[x] for x in c)]


def test_complements_are_found_wherever_there_are_any():
    import numpy as np

    from quillspark.llm.packing import Complements

    r = random.Random(8)
    for _ in range(60):
        size = r.randrange(4, 26)
        have = np.array([0, *[r.choice([0, 0, 1, 2, 5]) for _ in range(size)]], np.int64)
        index = Complements(have)
        for a in range(size, 0, -1):  # in the order of the plan, which uses up what it finds
            while have[a]:
                have[a] -= 1
                found, all_fills = index.of(size - a) if a < size else (), exact_fills(have, size - a) if a < size else [()]
                assert (found is None) == (not all_fills) and (found is None or tuple(sorted(found)) in all_fills), (size, a)
                if found is None:
                    have[a] = 0
                    break
                for x in found:
                    have[x] -= 1


def fewest_sequences(lengths, size):
    best = len(lengths)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= lengths[i] and room[j] not in room[:j]:
                place(i + 1, [*room[:j], room[j] - lengths[i], *room[j + 1 :]])
        place(i + 1, [*room, size - lengths[i]])

    place(0, [])
    return best


def test_plans_of_few_pieces_come_within_one_of_the_optimum():
    import numpy as np

    from quillspark.llm.packing import make_plan

    r = random.Random(9)
    exact = 0
    for _ in range(150):
        lengths = sorted((r.randrange(1, 13) for _ in range(r.randrange(1, 10))), reverse=True)
        plan, best = make_plan(np.bincount(lengths, minlength=13), 12).sequences, fewest_sequences(lengths, 12)
        assert best <= plan <= best + 1
        exact += plan == best
    assert exact >= 140
