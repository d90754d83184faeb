"""Spelling variants: words one edit apart, found by automata over a compact trie, with their best form.

1. Runs of letters of whole texts are counted by document batch, then by word.
2. The vocabulary is sorted by ranges and cut into shards of at most SHARD_WORDS words. A shard is a
   compact trie: every node is an edge label (a slice of the shard's text), its children stand side
   by side, and branches with one continuation are one node.
3. Shards go to the tasks in rounds of ROUND_SHARDS, so that what is broadcast has a bound whatever the
   vocabulary; in each round every word's distance-one Levenshtein automaton is intersected with
   every shard of it, depth first. Ranges are sorted, so that most shards end at the root's few edges.
4. The accepting neighbours are rows; counts and best form are one aggregation over them. Roots
   follow forms by pointer doubling: n grows fivefold at each step, so few rounds reach the last.

An automaton that has read i letters without error leaves its word only where the trie's next
letter differs from the word's, which finds each neighbour once: a letter put in or taken out of a
run of equal letters counts as the last of that run.

Defined results: a null text has no words; a null doc_id is the empty string in `<doc_id>:<run>`; repeated
rows count each; a run of any length is one word; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import os
import pickle
import re
import zlib
from array import array
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize, shared_folder

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form has at least so many times the word's occurrences.
FACTOR = 5
#: One (document, run) in so many is misspelt on purpose.
TYPO_EVERY = 199
#: A shard ends at so many words or letters, whichever comes first; it takes about 1 MB.
SHARD_WORDS, SHARD_LETTERS = 20_000, 1_000_000
#: Shards that are broadcast together.
ROUND_SHARDS = 16
#: Distinct words that a counting task holds before it passes them on.
HELD = 500_000

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lower_ascii(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_LOWER)


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text, after the letter that a document loses has gone."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text)).items():
        word = lower_ascii(run)
        h = zlib.crc32(word.encode(), before)
        if h % TYPO_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LETTERS:
            yield word, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with at least LEAST_COUNT occurrences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": list(held), "n": list(held.values())})

        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                for word, n in words_of(None if doc_id is pd.NA else int(doc_id), text):
                    held[word] += n
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Trie:
    """A compact trie of sorted distinct words. Node 0 is the root; the children of node k are first[k] to first[k + 1]."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.text = "".join(words)
        self.counts = array("q", counts)
        self.first, self.begin, self.end, self.word = array("I"), array("Q", [0]), array("Q", [0]), array("i")
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w)
        heads = [" "]
        todo = deque([(0, len(words), 0)])  # words from lo to hi share the letters before depth
        while todo:
            lo, hi, depth = todo.popleft()
            ends = lo < hi and len(words[lo]) == depth
            self.word.append(lo if ends else -1)
            self.first.append(len(heads))
            lo += ends
            while lo < hi:
                j = lo + 1
                while j < hi and words[j][depth] == words[lo][depth]:
                    j += 1
                shared = len(os.path.commonprefix([words[lo], words[j - 1]])) if j - lo > 1 else len(words[lo])
                heads.append(words[lo][depth])
                self.begin.append(starts[lo] + depth)
                self.end.append(starts[lo] + shared)
                todo.append((lo, j, shared))
                lo = j
        self.first.append(len(heads))
        self.heads = "".join(heads)
        self.starts = array("Q", [*starts, at])

    def spelt(self, i: int) -> str:
        return self.text[self.starts[i] : self.starts[i + 1]]

    def exact(self, k: int, w: str, i: int) -> int:
        """The word that ends where w from letter i leads from node k, or -1."""
        first, text, begin, end, heads, n = self.first, self.text, self.begin, self.end, self.heads, len(w)
        while i < n:
            k = heads.find(w[i], first[k], first[k + 1])
            if k < 0 or not w.startswith(text[begin[k] : end[k]], i):
                return -1
            i += end[k] - begin[k]
        return self.word[k]

    def within_one(self, w: str) -> list[int]:
        """The words exactly one inserted, deleted or replaced letter away from w."""
        first, text, begin, end, heads, n = self.first, self.text, self.begin, self.end, self.heads, len(w)
        found = []

        def leave(k: int, label: str, i: int) -> None:
            """w is read up to i, and node k goes on with label, whose first letter is another than w's next."""
            tail = label[1:]
            if w.startswith(tail, i):
                found.append(self.exact(k, w, i + len(tail)))  # label's letter is inserted
            if i < n and w.startswith(tail, i + 1):
                found.append(self.exact(k, w, i + 1 + len(tail)))  # it replaces w's
            if i + 1 < n and w.startswith(label, i + 1):
                found.append(self.exact(k, w, i + 1 + len(label)))  # w's is deleted

        k = i = 0
        while True:
            if i == n - 1:
                found.append(self.word[k])  # w's last letter is deleted
            same = -1
            for child in range(first[k], first[k + 1]):
                if i < n and heads[child] == w[i]:
                    same = child
                else:
                    leave(child, text[begin[child] : end[child]], i)
            if same < 0:
                break
            label = text[begin[same] : end[same]]
            if w.startswith(label, i):
                i += len(label)
                k = same
                continue
            agreed = len(os.path.commonprefix([label, w[i : i + len(label)]]))
            leave(same, label[agreed:], i + agreed)
            break
        return [x for x in found if x >= 0]


def trie_shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(no, shard): the tries of all words, numbered from 0 in the order of their ranges."""
    ranges = max(1, -(-words.count() // shard_words))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        counts: list[int] = []
        letters = 0

        def shard() -> pd.DataFrame:
            return pd.DataFrame({"least": [held[0]], "shard": [pickle.dumps(Trie(held, counts))]})

        for b in batches:
            for word, n in zip(b["word"], b["n"], strict=True):
                if held and (len(held) >= shard_words or letters + len(word) > SHARD_LETTERS):
                    yield shard()
                    held, counts, letters = [], [], 0
                held.append(word)
                counts.append(n)
                letters += len(word)
        if held:
            yield shard()

    tries = materialize(words.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInPandas(build, "least string, shard binary"))
    # a row for each shard, without the shard itself
    numbered = tries.select("least").withColumn("no", F.row_number().over(Window.orderBy("least")) - 1)
    return tries.join(numbered, "least").select("no", "shard")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, round_shards: int = ROUND_SHARDS) -> DataFrame:
    """(word, n, near, near_n): every pair of words one edit apart, from both sides."""
    spark = words.sparkSession
    shards = materialize(trie_shards(words, shard_words))
    folder = shared_folder(spark, "near-words")
    parts = max(spark.sparkContext.defaultParallelism * 2, shards.count())
    asked = words.repartition(parts, "word")
    rounds = -(-(shards.agg(F.max("no") + 1).first()[0] or 0) // round_shards)
    schema = "word string, n long, near string, near_n long"
    for r in range(rounds):
        some = shards.where((F.col("no") >= r * round_shards) & (F.col("no") < (r + 1) * round_shards)).select("shard").collect()
        sent = spark.sparkContext.broadcast([bytes(x.shard) for x in some])

        def meet(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            tries = [pickle.loads(x) for x in sent.value]
            for b in batches:
                rows = [(w, n, t.spelt(i), t.counts[i]) for w, n in zip(b["word"], b["n"], strict=True) for t in tries for i in t.within_one(w)]
                if rows:
                    yield pd.DataFrame(rows, columns=["word", "n", "near", "near_n"])

        asked.mapInPandas(meet, schema).write.parquet(f"{folder}/{r}")
        sent.destroy()
    return spark.read.schema(schema).parquet(*[f"{folder}/{r}" for r in range(rounds)]) if rounds else spark.createDataFrame([], schema)


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of forms (word, form): the last form that following leads to."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, shard_words: int = SHARD_WORDS, round_shards: int = ROUND_SHARDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id long, text)."""
    words = materialize(vocabulary(docs))
    near = near_words(words, shard_words, round_shards)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    large = -F.col("best.col1") >= FACTOR * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.col1")).alias("form_n")
    )
    found = materialize(found)
    roots = follow_forms(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 is a fold over the bytes with a table made by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS steps FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n, id || ':' || run AS g FROM runs WHERE length(run) >= 6 GROUP BY id, run),
bytes AS (SELECT id, run, n, list_transform(range(0, octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT) AS x FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, x), lambda c, v: xor(c >> 8, steps[(xor(c, v) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS short FROM places),
masks AS (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM masks a JOIN masks b ON a.mask = b.mask AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.short
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.short),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, reached, form) AS (SELECT word, word, form FROM found UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON f.word = c.form)
SELECT f.word, f.form, c.reached AS root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
