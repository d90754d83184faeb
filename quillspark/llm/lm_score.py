"""Stupid-backoff scores of documents under a word n-gram model of the whole corpus.

A word's score is the count of the n-gram of ORDER words that ends with it over the count of the
words before; where fewer than MIN_COUNT of that n-gram occur, the next shorter one counts, times
BACKOFF, down to the word's share of all words. The first words of a document have shorter n-grams.

Each step partitions by hash and passes tables on by a shuffle:
1. Documents are dealt into slices of about SLICE_CHARS characters, those that begin alike into the
   same one, as copies share their n-grams; a slice that grows too large is dealt on by doc_id.
2. The n-grams of all orders of a slice are exploded and counted before they move; those counts go
   to as many buckets of the n-gram's 64-bit hash, so that no frequent n-gram is more than one row a slice.
3. A bucket sums the counts and joins the sums to the slices' n-grams. An n-gram that occurs once
   in the corpus has nothing to say beyond its slice and is not sent back: what a slice does not get counts 1.
4. A slice joins the counts to its documents' n-grams and sums the scores of each document.

Defined results: A-Z are lower-cased, words are the runs between the bytes 9 to 13 and 32; a null
text is empty; a text without words scores null over 0 words; rows with equal ids count as
one document, those without id as one more; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shingles import gram_hashes, slices, word_hashes
from quillspark.session import materialize

ORDER = 2
MIN_COUNT = 2
BACKOFF = 0.4
SLICE_CHARS = 12_000_000
#: Characters by which documents that begin alike are known.
ALIKE = 64


def dealt(docs: DataFrame, slice_chars: int = SLICE_CHARS) -> tuple[DataFrame, int]:
    """(slice, doc_id, text) of every row, and the number of slices."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    weight = F.sum(F.length("text") + ALIKE)
    total = docs.agg(weight).first()[0] or 0
    n = max(1, -(-total // slice_chars))
    first = F.pmod(F.xxhash64(F.left("text", F.lit(ALIKE))), F.lit(n))
    large = docs.groupBy(first.alias("slice")).agg(weight.alias("chars")).where(F.col("chars") > 2 * slice_chars).collect()
    # the few slices that many copies share get further ones behind the last
    where: Column = first
    for r in large:
        parts = -(-r.chars // slice_chars)
        where = F.when(first == r.slice, F.lit(n) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).otherwise(where)
        n += parts
    return docs.select(where.cast("long").alias("slice"), "doc_id", "text"), n


class _Words:
    """The words of texts, as hashes in one array, and the n-grams of these."""

    def __init__(self, texts: list[str]) -> None:
        found, sizes = [], []
        for i, j in slices(texts):
            hashes, firsts = word_hashes(texts[i:j])
            found.append(hashes)
            sizes.append(np.diff(firsts))
        self.hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        #: how many words of its text stand before each word
        self.before = np.arange(len(self.hashes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the last words, hashes) of the n-grams of k words."""
        at = np.flatnonzero(self.before >= k - 1)
        return at, gram_hashes(self.hashes, k)[at - k + 1].view(np.int64)


def gram_rows(keyed: DataFrame, buckets: int, order: int) -> DataFrame:
    """(bucket, slice, h, n): the distinct n-grams of each slice with their counts, in an array for each bucket."""

    def explode(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        words = _Words(group["text"].tolist())
        h, n = np.unique(np.concatenate([words.grams(k)[1] for k in range(1, order + 1)]), return_counts=True)
        bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((n, bucket))  # equal counts side by side take no room in the shuffle
        kinds, cuts = np.unique(bucket[by], return_index=True)
        cut = lambda x: pd.Series(np.split(x[by], cuts[1:]) if len(kinds) else [], dtype=object)
        return pd.DataFrame({"bucket": kinds, "slice": int(group["slice"].iloc[0]), "h": cut(h), "n": cut(n.astype(np.int32))})

    return keyed.groupBy("slice").applyInPandas(explode, "bucket long, slice long, h array<long>, n array<int>")


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(slice, h, c): for the n-grams of each row those that the corpus holds more than once, with their counts in it."""

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["h"].map(len).to_numpy()
        h, n = np.concatenate(group["h"].to_list()), np.concatenate(group["n"].to_list())
        _, of = np.unique(h, return_inverse=True)
        c = np.bincount(of, n).astype(np.int64)[of]
        ends = np.cumsum(sizes)
        many = [np.flatnonzero(c[a:b] > 1) + a for a, b in zip(ends - sizes, ends, strict=True)]
        many = [x[np.argsort(c[x], kind="stable")] for x in many]
        back = pd.DataFrame({"slice": group["slice"].to_numpy(), "h": pd.Series([h[x] for x in many], dtype=object), "c": pd.Series([c[x] for x in many], dtype=object)})
        return back[[len(x) > 0 for x in many]]

    return rows.groupBy("bucket").applyInPandas(summed, "slice long, h array<long>, c array<long>")


def score_documents(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, n_words, log_score, per_word): words, the sum of their log scores, and its mean."""
    keyed, n = dealt(docs, slice_chars)
    counts = corpus_counts(gram_rows(keyed, n, order))

    def score(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        words = _Words(texts["text"].tolist())
        h = np.concatenate([*found["h"], np.empty(0, np.int64)])
        by = np.argsort(h)
        h, c = h[by], np.concatenate([*found["c"], np.empty(0, np.int64)])[by]

        def count(grams: np.ndarray) -> np.ndarray:
            if not len(h):
                return np.ones(len(grams))
            at = np.minimum(np.searchsorted(h, grams), len(h) - 1)
            return np.where(h[at] == grams, c[at], 1).astype(float)

        of = np.ones(len(words.hashes))  # the count of the n-gram that ends with each word, of the order at hand
        s, single = np.zeros(len(of)), np.ones(len(of), bool)
        for k in range(1, order + 1):
            at, grams = words.grams(k)
            now = of.copy()
            now[at] = count(grams)
            if k == 1:
                s = np.log(now)
            else:
                held = now[at] >= min_count
                s[at] = np.where(held, np.log(now[at] / of[at - 1]), np.log(backoff) + s[at])
                single[at] &= ~held
            of = now
        size = len(texts)
        return pd.DataFrame({
            "doc_id": texts["doc_id"].astype("Int64"), "n_words": words.sizes, "part": np.bincount(words.row, s, size), "alone": np.bincount(words.row, single, size).astype(np.int64),
        })

    scored = keyed.groupBy("slice").cogroup(counts.groupBy("slice")).applyInPandas(score, "doc_id long, n_words long, part double, alone long")
    # the single word's score is over all words, whose number is known now
    scored = materialize(scored)
    total = scored.agg(F.sum("n_words")).first()[0] or 1
    out = scored.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum(F.col("part") - F.col("alone") * float(np.log(max(total, 1)))).alias("s"))
    log_score = F.when(F.col("n_words") > 0, F.col("s"))
    return out.select("doc_id", "n_words", log_score.alias("log_score"), (log_score / F.col("n_words")).alias("per_word"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("per_word", 6).alias("per_word"))


ORACLE_SQL = r"""
WITH lists AS (
  SELECT row_number() OVER () AS row_no, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
split AS (SELECT row_no, doc_id, unnest(w) AS word, unnest(list_concat([NULL], w[1:len(w) - 1])) AS prev FROM lists WHERE len(w) > 0),
uni AS (SELECT word, count(*) AS c FROM split GROUP BY word),
bi AS (SELECT prev, word, count(*) AS c FROM split WHERE prev IS NOT NULL GROUP BY prev, word),
total AS (SELECT count(*) AS n FROM split),
scored AS (
  SELECT s.doc_id, CASE WHEN b.c >= 2 THEN ln(b.c::DOUBLE / p.c) WHEN s.prev IS NOT NULL THEN ln(0.4::DOUBLE) + ln(u.c::DOUBLE / n) ELSE ln(u.c::DOUBLE / n) END AS s
  FROM split s JOIN uni u ON s.word = u.word LEFT JOIN bi b ON b.prev = s.prev AND b.word = s.word LEFT JOIN uni p ON p.word = s.prev, total),
sums AS (SELECT doc_id, count(*) AS n_words, sum(s) AS log_score FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(log_score, 3) AS log_score, round(log_score / n_words, 6) AS per_word
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN sums ON sums.doc_id IS NOT DISTINCT FROM d.doc_id
"""
