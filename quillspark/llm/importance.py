"""Importance resampling of documents towards the distribution of a target set, over hashed n-grams.

1. A ring of running zlib states: one scan of a document's words keeps the CRC of the n-grams that
   began at the last words. A word extends each of them by a space and itself and begins a new one,
   so every n-gram costs the bytes of its last word only. The buckets of a document are written
   once, sorted and as differences, into the shared folder; nothing reads a text again.
2. The counts of all buckets in documents and target give each bucket's gain, a table of BUCKETS numbers.
3. A document's weight is the sum of its buckets' gains; with a Gumbel number from the hash of its id it is
   its score, and the highest scores are a draw without replacement in proportion to exp(weight / 1000).
4. Scores are sorted by ranges; a rank is the place in its range plus the sizes of the ranges before.

Defined results: a null text has no words; a document without features weighs 0; a null doc_id hashes as the
empty string and sorts first; repeated rows are drawn each on its own; an empty target has counts of 0;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize, shared_folder

ORDER = 3
BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5

#: Digits, lower-case letters and all bytes beyond ASCII stay, capitals are lower-cased, all else is a space.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def features(text: str, order: int = ORDER) -> tuple[int, list[int]]:
    """(words, CRC-32 of every run of 1 to `order` consecutive words) of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    crc, out, ring = zlib.crc32, [], []
    for w in words:
        later = b" " + w
        ring = [crc(w), *[crc(later, state) for state in ring]]
        out += ring
        if len(ring) == order:
            ring.pop()
    return len(words), out


def _packed(crcs: list[int]) -> bytes:
    places = np.sort(np.array(crcs, np.uint32) % np.uint32(BUCKETS)).astype(np.uint16)
    return np.diff(places, prepend=np.uint16(0)).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint16), dtype=np.int64)


def scanned(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row of texts (doc_id long, text), written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                n, found = features(text or "", order)
                rows.append((n, len(found), _packed(found)))
            out = pd.DataFrame(rows, columns=["n_words", "n_features", "buckets"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64"))
            yield out

    folder = shared_folder(texts.sparkSession, "buckets")
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_words long, n_features long, buckets binary")
    rows.write.option("compression", "zstd").parquet(folder)
    return texts.sparkSession.read.parquet(folder)


def bucket_counts(scan: DataFrame) -> np.ndarray:
    """How often each bucket occurs; each task sums its own before BUCKETS rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for raw in b["buckets"]:
                total += np.bincount(_unpacked(raw), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    counts = np.zeros(BUCKETS, np.int64)
    for r in scan.select("buckets").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, rounded down."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number that depends on the key alone, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def with_ranks(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `rank` from 1 in the order given: sorted by ranges, no window over the table."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    sorted_rows = materialize(sorted_rows)
    part = F.shiftright("place", 33)
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    # a row for each range
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    ranked = sorted_rows.withColumn("part", part).join(F.broadcast(before), "part")
    return ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id long, text); target has a column text.

    rank counts the drawn documents, from the highest score; it is null for all others.
    """
    scan = scanned(docs)
    wanted = scanned(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gain = gains(bucket_counts(scan), bucket_counts(wanted))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["weight"] = np.array([gain[_unpacked(raw)].sum() for raw in b["buckets"]], np.int64)
            yield b[["doc_id", "n_words", "n_features", "weight"]].astype({"doc_id": "Int64"})

    weighed = scan.mapInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))))
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    most = percent * able.count() // 100
    ranked = with_ranks(able, F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").desc(), F.col("n_features"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 is a fold over the bytes with a table made by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS steps FROM bits WHERE k = 8),
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS row_no, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
lists AS (
  SELECT kind, row_no, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
grams AS (
  SELECT kind, row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM lists),
counted AS (SELECT kind, row_no, g, count(*) AS n FROM grams GROUP BY ALL),
bytes AS (SELECT g, list_transform(range(0, octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT) AS x FROM (SELECT DISTINCT g FROM counted)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, x), lambda c, v: xor(c >> 8, steps[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
placed AS (SELECT kind, row_no, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (g) GROUP BY ALL),
totals AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM placed GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, coalesce(sum(t), 0) AS t_all FROM totals),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all::DOUBLE + 10000))))::BIGINT AS gain FROM totals, sums),
weights AS (SELECT row_no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row_no),
scored AS (
  SELECT l.row_no, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM lists l LEFT JOIN weights s ON s.row_no = l.row_no WHERE kind = 'd'),
able AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER () // 100 AS most FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM scored LEFT JOIN able USING (row_no)
"""
