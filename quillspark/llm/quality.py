"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics describe a text only (never its labels, language, source or id). Standardised, they
pass through FEATURES random cosines, which approximate a Gaussian kernel. Each partition adds its
rows into one set of normal equations (FEATURES + 1 squared, whatever the corpus); these are added
up SUMS at a time, and their sum is solved for the ridge scores. Rows with crc32(doc_id) mod 4 = 2 are held out of
everything; those with remainder 3 calibrate the scores that the others fitted, through counts in
BINS score bins and pooling of adjacent violators.

Defined results: a null or empty text has statistics of zero and gets a score; several labels of
a document count as their largest; labels that are null, or of unknown documents, count nothing;
without labels of both values every score is 0.5; an empty table gives an empty one; other
columns stay untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize

FEATURES = 192
WIDTH = 5.0
RIDGE = 1e-3
SUMS = 64
BINS = 2000
KEEP = 0.7
#: Where a model is fitted apart from scoring, so many labelled rows are enough.
SAMPLE = 100_000

_CLASS = np.zeros(256, np.int8)  # 0 other
for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:?'\"()-", b"!", b"|", b"#$%&*@^~<>{}[]\\_+=/`"), 1):
    _CLASS[list(chars)] = k
_CLASS[128:] = 1
N_STATS = 20


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    _, lower, upper, digit, _, point, shout, bar, symbol = np.bincount(_CLASS[raw], minlength=9).tolist()
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, w, m = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    counts, line_counts = Counter(words), Counter(lines)
    twos = len(set(zip(words, words[1:], strict=False)))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)),
        float(sizes.mean()), float(sizes.std()), np.log1p(float(sizes.max())),
        (lower + upper) / n, upper / max(1, lower + upper), digit / n, symbol / n, point / w, shout / w, bar / w,
        len(counts) / w, max(counts.values(), default=0) / w, twos / w,
        len(line_counts) / m, sum(len(x) * (c - 1) for x, c in line_counts.items()) / n,
        sum(x == y for x, y in zip(words, words[1:], strict=False)) / w,
        sum(x[-1] in "#$%&*!|" for x in words) / w,
    ]


def add_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return docs.withColumn("stats", stats(text_col))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(7)
        w, b = rng.normal(0, 1 / WIDTH, (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.cos(x @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated score; a thousandth of it orders rows within a level of the calibration."""
        if not len(self.weights) or not len(stats):
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip(raw / 3 + 1 / 3, 0, 1), 0, 1)

    def score_column(self, text: Column | str) -> Column:
        model = self

        @F.pandas_udf("double")
        def of(texts: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, N_STATS)))

        return of(text)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, N_STATS))


def isotonic(bins: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (bin centre, rows, sum of labels): knots and levels that never fall."""
    pools: list[list[float]] = []  # weighted centre, rows, labels
    for c, k, t in zip(bins, n, total, strict=True):
        pools.append([c * k, k, t])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Rows of docs to fit on: all where there are at most `most` labels, else about as many, chosen by a hash of doc_id."""
    n = labels.select("doc_id").distinct().count()
    return docs if n <= most else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(most / n * (1 << 20)))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: (doc_id, stats); labels: (doc_id, quality). Held-out rows are not read."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("y")).where("y in (0, 1)")
    rows = stats.where(remainder(F.col("doc_id")) != 2).select("doc_id", "stats").join(known, "doc_id")
    rows = materialize(rows.select("stats", F.col("y").cast("double").alias("y"), (remainder(F.col("doc_id")) == 3).alias("calibrates")))
    of = [F.col("stats")[i] for i in range(N_STATS)]
    one = rows.agg(F.count("*"), F.sum("y"), *[F.avg(x) for x in of], *[F.stddev_pop(x) for x in of]).first()
    if not one[0] or one[1] in (0, one[0]):
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.empty(0), np.empty(0), np.empty(0))
    mean, spread = np.array(one[2 : 2 + N_STATS]), np.array(one[2 + N_STATS :])
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), np.empty(0), np.empty(0), np.empty(0))
    size = FEATURES + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            z = model.lift(_stack(b["stats"]))
            left += z.T @ z
            right += z.T @ b["y"].to_numpy()
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"part": [part], "sums": [np.concatenate([left.ravel(), right]).tobytes()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum([np.frombuffer(x) for x in group.sort_values("part")["sums"]], 0)
        return pd.DataFrame({"part": [group["part"].iloc[0] // SUMS], "sums": [sums.tobytes()]})

    sums = materialize(rows.where("not calibrates").mapInPandas(equations, "part long, sums binary"))
    while sums.count() > SUMS:
        sums = materialize(sums.groupBy(F.floor(F.col("part") / SUMS)).applyInPandas(added, "part long, sums binary"))
    total = np.sum([np.frombuffer(r.sums) for r in sums.orderBy("part").collect()], 0)  # SUMS rows at most
    left, right = total[: size * size].reshape(size, size), total[size * size :]
    n = left[-1, -1]
    penalty = np.eye(size) * RIDGE * max(n, 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(left + penalty, right)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = model.raw(_stack(b["stats"]))
            yield pd.DataFrame({"bin": np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32), "y": b["y"]})

    counted = rows.where("calibrates").mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*"), F.sum("y")).collect()  # BINS rows at most
    table = np.array(sorted(tuple(r) for r in counted)).reshape(-1, 3)
    if not len(table):
        table = np.array([[0, 1, 0], [BINS - 1, 1, 1]])
    model.knots, model.levels = isotonic((table[:, 0] + 0.5) / BINS * 2 - 0.5, table[:, 1], table[:, 2])
    return model


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = materialize(add_statistics(docs).drop("text"))
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": model.score(_stack(b["stats"]))})

    out = stats.mapInPandas(scored, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
