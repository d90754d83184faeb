"""A persisted vector index of several corpora, and search with a lexical fallback.

Rows of a corpus are cut into segments, embedded once by an injected callable, and written under corpus and cell. Cells
come from centroids, a bounded sample of the corpus, so that they are known before the one pass that embeds and
assigns; every segment is indexed. A cell keeps its number of segments and its radius, from which a
question knows, without reading a segment, how far its k-th nearest can be, and which cells can hold one
so near. Only those are read, by a filter that reaches the files, and the result is exact.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.kernels import segmented
from quillspark.session import materialize, stored

Embed = Callable[[list[str]], list[list[float]]]

#: Texts embedded by one call, attempts and seconds before the second one.
EMBED_BATCH, ATTEMPTS, DELAY = 64, 5, 5.0
#: Most centroids of a corpus; they travel to every task (8 MB at 1024 dimensions).
MOST_CELLS = 1024
#: Segments of a page of the files.
PAGE = 256
#: Questions searched in one pass over a corpus.
QUESTIONS = 1024
KEPT = "id string, kind string, paper_source string, meta string, segment_index int, segment_count int, text string"


class IndexMissing(Exception):
    """No index of that corpus is there."""


def call_embedder(embed: Embed, texts: list[str], attempts: int = ATTEMPTS, delay: float = DELAY) -> list[list[float]]:
    """VEC-04, SINK-18: vectors of the texts, in batches; a batch that raises is tried again, later each time."""
    out: list[list[float]] = []
    for i in range(0, len(texts), EMBED_BATCH):
        batch = texts[i : i + EMBED_BATCH]
        for attempt in range(attempts):
            try:
                got = embed(batch)
                break
            except Exception as e:
                if attempt + 1 == attempts:
                    raise RuntimeError(f"the embedder failed {attempts} times: {e}") from e
                time.sleep(delay * 2**attempt)
        if len(got) != len(batch):
            raise RuntimeError(f"the embedder gave {len(got)} vectors for {len(batch)} texts")
        out += got
    return out


def corpus_segments(rows: DataFrame) -> DataFrame:
    """(KEPT): the segments of rows (id, kind, paper_source, meta, text); rows with a blank text go."""
    strip = F.regexp_replace("text", r"^\s+|\s+$", "")
    full = rows.select(F.col("id").cast("string").alias("id"), "kind", "paper_source", "meta", strip.alias("text")).where("text is not null and text != ''")
    return segmented(full).withColumnRenamed("segment", "text").select(*[c.split()[0] for c in KEPT.split(", ")])


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centroid, distance to it) of each vector, a few rows at a time.

    The nearest is found by products, whose rounding may take another one that is as near; the distance is that to the one taken.
    """
    cell, half = np.empty(len(vectors), np.int64), (centroids**2).sum(1) / 2
    for i in range(0, len(vectors), 256):
        cell[i : i + 256] = (half - vectors[i : i + 256] @ centroids.T).argmin(1)
    return cell, np.sqrt(((vectors - centroids[cell]) ** 2).sum(1))


def embed_tasks(n: int) -> int:
    """Tasks that embed n segments: of 2,000 each up to 400 tasks, then of up to 20,000, as a task has a cost of its own."""
    return max(1, min(-(-n // 2000), 400), -(-n // 20000))


def build_index(corpora: dict[str, DataFrame], embed: Embed, folder: str, attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    """SINK-18, EXT-20: all corpora of rows (id, kind, paper_source, meta, text) anew; (corpus, rows_indexed, segments_indexed).

    What folder held before goes, other corpora included; a corpus without rows is left out.
    """
    spark = next(iter(corpora.values())).sparkSession
    spark.createDataFrame([], f"corpus string, cell int, far double, vec array<double>, {KEPT}").write.mode("overwrite").partitionBy("corpus").parquet(f"{folder}/vectors")
    spark.createDataFrame([], "corpus string, cell int, centroid array<double>, radius double, n long").write.mode("overwrite").parquet(f"{folder}/cells")

    @F.pandas_udf("array<double>")
    def embedded(texts: pd.Series) -> pd.Series:
        return pd.Series(call_embedder(embed, texts.tolist(), attempts, delay))

    for corpus, rows in corpora.items():
        parts = stored(corpus_segments(rows))
        n = parts.count()
        if not n:
            continue
        # cut off before it is embedded, as only then each task sends its first rows and not all
        sample = stored(parts.orderBy(F.xxhash64("id", "segment_index"), "id").limit(min(MOST_CELLS, int(n**0.5) + 1)).select("text"))
        sample = stored(sample.select(embedded("text").alias("vec")))
        centroids = np.unique(np.array([r.vec for r in sample.collect()], float), axis=0)

        # only texts go to the workers, and no text comes back
        @F.pandas_udf("cell int, far double, vec array<double>")
        def assign(texts: pd.Series) -> pd.DataFrame:
            vectors = np.array(call_embedder(embed, texts.tolist(), attempts, delay), float)
            cell, far = _nearest(vectors, centroids)
            return pd.DataFrame({"cell": cell, "far": far, "vec": list(vectors)})

        placed = parts.repartition(embed_tasks(n)).withColumn("placed", assign("text")).select(*parts.columns, "placed.*").withColumn("corpus", F.lit(corpus))
        # texts are shuffled once; segments of a cell are side by side in each file, in small pages, so that the filter on it skips pages
        paged = placed.sortWithinPartitions("cell", "id").write.mode("append").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE)
        paged.partitionBy("corpus").parquet(f"{folder}/vectors")
        cells = spark.read.parquet(f"{folder}/vectors").where(F.col("corpus") == corpus).groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        middle = spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cell int, centroid array<double>")
        cells.join(middle, "cell").select(F.lit(corpus).alias("corpus"), "cell", "centroid", "radius", "n").write.mode("append").parquet(f"{folder}/cells")
    return spark.read.parquet(f"{folder}/vectors").groupBy("corpus").agg(F.count_distinct("id").alias("rows_indexed"), F.count("*").alias("segments_indexed"))


def cells_needed(questions: np.ndarray, centroids: np.ndarray, radius: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Which cells (columns) can hold one of the k nearest of each question (rows)."""
    far = np.sqrt(((questions[:, None, :] - centroids[None, :, :]) ** 2).sum(2))
    worst = far + radius
    by = np.argsort(worst, axis=1)
    held = np.cumsum(n[by], axis=1)
    # the first cells, by their farthest point, that hold k segments
    last = np.minimum((held < k).sum(1), len(n) - 1)
    bound = np.take_along_axis(worst, by, 1)[np.arange(len(by)), last]
    return far - radius <= bound[:, None] + 1e-4  # squared distances are rounded to nine digits


def search_index(questions: DataFrame, folder: str, corpus: str, k: int, embed: Embed, attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    """VEC-07: (qid, kind, id, paper_source, text, score): the k nearest segments of each question (qid long, question), by the squared distance."""
    spark = questions.sparkSession
    try:
        cells = spark.read.parquet(f"{folder}/cells").where(F.col("corpus") == corpus).collect()
    except AnalysisException as e:
        raise IndexMissing(corpus) from e
    if not cells:
        raise IndexMissing(corpus)
    centroids, radius, n = np.array([c.centroid for c in cells]), np.array([c.radius for c in cells]), np.array([c.n for c in cells])
    kept = spark.read.parquet(f"{folder}/vectors").where(F.col("corpus") == corpus)
    found = []
    asked = questions.select(F.col("qid").cast("long").alias("qid"), "question")
    rounds = max(1, -(-asked.count() // QUESTIONS))
    for r in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == r).collect()
        if not block:
            continue
        vectors = np.array(call_embedder(embed, [q.question or "" for q in block], attempts, delay), float)
        ids = np.array([q.qid for q in block])
        needed = cells_needed(vectors, centroids, radius, n, k)
        numbers = [int(c.cell) for c, some in zip(cells, needed.any(0), strict=True) if some]
        at = {int(c.cell): i for i, c in enumerate(cells)}

        def nearest(batches: Iterator[pd.DataFrame], vectors=vectors, ids=ids, needed=needed, at=at) -> Iterator[pd.DataFrame]:
            for b in batches:
                data, names, index = np.stack(b["vec"].to_numpy()), b["id"].to_numpy(), b["segment_index"].to_numpy()
                ask = needed[:, [at[c] for c in b["cell"]]]
                out = []
                for i, q in enumerate(vectors):
                    own = np.flatnonzero(ask[i])
                    if len(own):
                        d = np.round(((data[own] - q) ** 2).sum(1), 9)
                        # all rows up to the k-th distance, ties included
                        most = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                        out += [(ids[i], names[j], index[j], x) for j, x in zip(own[d <= most], d[d <= most], strict=True)]
                if out:
                    yield pd.DataFrame(out, columns=["qid", "id", "segment_index", "score"])

        near = kept.where(F.col("cell").isin(numbers)).select("id", "segment_index", "cell", "vec").mapInPandas(nearest, "qid long, id string, segment_index int, score double")
        place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id", "segment_index"))
        found.append(materialize(near.withColumn("place", place).where(F.col("place") <= k).drop("place")))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits.join(kept.select("id", "segment_index", "kind", "paper_source", "text"), ["id", "segment_index"]).select("qid", "kind", "id", "paper_source", "text", "score")


def lexical_hits(questions: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """VEC-07 without an index: (qid, kind, id, paper_source, text, score), scored by the share of the question's words in the row's text.

    Words meet in an inverted list. Where fewer than k rows share a word, the first others by source and id fill up with 0.
    """
    words = F.explode(tx.structured_tokens(F.col("question"))).alias("token")
    asked = materialize(questions.select(F.col("qid").cast("long").alias("qid"), words).groupBy("qid", "token").agg(F.count("*").alias("times")))
    distinct = asked.groupBy("qid").agg(F.count("*").alias("distinct"))
    full = materialize(rows.select(F.col("id").cast("string").alias("id"), "kind", "paper_source", "text").where("trim(text) != ''"))
    lists = full.select("kind", "id", F.explode(F.array_distinct(tx.structured_tokens(F.col("text")))).alias("token"))
    met = lists.join(asked, "token").groupBy("qid", "kind", "id").agg(F.sum("times").alias("met")).join(distinct, "qid")
    met = met.select("qid", "kind", "id", (F.col("met") / F.col("distinct")).alias("score")).join(full, ["kind", "id"])
    source = F.coalesce("paper_source", F.lit(""))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), source, "id"))
    best = materialize(met.withColumn("place", place).where(F.col("place") <= k).drop("place"))
    first = full.orderBy(source, "id").limit(2 * k).collect()  # k at most are hits already
    if not first:
        return best
    short = questions.select(F.col("qid").cast("long").alias("qid")).join(best.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < k)
    row = [F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in full.columns]) for r in first]
    fill = short.select("qid", F.explode(F.array(*row)).alias("r")).select("qid", "r.*").join(best.select("qid", "kind", "id"), ["qid", "kind", "id"], "left_anti")
    return best.unionByName(fill.withColumn("score", F.lit(0.0)).select(*best.columns))


def search_corpus(questions: DataFrame, folder: str, corpus: str, rows: DataFrame, k: int, embed: Embed, allowed: list[str] | None = None, attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    """VEC-07: (qid, rank, kind, id, paper_source, score, mode) of the k best hits for each question in one corpus.

    mode is vector, or lexical where there is no index or the embedder fails. The k nearest segments are taken first; then
    sources that are not allowed go, hits are sorted by falling score (of a vector hit its squared distance), source and id, and
    the first of each kind and id stays.
    """
    try:
        hits, mode = search_index(questions, folder, corpus, k, embed, attempts, delay), "vector"
        scope = hits if allowed is None else hits.where(F.trim(F.coalesce("paper_source", F.lit(""))).isin(allowed))
    except (IndexMissing, RuntimeError):
        scope, mode = lexical_hits(questions, rows if allowed is None else rows.where(F.trim(F.coalesce("paper_source", F.lit(""))).isin(allowed)), k), "lexical"
    source = F.coalesce("paper_source", F.lit(""))
    one = F.row_number().over(Window.partitionBy("qid", "kind", "id").orderBy(F.desc("score")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), source, "id"))
    out = scope.withColumn("one", one).where("one = 1").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("qid", "rank", "kind", "id", "paper_source", F.round("score", 9).alias("score"), F.lit(mode).alias("mode"))
