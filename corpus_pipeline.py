"""A training-data pipeline over documents: quality, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Null texts are empty; empty documents are scored like others, link with
nothing and pack into one end mark. Rows without doc_id pass the near-copy stage unseen, as nothing
names them; of rows with equal ids each is judged by its own text. Texts of any length stay whole.
Without labels to learn from nothing is rejected. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import near_dup, packing, pii, quality
from quillspark.session import ensure_checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on at most about quality.SAMPLE labelled ones, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = quality.add_statistics(quality.sampled(docs.select("doc_id", "text"), labels)).drop("text")
    model = quality.fit(stats, labels)
    if not len(model.weights):  # nothing to learn from, so nothing to reject
        return docs
    return docs.where(model.score_column("text") >= quality.KEEP)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each group of near copies stays."""
    found = near_dup.near_duplicates(docs)
    of_group = found.where("kept and component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    keys = of_group.select("k.doc_id", F.col("k.text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("hash"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("words"))
    same = Window.partitionBy("doc_id", "hash").orderBy(F.lit(1))
    one = rows.join(keys, ["doc_id", "hash"], "left_semi").withColumn("no", F.row_number().over(same)).where("no = 1").select("row")
    unseen = rows.where("doc_id is null or not coalesce(words, false)").select("row")
    return one.unionByName(unseen).select("row.*")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; n_chars follows where the text changed."""
    changed = pii.redact(docs.select(F.struct("*").alias("row"), "text"))
    same, n = F.col("text").eqNullSafe(F.col("row.text")), F.length("text").cast("long")
    new = {"text": F.col("text"), "n_chars": F.when(same, F.col("row").getField("n_chars")).otherwise(n) if "n_chars" in docs.columns else n}
    return changed.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("pii", redact_pii), ("packing", pack)]

#: The classifier and the tokenizer cannot be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder and read again."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
