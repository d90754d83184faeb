"""Batch ingest: documents become chunks and claims of many papers at once, each paper on its own fate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize

CLAIM = "paper_id long, chunk_id string, text string, confidence double"


@dataclass
class Ingested:
    """The tables after a batch, and one row for each document of the batch: (paper_id, status, error, n_chunks, n_claims)."""

    chunks: DataFrame
    claims: DataFrame
    report: DataFrame


def parsed_chunks(docs: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, pos, text): the lines of each document that are not blank."""
    lines = docs.select("paper_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("trim(text) != ''")
    return lines.select("paper_id", F.concat_ws(":", "paper_id", "pos").alias("chunk_id"), "pos", "text")


def extract_papers(chunks: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(paper_id, error, claims): one call of an injected model for each paper (paper_id, chunk_id, pos, text, in order); its exception is the paper's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for paper, xs in zip(b["paper_id"], b["xs"], strict=True):
                frame = pd.DataFrame([{"paper_id": paper, "chunk_id": x["chunk_id"], "pos": x["pos"], "text": x["text"]} for x in xs])
                try:
                    found = [(r.chunk_id, r.text, float(r.confidence)) for r in call(frame).itertuples()]
                    rows.append((paper, None, found))
                except Exception as e:  # noqa: BLE001 - a paper that fails is reported, and the others go on
                    rows.append((paper, str(e), []))
            yield pd.DataFrame(rows, columns=["paper_id", "error", "claims"])

    # a paper is what one call gets, so its chunks come together
    papers = chunks.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "text"))).alias("xs"))
    return papers.mapInPandas(run, "paper_id long, error string, claims array<struct<chunk_id:string,text:string,confidence:double>>")


def ingest_documents(docs: DataFrame, chunks: DataFrame, claims: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame]) -> Ingested:
    """EXT-18: docs (paper_id long, text) into chunks (paper_id, chunk_id, pos, text) and claims (CLAIM).

    A document without text is empty; of documents with equal text the smallest id is taken, the others are duplicates. A paper whose
    extraction fails keeps the claims it had, but has its new chunks; all other papers of the batch are replaced as a whole.
    Papers outside the batch stay as they are.
    """
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    rows = docs.select("paper_id", "text", blank.alias("blank"), F.sha2("text", 256).alias("mark"))
    first = rows.where("not blank").groupBy("mark").agg(F.min("paper_id").alias("first"))
    marked = rows.join(first, "mark", "left").select("paper_id", "text", F.when(F.col("blank"), "empty").when(F.col("first") != F.col("paper_id"), "duplicate").alias("skipped"))
    marked = materialize(marked)
    new = materialize(parsed_chunks(marked.where("skipped is null")))
    calls = materialize(extract_papers(new, call))
    taken = marked.where("skipped is null").select("paper_id")
    found = calls.where("error is null").select("paper_id", F.explode("claims").alias("c")).select("paper_id", "c.chunk_id", "c.text", "c.confidence")
    done = calls.where("error is null").select("paper_id")
    n_chunks, n_claims = (x.groupBy("paper_id").agg(F.count("*").alias(n)) for x, n in ((new, "n_chunks"), (found, "n_claims")))
    report = marked.select("paper_id", "skipped").join(calls.select("paper_id", "error"), "paper_id", "left").join(n_chunks, "paper_id", "left").join(n_claims, "paper_id", "left")
    status = F.coalesce("skipped", F.when(F.col("error").isNotNull(), "failed").otherwise("ingested"))
    return Ingested(
        chunks.join(taken, "paper_id", "left_anti").unionByName(new),
        claims.join(done, "paper_id", "left_anti").unionByName(found),
        report.select("paper_id", status.alias("status"), "error", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_claims", F.lit(0)).alias("n_claims")),
    )
