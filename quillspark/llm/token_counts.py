"""Token counts of fields and sections from one encoding of the whole document.

The fields of a row are joined by newlines and encoded once. Token character spans are then joined
to the sections' intervals, which cut the joined text without gaps: every token goes to exactly
one section, so the counts of a document add up to its tokens. A token that crosses a boundary
goes by the rule: "first" to the section of its first character, "last" to that of its last,
"most" to the one with most of its characters (the earlier on a tie).

Defined results: a null field is empty; an empty text is one section with no tokens; rows are
counted each on its own, ids null or repeated or not; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._encode import Encoder, encoder_of

RULES = ("first", "last", "most")


def allocate(spans: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens) of each section; cuts are the sections' begins, the first 0."""
    at = lambda x: np.searchsorted(cuts, x, "right") - 1
    first, last = at(spans[:, 0]), at(np.maximum(spans[:, 1] - 1, spans[:, 0]))
    own = first if rule == "first" else last
    if rule == "most":
        own = first.copy()
        for k in np.flatnonzero(first != last):
            edges = np.clip(np.append(cuts[first[k] : last[k] + 1], spans[k, 1]), spans[k, 0], None)
            own[k] += int(np.argmax(np.diff(edges)))
    return np.bincount(own, minlength=len(cuts)), np.bincount(own[first != last], minlength=len(cuts))


def count_tokens(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("text",), lines: bool = True, rule: str = "first") -> DataFrame:
    """(doc_id, field, section, start, end, n_tokens, n_crossing): sections are the lines of each field, or whole fields.

    start and end count characters of the field; a section holds the newline behind it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        for b in batches:
            for k in range(0, len(b), 1000):
                yield _counted(b.iloc[k : k + 1000], encoder, fields, lines, rule)

    columns = [F.col("doc_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)]]
    return docs.select(*columns).mapInPandas(run, "doc_id long, field string, section int, start long, end long, n_tokens long, n_crossing long")


def _counted(b: pd.DataFrame, encoder: Encoder, fields: tuple[str, ...], lines: bool, rule: str) -> pd.DataFrame:
    out = []
    for row in b.itertuples(index=False):
        whole = "\n".join(row[1:])
        heads = np.cumsum([0, *[len(t) + 1 for t in row[1:-1]]])
        cuts, of = heads, np.arange(len(fields))
        if lines:
            found = [np.array([0, *[i + 1 for i, c in enumerate(t) if c == "\n"]] if "\n" in t else [0]) for t in row[1:]]
            cuts = np.concatenate([f + h for f, h in zip(found, heads, strict=True)])
            of = np.repeat(np.arange(len(fields)), [len(f) for f in found])
        tokens, crossing = allocate(encoder.spans(whole), cuts, rule)
        ends = np.append(cuts[1:], len(whole))
        no = np.arange(len(cuts)) - np.searchsorted(of, of)
        out.append((np.full(len(cuts), row[0]), of, no, cuts - heads[of], ends - heads[of], tokens, crossing))
    doc, of, *rest = [np.concatenate(x) for x in zip(*out, strict=True)]
    frame = pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "field": np.array(fields, object)[of]})
    return frame.assign(**dict(zip(("section", "start", "end", "n_tokens", "n_crossing"), rest, strict=True)))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
