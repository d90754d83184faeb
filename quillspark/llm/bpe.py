"""BPE encoding and decoding of whole texts; long ones by tree concatenation.

A text longer than LONG characters is cut into pieces that are encoded in parallel. Neighbours
are joined in a tree, FAN of them in a task, until one is left: a window around each join is
encoded again and grows, on the side that needs it, until on either side one whole token of the
window is a token of the piece, at the same place. What lies left of the one, the window's tokens
between and what lies right of the other are then the encoding of both: a list of tokens is the
encoding of its text if each two neighbours are that of theirs, and every two neighbours here are
neighbours in one of the three encodings. At worst, as in a run of one character, the window is the text.

Defined results: a null text is empty and has no tokens; every row is encoded on its own, ids
null or repeated or not; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._encode import Encoder, encoder_of

LONG = 50_000
PIECE = 25_000
WINDOW = 128
FAN = 16


@dataclass
class Part:
    text: str
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def _stands(text: str, at: int) -> bool:
    """Whether normalizing leaves what lies before this place apart from what follows."""
    return at >= len(text) or (unicodedata.category(text[at])[0] != "M" and not "\u1100" <= text[at] <= "\u11ff")


def _agreed(
    text: str, p: Part, shift: int, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, lo: int, hi: int, first: bool = False
) -> tuple[int, int] | None:
    """Places in p and in the window behind the last token within lo and hi that both hold, or before the first such token."""
    a, b = np.searchsorted(p.begins + shift, [lo, hi])
    held = {(int(p.begins[i]) + shift, int(p.ends[i]) + shift, int(p.ids[i])): i for i in range(a, b)}
    for k in range(len(ids)) if first else reversed(range(len(ids))):
        i = held.get((int(begins[k]), int(ends[k]), int(ids[k]))) if lo <= begins[k] and ends[k] <= hi else None
        if i is None or not _stands(text, int(begins[k] if first else ends[k])):
            continue
        # no other token reaches over the place: characters may be normalized into several tokens
        if first and (k == 0 or ends[k - 1] <= begins[k]) and (i == 0 or p.ends[i - 1] <= p.begins[i]):
            return i, k
        if not first and (k + 1 == len(ids) or begins[k + 1] >= ends[k]) and (i + 1 == len(p.ids) or p.begins[i + 1] >= p.ends[i]):
            return i + 1, k + 1
    return None


class Joiner:
    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.encoded = 0  # characters that joins encoded again
        # a special token over a join is whole in its window
        self.least = 2 * max((len(t.content) for t in encoder.tokenizer.get_added_tokens_decoder().values()), default=0)

    def encode(self, text: str) -> Part:
        e = self.encoder.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Part(text, np.array(e.ids, "<u4"), spans[:, 0], spans[:, 1])

    def join(self, a: Part, b: Part, window: int = WINDOW) -> Part:
        text, at = a.text + b.text, len(a.text)
        window = max(window, self.least)
        lo, hi = max(0, at - window), min(len(text), at + window)
        while True:
            mid = self.encode(text[lo:hi])
            self.encoded += hi - lo
            begins, ends = mid.begins + lo, mid.ends + lo
            left = (0, 0) if lo == 0 else _agreed(text, a, 0, mid.ids, begins, ends, lo, at)
            right = (len(b.ids), len(mid.ids)) if hi == len(text) else _agreed(text, b, at, mid.ids, begins, ends, at, hi, first=True)
            if left and right:
                (i, k), (j, m) = left, right
                return Part(
                    text, np.concatenate([a.ids[:i], mid.ids[k:m], b.ids[j:]]),
                    np.concatenate([a.begins[:i], begins[k:m], b.begins[j:] + at]), np.concatenate([a.ends[:i], ends[k:m], b.ends[j:] + at]),
                )
            if not left:
                lo = max(0, at - 4 * (at - lo))
            if not right:
                hi = min(len(text), at + 4 * (hi - at))

    def tree(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


def encode_decode(docs: DataFrame, tokenizer: str, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids binary, decoded string): little-endian unsigned 32-bit ids, and their decoding with special tokens kept."""
    schema = "doc_id long, ids binary, decoded string"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        for b in batches:
            for k in range(0, len(b), 500):
                c = b.iloc[k : k + 500]
                ids = encoder.ids_of(c["text"].tolist())
                yield pd.DataFrame({"doc_id": c["doc_id"].astype("Int64"), "ids": [x.tobytes() for x in ids], "decoded": [encoder.decode(x) for x in ids]})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joiner = Joiner(encoder_of(tokenizer))
        for b in batches:
            yield _row(b[["row", "doc_id", "no"]], [joiner.encode(t) for t in b["text"]])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                parts = [r.text[i : i + piece] for i in range(0, len(r.text), piece)]
                doc = pd.array([r.doc_id] * len(parts), "Int64") if pd.notna(r.doc_id) else pd.array([None] * len(parts), "Int64")
                yield pd.DataFrame({"row": r.row, "doc_id": doc, "no": range(len(parts)), "text": parts})

    def joined(group: pd.DataFrame) -> Part:
        parts = [
            Part(r.text, np.frombuffer(r.ids, "<u4"), np.frombuffer(r.begins, np.int64), np.frombuffer(r.ends, np.int64))
            for r in group.sort_values("no").itertuples()
        ]
        return Joiner(encoder_of(tokenizer)).tree(parts)

    def together(group: pd.DataFrame) -> pd.DataFrame:
        out = group[["row", "doc_id", "no"]].iloc[:1]
        return _row(out.assign(no=out["no"] // FAN), [joined(group)])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        ids = joined(group).ids
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].astype("Int64"), "ids": [ids.tobytes()], "decoded": [encoder_of(tokenizer).decode(ids)]})

    small = rows.where(F.length("text") <= long).mapInPandas(short, schema)
    cut = rows.where(F.length("text") > long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    most = rows.agg(F.max(F.length("text"))).first()[0] or 0
    part = "row long, doc_id long, no int, text string, ids binary, begins binary, ends binary"
    cut = cut.mapInPandas(pieces, "row long, doc_id long, no int, text string")
    cut = cut.repartition("row", "no").mapInPandas(leaves, part)
    count = -(-most // piece)
    while count > FAN:  # as many rounds as the tree of the longest text has levels
        cut = cut.groupBy("row", F.floor(F.col("no") / FAN)).applyInPandas(together, part)
        count = -(-count // FAN)
    return small.unionByName(cut.groupBy("row").applyInPandas(whole, schema))


def _row(keys: pd.DataFrame, parts: list[Part]) -> pd.DataFrame:
    values = {c: [getattr(p, c).tobytes() for p in parts] for c in ("ids", "begins", "ends")}
    return keys.assign(doc_id=keys["doc_id"].astype("Int64"), text=[p.text for p in parts], **values)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
