"""Best-fit packing of tokenized documents into sequences, by exact complements.

The lengths of all pieces form a histogram with one class for each length, at most `size` of
them whatever the corpus. The plan is made on that histogram: going down from the longest, the gap
that a piece leaves is filled exactly by one, two or three further lengths whose sum it is, as
often as their counts allow; what is left is packed best-fit, longest first. Each step uses up
a length, so the plan has few patterns. Pieces find their place by their rank among
those of their length; ranks come from salted groups of about PER_SALT pieces, as many for a
length as it has pieces for, so that no length meets in one task.

Defined results: a null text is empty (one end-of-document id); rows are packed each on its
own, ids null or repeated or not; an empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._encode import encoder_of
from quillspark.session import materialize

SIZE = 2048
#: Pieces of one length that are ranked in one group; the driver holds a count for each group.
PER_SALT = 50_000
#: A length of fewer pieces has up to so many groups, too.
SALTS = 64


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids with end_id behind; the first piece takes the rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                raw = encoder.ids(text or "").tobytes() + end
                total = len(raw) // 4
                start = 0
                for k in range(-(-total // size)):
                    length = (total - 1) % size + 1 if k == 0 else size
                    out.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    start += length
            doc_ids, *rest = zip(*out, strict=True) if out else [()] * 5
            yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64")} | dict(zip(("piece", "start", "length", "ids_crc32"), rest, strict=True)))

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Where the piece of rank r among those of its length goes: key = length << 44 | first rank, sorted."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


class Complements:
    """Combinations of one, two or three lengths by their sum, consumed under the lengths' counts.

    Pairs lie in one array by sum, the most unequal of a sum last, and each sum has a cursor. Counts only fall, so a pair that lacks a
    length is passed for good. A triple of a sum is a length and a pair of the rest: its sum has a cursor over the lengths, which
    passes a length for good, too, once no pair completes it.
    """

    def __init__(self, have: np.ndarray) -> None:
        self.have, size = have, len(have) - 1
        held = np.flatnonzero(have[1:]) + 1
        shorter = [held[: np.searchsorted(held, min(x, size - x), "right")] for x in held]
        x = np.repeat(held, [len(y) for y in shorter])
        y = np.concatenate([*shorter, np.empty(0, np.int64)]).astype(np.int64)
        by = np.lexsort((x, x + y))
        self.longer, sums = x[by], (x + y)[by]
        ends = np.searchsorted(sums, np.arange(size + 2))
        self.first, self.next = ends[:-1].tolist(), ends[1:].tolist()  # the pairs of a sum; next is behind its best one
        self.triple = [size] * (size + 1)

    def pair(self, total: int, without: int = 0) -> tuple[int, int] | None:
        """The most unequal available pair of this sum, with one piece of length `without` set aside."""
        if total < 2:
            return None
        at, have = self.next[total] - 1, self.have
        while at >= self.first[total]:
            x = int(self.longer[at])
            y = total - x
            if have[x] < 1 + (x == y) or not have[y]:
                if at == self.next[total] - 1:
                    self.next[total] = at
            elif have[x] - (x == without) >= 1 + (x == y) and have[y] - (y == without) >= 1:
                return x, y
            at -= 1
        return None

    def of(self, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill a gap exactly: one, else two, else three."""
        if self.have[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        x = min(self.triple[gap], gap - 2)
        while x > 0:
            if self.have[x] and (found := self.pair(gap - x, x)):
                break
            x -= 1
        self.triple[gap] = x
        return (x, *found) if x > 0 else None


def make_plan(counts: np.ndarray, size: int = SIZE) -> Plan:
    """counts[l]: the number of pieces of length l, 1 to size."""
    have = counts.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...]) -> None:
        values, times = np.unique(parts, return_counts=True)
        n = int((have[values] // times).min())
        have[values] -= n * times
        patterns.append((parts, n))

    index = Complements(have)
    for a in range(size, 0, -1):
        while have[a]:
            have[a] -= 1
            rest = () if a == size else index.of(size - a)
            have[a] += 1
            if rest is None:
                break
            use((a, *rest))
    for a in range(size, 0, -1):
        while have[a]:
            parts, gap = [a], size - a
            have[a] -= 1
            while gap and len(fits := np.flatnonzero(have[: gap + 1])):
                n = min(int(have[fits[-1]]), gap // int(fits[-1]))
                have[fits[-1]] -= n
                parts += [int(fits[-1])] * n
                gap -= n * int(fits[-1])
            np.add.at(have, parts, 1)
            use(tuple(parts))
    taken, rows, first = np.zeros(size + 1, np.int64), [], 0
    for parts, n in patterns:
        offset = 0
        for length in parts:
            rows.append((length << 44 | int(taken[length]), first, offset))
            taken[length] += n
            offset += length
        first += n
    key, sequence, offsets = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return Plan(key, sequence, offsets, first)


def pack(found: DataFrame, size: int = SIZE, per_salt: int = PER_SALT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    found = materialize(found)
    counts = np.zeros(size + 1, np.int64)
    for length, n in found.groupBy("length").agg(F.count("*")).collect():  # size rows at most
        counts[length] = n
    salts = np.maximum(np.clip(-(-counts // 256), 1, SALTS), -(-counts // per_salt))
    of = F.element_at(F.lit(salts.tolist()), (F.col("length") + 1).cast("int"))
    # rows of the checkpoint have fixed numbers, so that even equal rows spread
    salted = found.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), of).cast("int"))
    first = np.concatenate([[0], np.cumsum(salts)])  # place of each length's salts in one list
    held = np.zeros(first[-1], np.int64)
    for length, salt, n in salted.groupBy("length", "salt").agg(F.count("*")).collect():  # size rows, and one for every per_salt pieces
        held[first[length] + salt] = n
    plan = make_plan(counts, size)
    before = np.cumsum(held) - held
    before -= np.repeat(before[first[:-1]], salts)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["length"].to_numpy()
            rank = before[first[length] + b["salt"].to_numpy()] + b["rank"].to_numpy() - 1
            key = length << 44 | rank
            at = np.searchsorted(plan.key, key, "right") - 1
            b["sequence_id"] = plan.sequence[at] + key - plan.key[at]
            b["offset"] = plan.offset[at]
            yield b.drop(columns=["salt", "rank"])

    names = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(place, names)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
