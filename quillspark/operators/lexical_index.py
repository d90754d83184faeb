"""An inverted index of the words of a document with counts, in which many questions or steps are scored.

A question's token counts wherever it stands in a text, inside longer words, too. A token is a run of letters, of digits
or of CJK characters, so each of its places lies inside one run of the text: the index holds runs with their
counts, and a token is looked for in the distinct runs only. The index of a document is built where its units and texts
meet, and only found chunks leave it.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quillspark.functions import text as tx

_RUN = re.compile(rf"[a-z]+|[0-9]+|[{tx.CJK}]+")


#: Characters of documents that are scored at once, and entries of lists that are held at once.
BATCH, ENTRIES = 200_000, 1_000_000


def _begins(lengths) -> np.ndarray:
    """Where lists of these lengths begin, one behind the other, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _spread(begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begins[i] .. begins[i] + n[i] - 1 of all i, one behind the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begins, n)


def _parts(costs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items whose costs sum up to ENTRIES at most, or of one item."""
    ends, c = np.cumsum(costs), 0
    while c < len(costs):
        d = max(c + 1, int(np.searchsorted(ends, (ends[c - 1] if c else 0) + ENTRIES, "right")))
        yield c, d
        c = d


#: An odd factor and its inverse modulo 2 ** 64, and their powers as far as they were needed.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _POWERS[base] = np.cumprod(factors)
    return _POWERS[base][:n]


class _Words:
    """Words of documents, their characters one behind the other, with sums by which pieces are hashed."""

    def __init__(self, words: list[str], docs: np.ndarray):
        self.docs, self.sizes = docs, np.fromiter(map(len, words), np.int64, len(words))
        self.begins = _begins(self.sizes)
        self.chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sums = np.zeros(len(self.chars) + 1, np.uint64)
        np.cumsum((self.chars + np.uint64(1)) * _powers(_BASE, len(self.chars)), out=self.sums[1:])

    def hashed(self, at: np.ndarray, size: int, docs: np.ndarray) -> np.ndarray:
        """Hashes of the pieces of one size that begin there, with their documents."""
        return (self.sums[at + size] - self.sums[at]) * _powers(_INVERSE, len(self.chars))[at] + docs.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _places(runs: _Words, tokens: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(run, token), sorted by token: each place of a document's distinct token in its distinct runs, from the left without overlaps.

    All pieces of the runs that are as long as some token are looked up by a hash at once, and compared where it is equal.
    """
    run = np.repeat(np.arange(len(runs.sizes)), runs.sizes)
    at, where, which = np.arange(len(run)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.flatnonzero(np.bincount(tokens.sizes)).tolist():
        at = at[runs.begins[run[at] + 1] - at >= size]
        asked = np.flatnonzero(tokens.sizes == size)
        keys = tokens.hashed(tokens.begins[asked], size, tokens.docs[asked])
        by = np.argsort(keys)
        asked, keys = asked[by], keys[by]
        pieces = runs.hashed(at, size, runs.docs[run[at]])
        first = np.searchsorted(keys, pieces)
        equal_keys = int(np.unique(keys, return_counts=True)[1].max()) if (keys[1:] == keys[:-1]).any() else 1
        for shift in range(equal_keys):
            found = np.minimum(first + shift, len(keys) - 1)
            hit = np.flatnonzero(keys[found] == pieces)
            place, token = at[hit], asked[found[hit]]
            same = runs.docs[run[place]] == tokens.docs[token]
            for i in range(size):
                same &= runs.chars[place + i] == tokens.chars[tokens.begins[token] + i]
            where.append(place[same])
            which.append(token[same])
    place, token = np.concatenate(where), np.concatenate(which)
    by = np.lexsort((place, token))
    place, token = place[by], token[by]
    # where two places of a token overlap, the token's places are taken one by one
    near = np.flatnonzero((token[1:] == token[:-1]) & (run[place[1:]] == run[place[:-1]]) & (place[1:] - place[:-1] < tokens.sizes[token[1:]]))
    if len(near):
        keep = np.ones(len(place), bool)
        for i in (near + 1).tolist():
            last = i - 1 if keep[i - 1] else kept
            keep[i] = place[i] - place[last] >= tokens.sizes[token[i]]
            kept = i if keep[i] else last
        place, token = place[keep], token[keep]
    return run[place], token


def _numbered(lists: list[list[str]], docs: list[int]) -> tuple[_Words, np.ndarray]:
    """The distinct words of each document, and for all words of the lists, whose documents follow each other, their numbers."""
    words: list[str] = []
    of: list[int] = []
    numbers: list[int] = []
    for doc, own in itertools.groupby(zip(docs, lists, strict=True), key=lambda x: x[0]):
        held = [x for _, x in own]
        known = dict.fromkeys(itertools.chain.from_iterable(held))
        at = dict(zip(known, range(len(words), len(words) + len(known)), strict=True))
        numbers += map(at.__getitem__, itertools.chain.from_iterable(held))
        words += known
        of += [doc] * len(known)
    return _Words(words, np.array(of, np.int64)), np.array(numbers, np.int64)


def _tenths(texts: list[list[str]], tokens: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the lower-cased texts of its document that hold it, and what it adds there, in tenths; through the distinct runs of the texts.

    Those of token i are at begins[i] to begins[i + 1] of the other two.
    """
    found = [_RUN.findall(text) for own in texts for text in own]
    runs, run = _numbered(found, [d for d, own in enumerate(texts) for _ in own])
    # each text of a run, numbered in its document, as often as the run stands there
    local = np.repeat(np.concatenate([np.arange(len(own)) for own in texts]), [len(f) for f in found])[np.argsort(run, kind="stable")]
    times = np.bincount(run, minlength=len(runs.sizes))
    lists = _begins(times)
    hit, of = _places(runs, tokens)
    width = np.array([len(own) for own in texts], np.int64)[tokens.docs]
    cell, first = _begins(width), _begins(np.bincount(of, minlength=len(width)))
    held, adds, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c, d in _parts(width + np.bincount(of, times[hit], len(width)).astype(np.int64)):
        runs_of, token = hit[first[c] : first[d]], of[first[c] : first[d]]
        met = np.bincount(np.repeat(cell[token] - cell[c], times[runs_of]) + local[_spread(lists[runs_of], times[runs_of])], minlength=cell[d] - cell[c])
        some = np.flatnonzero(met)
        token = np.searchsorted(cell, some + cell[c], "right") - 1
        held.append(some + cell[c] - cell[token])
        adds.append(10 + 3 * np.minimum(5, met[some]))
        lengths.append(np.bincount(token - c, minlength=d - c))
    return _begins(np.concatenate(lengths)), np.concatenate(held), np.concatenate(adds)


def _scores(units: list[list[dict]], texts: list[list[str]]) -> Iterator[tuple[list[dict], np.ndarray, np.ndarray]]:
    """Units (tokens, whole) of documents with texts, a few at a time, with the tenths of their scores in all texts of the unit's document.

    Those of the i-th of the units are at begins[i] to begins[i + 1], the second of the results.
    """
    all_units, docs = [u for own in units for u in own], [d for d, own in enumerate(units) for _ in own]
    tokens, asked = _numbered([u["tokens"] for u in all_units], docs)
    begins, held, adds = _tenths(texts, tokens)
    width = np.array([len(texts[d]) for d in docs], np.int64)
    n = (begins[1:] - begins[:-1])[asked]
    first, cell = _begins([len(u["tokens"]) for u in all_units]), _begins(width)
    for c, d in _parts(width + np.diff(_begins(n)[first])):
        lists, some = asked[first[c] : first[d]], n[first[c] : first[d]]
        row = np.repeat(np.repeat(cell[c:d] - cell[c], first[c + 1 : d + 1] - first[c:d]), some)
        at = _spread(begins[lists], some)
        tenths = np.bincount(row + held[at], adds[at], cell[d] - cell[c]).astype(np.int64)
        for i in range(c, d):
            unit = all_units[i]
            if not unit["tokens"] and unit["whole"]:
                times = np.array([t.count(unit["whole"]) for t in texts[docs[i]]], np.int64)
                tenths[cell[i] - cell[c] : cell[i + 1] - cell[c]] = np.where(times > 0, 10 + 3 * np.minimum(5, times), 0)
        yield all_units[c:d], cell[c : d + 1] - cell[c], tenths


def _best(begins: np.ndarray, tenths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values), `most` columns: the highest values of each list, the first of equal ones first; values are 0 where there are no more."""
    wide = int(np.diff(begins).max()) + 1
    column = np.arange(len(tenths)) - np.repeat(begins[:-1], np.diff(begins))
    left = np.where(tenths > 0, tenths * wide + wide - 1 - column, 0)
    places, values = [], []
    for _ in range(most):
        high = np.maximum.reduceat(left, begins[:-1])
        some = np.flatnonzero(high)
        places.append(wide - 1 - high % wide)
        values.append(high // wide)
        left[begins[some] + places[-1][some]] = 0
    return np.array(places).T, np.array(values).T


def _per_document(units: DataFrame, chunks: DataFrame, by: str, best: int | None, schema: str) -> DataFrame:
    """Chunks with scores of each unit, all or the best few, found document by document: units and texts are shuffled once, pairs of them never."""
    key = F.col(by).cast("string").alias("by")
    # tokens hold no blanks, and one string is read much faster than a list
    asked = units.select(key, "unit_id", F.array_join(tx.tokens(F.coalesce("query", F.lit(""))), " ").alias("tokens"), F.lower(F.trim(F.coalesce("query", F.lit("")))).alias("whole"))
    texts = chunks.where(F.col(by).isNotNull()).select(key, "chunk_id", *(["pos"] if best else []), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    names = [c.split()[0] for c in schema.split(", ")]

    def scored(documents: list[tuple[list[dict], list[dict]]]) -> Iterator[tuple]:
        for own, held in documents:
            ids = [r["chunk_id"] for r in held]
            for u in own:
                u["ids"] = ids
        for part, begins, tenths in _scores([own for own, _ in documents], [[r["low"] for r in held] for _, held in documents]):
            if best:
                for unit, places, values in zip(part, *(x.tolist() for x in _best(begins, tenths, best)), strict=True):
                    yield unit["unit_id"], [unit["ids"][p] for p, v in zip(places, values, strict=True) if v], values[0] / 10 if values[0] else None, not unit["whole"]
            else:
                some = np.flatnonzero(tenths)
                of = np.searchsorted(begins, some, "right") - 1
                yield from ((part[i]["unit_id"], part[i]["ids"][c], x / 10) for i, c, x in zip(of.tolist(), (some - begins[of]).tolist(), tenths[some].tolist(), strict=True))

    def found(rows: Iterator[dict]) -> Iterator[tuple]:
        """Of all rows, sorted by document; documents are scored many at once, as each call has a cost of its own."""
        documents, n = [], 0
        for _, rows_of in itertools.groupby(rows, key=lambda r: r["by"]):
            own, held = [], []
            for r in rows_of:
                if r["tokens"] is None:
                    held.append(r)
                else:
                    own.append(r | {"tokens": r["tokens"].split()})
            if not held:
                yield from ((u["unit_id"], [], None, not u["whole"]) for u in own if best)
            elif own:
                if best:
                    held.sort(key=lambda r: (r["pos"], r["chunk_id"]))
                documents.append((own, held))
                n += sum(len(r["low"]) for r in held) + sum(len(u["whole"]) for u in own)
                if n >= BATCH:
                    yield from scored(documents)
                    documents, n = [], 0
        if documents:
            yield from scored(documents)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = found(r for b in batches for r in b.to_pylist())
        while some := list(itertools.islice(out, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema.replace(", ", ",")).fields]
    # over all partitions of the session, not over fewer by their bytes: few bytes are much work here
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = asked.unionByName(texts, allowMissingColumns=True).repartition(n, "by").sortWithinPartitions("by")
    return both.mapInArrow(score, schema)


def lexical_scores(units: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """STR-17 for many questions: (unit_id, chunk_id, score) of units (unit_id, by, query) and chunks (chunk_id, by, text) of the same `by`.

    A token, each time the question has it, adds 1 + 0.3 min(5, its places in the text) where it has any. A question without
    tokens counts as a whole, lower-cased and trimmed. Scores of 0 are left out.
    """
    schema = f"unit_id {units.schema['unit_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    return _per_document(units, chunks, by, None, schema)


def lexical_evidence(units: DataFrame, chunks: DataFrame, by: str, most: int = 2, least: float = 2.0) -> DataFrame:
    """EXT-05: (unit_id, chunk_ids, score, weak) of every unit (unit_id, by, query); chunks: (chunk_id, by, pos, text).

    The best chunks of the unit's document, ties in their order there. Weak where none was found or the best score is under
    `least`; a blank question has no chunks and is not weak.
    """
    schema = f"unit_id {units.schema['unit_id'].dataType.simpleString()}, chunk_ids array<{chunks.schema['chunk_id'].dataType.simpleString()}>, score double, blank boolean"
    found = _per_document(units, chunks, by, most, schema)
    return found.select("unit_id", "chunk_ids", "score", (~F.col("blank") & (F.coalesce("score", F.lit(0.0)) < least)).alias("weak"))


def claim_evidence(claims: DataFrame, chunks: DataFrame, picked: DataFrame, by: str, most: int = 2) -> DataFrame:
    """EXT-05 for claims: picks (unit_id, chunk_ids, weak) of a model stay; a claim without any takes its best two chunks and is weak."""
    found = lexical_evidence(claims, chunks, by, max(1, min(2, most)))
    out = found.select("unit_id", F.col("chunk_ids").alias("lexical")).join(picked.select("unit_id", F.col("chunk_ids").alias("own"), F.col("weak").alias("own_weak")), "unit_id", "left")
    has = F.size(F.coalesce("own", F.array().cast("array<string>"))) > 0
    ids = F.when(has, F.slice("own", 1, max(1, most))).otherwise(F.col("lexical"))
    weak = F.when(has | (F.size("lexical") == 0), F.coalesce("own_weak", F.lit(False))).otherwise(True)
    return out.select("unit_id", ids.alias("chunk_ids"), weak.alias("weak"))
