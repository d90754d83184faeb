"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each text's set of word shingles is hashed once; its SKETCH least hashes are its sketch.
   Documents with equal sets form one class, so copies are never paired.
2. Inverted lists of the sketch values generate candidates. A pair at the threshold shares so many
   values that one of them is among the rarest of both sketches; only those are listed. Where a
   value is held by at most COLD classes, all of them meet. A longer list first meets its
   leaders: for each band of set sizes LEADERS different classes with common values.
3. The sketch of the union estimates the similarity; pairs far below the threshold go.
4. The remaining pairs are confirmed on the full sets, and components of the links are taken.
5. Members of long lists meet once more through the rarest values of their full sets, which finds every
   further link: a pair at the threshold shares one of them, and what many have in common, such as a
   template, is not among them. Members of different components that still share a
   long list there meet block by block, on the full sets; this alone is more than linear.

A class is known by its key, the hash of its set, and its component by the least key in it.

Defined results: a text without words (or null) has an empty set and links with nothing; a text
with fewer than `words` words is one shingle; rows with equal doc_id are handled each on its own;
rows without doc_id take no part; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shingles import mix, shingle_sets
from quillspark.operators.components import connected_components
from quillspark.session import materialize

SKETCH = 64
COLD = 32
LEADERS = 8
#: How far an estimate from SKETCH values may lie under the threshold: five standard deviations.
MARGIN = 0.25
#: Members of a long list that meet in one task.
BLOCK = 256
#: Up to so many ids (8 bytes each) go to every task; beyond that they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _set_key(s: np.ndarray) -> int:
    return int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n, key, sketch array<long>) of each row; equal sets have equal n and key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = shingle_sets(b["text"].tolist(), words)
            rows = [(len(s), _set_key(s), s[:SKETCH].view(np.int64)) for s in sets]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n": [r[0] for r in rows], "key": [r[1] for r in rows], "sketch": [r[2] for r in rows]})

    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, n long, key long, sketch array<long>")


def _band(percent: int) -> Column:
    """Sizes that can reach the similarity are in the same or in adjacent bands."""
    return F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-6)).cast("int")


def prefix_lists(classes: DataFrame, percent: int, size: int | None = SKETCH) -> DataFrame:
    """(value, rep, n, df, common, band): the rarest sketch values of each class (rep, n, sketch), where another class has them too.

    A pair at the threshold shares `need` values of either sketch at least, so of each sketch sorted by
    rarity all but need - 1 values are enough for the two to meet. Without a size sketches are whole sets.
    """
    held_of = F.col("n") if size is None else F.least("n", F.lit(size))
    lists = classes.select("rep", "n", F.explode("sketch").alias("value"))
    held = lists.groupBy("value").agg(F.count("*").alias("held")).where("held > 1")
    shared = lists.join(held, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("values"))
    # up to this size a set and all that are near it are whole in their sketches
    whole = F.ceil(F.col("n") * percent / 100)
    need = whole if size is None else F.when(F.col("n") * 100 <= percent * size, whole).otherwise(F.ceil(held_of * (percent / 100 - MARGIN)))
    # values of one class come first in the order and can meet nothing
    places = (F.greatest(F.lit(1), held_of - need + 1) - (held_of - F.size("values"))).cast("int")
    first = shared.withColumns({"places": places, "common": F.round(F.expr("aggregate(values, 0D, (s, x) -> s + ln(x.held))"), 3)}).where("places > 0")
    first = first.select("rep", "n", "common", _band(percent).alias("band"), F.explode(F.slice("values", F.lit(1), F.col("places"))).alias("v"))
    first = materialize(first.select("v.value", "rep", "n", "common", "band"))
    return materialize(first.join(first.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "value"))


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: classes that meet in a list of at most COLD, and those of longer lists with the leaders."""
    few = lists.where(F.col("df") <= COLD)
    a, b = (few.select("value", F.col("rep").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    rare = a.join(b, "value").where("a < b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")

    many = lists.where(F.col("df") > COLD)
    part = F.pmod(F.xxhash64("rep"), F.lit(LEADERS))
    # one leader of each part, so that no two are the same
    leaders = many.groupBy("value", "band").agg(*[F.max(F.when(part == i, F.struct("common", "rep", "n"))).alias(f"l{i}") for i in range(LEADERS)])
    tops = F.array_compact(F.array(*[F.when(F.col(f"l{i}").isNotNull(), F.struct(f"l{i}.rep", f"l{i}.n")) for i in range(LEADERS)]))
    # a value has as many entries as there are bands of sizes, whatever its list
    heads = leaders.select("value", "band", tops.alias("tops")).groupBy("value").agg(F.collect_list(F.struct("band", "tops")).alias("heads"))
    fits = f"""filter(flatten(transform(filter(heads, h -> abs(h.band - band) <= 1), h -> h.tops)),
      t -> t.rep != rep and 100 * least(t.n, n) >= {percent} * greatest(t.n, n))"""
    # a class meets the same few leaders in most of its lists, so they are united for each class before they are paired
    led = many.join(heads, "value").select("rep", F.expr(fits).alias("found")).where(F.size("found") > 0)
    led = led.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    led = led.select(F.explode("found.rep").alias("a"), F.col("rep").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return rare.unionByName(led).distinct()


def full_sets(docs: DataFrame, ends: DataFrame, words: int) -> DataFrame:
    """(rep, full): the whole sets, as bytes, of the classes in ends (doc_id, rep)."""
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    few = ends.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ends) if few else ends, "doc_id")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(shingle_sets(b["text"].tolist(), words))
            same = [_set_key(s) == k for s, k in zip(found, b["rep"], strict=True)]
            if any(same):
                yield pd.DataFrame({"rep": b["rep"][same], "full": [s.tobytes() for s, x in zip(found, same, strict=True) if x]})

    # where rows repeat, their set is held once
    return wanted.mapInPandas(sets, "rep long, full binary").groupBy("rep").agg(F.first("full").alias("full"))


def links(docs: DataFrame, classes: DataFrame, lists: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): candidate classes (rep, first, n, sketch) whose full sets reach the similarity."""
    pairs = candidates(lists, percent)
    own = {x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("first").alias(f"first_{x}")) for x in "ab"}
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
    share = F.size(F.array_intersect(F.array_intersect(union, F.col("s_a")), F.col("s_b"))) / F.size(union)
    near = materialize(pairs.join(own["a"], "a").join(own["b"], "b").where(share >= percent / 100 - MARGIN).select("a", "b", "first_a", "first_b"))
    ends = near.select(F.explode(F.expr("array(struct(first_a as doc_id, a as rep), struct(first_b as doc_id, b as rep))")).alias("e")).select("e.*").distinct()
    full = full_sets(docs, ends, words)
    return confirmed(near, full, percent)


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): those of pairs whose full sets (rep, full) reach the similarity."""
    full_a, full_b = (full.select(F.col("rep").alias(x), F.col("full").alias(f"full_{x}")) for x in "ab")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for x, y in zip(p["full_a"], p["full_b"], strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield p.loc[ok, ["a", "b"]]

    return pairs.select("a", "b").join(full_a, "a").join(full_b, "b").mapInPandas(confirm, "a long, b long")


def _whole_sets(full: DataFrame) -> DataFrame:
    """(rep, n, sketch): the sets (rep, full) as arrays, for prefix_lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.frombuffer(x, np.int64) for x in b["full"]]
            yield pd.DataFrame({"rep": b["rep"], "n": [len(s) for s in sets], "sketch": sets})

    return full.mapInPandas(run, "rep long, n long, sketch array<long>")


def rest_links(docs: DataFrame, classes: DataFrame, lists: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): components of found (node, component) with a link between members of long lists; a class in none is its own.

    Members meet anew through the rarest values of their full sets, which is exact: what many share, such as a template, is
    not among those. Pairs of short lists are confirmed one by one, pairs inside a component left out.
    """
    hot = lists.where(F.col("df") > COLD).select("rep").distinct().join(classes.select("rep", "n", "first"), "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    hot = materialize(hot.select("rep", "n", "first", F.coalesce("component", "rep").alias("component")))
    full = materialize(full_sets(docs, hot.select(F.col("first").alias("doc_id"), "rep"), words))
    exact = prefix_lists(_whole_sets(full), percent, None).join(hot.select("rep", "component"), "rep")
    # a list whose members are linked already has nothing to add
    mixed = exact.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("value")
    exact = materialize(exact.join(mixed, "value"))
    few = exact.where(F.col("df") <= COLD)
    a, b = (few.select("value", F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}")) for x in "ab")
    near = a.join(b, "value").where("a < b and c_a != c_b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "c_a", "c_b").distinct()
    ok = confirmed(near, full, percent).join(near, ["a", "b"]).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    if not exact.where(F.col("df") > COLD).limit(1).count():
        return ok
    return ok.unionByName(block_links(exact.where(F.col("df") > COLD), hot, full, percent))


def block_links(many: DataFrame, hot: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): linked components of the members of long lists many (value, rep) of the rarest values of full sets.

    Such lists that share members are one cluster. Its members meet in blocks of about BLOCK, each pair of
    blocks in a task; members of one component, and bands of sizes too far apart, do not meet.
    """
    many = many.select("value", "rep")
    least = many.groupBy("rep").agg(F.min("value").alias("least"), F.first("value").alias("value"))
    united = connected_components(many.join(least.select("rep", "least"), "rep").select(F.col("value").alias("a"), F.col("least").alias("b")))
    cluster = least.join(united, least["value"] == united["node"], "left").select("rep", F.coalesce("component", "value").alias("cluster"))
    hot = materialize(cluster.join(hot, "rep").select("cluster", "rep", _band(percent).alias("band"), "component"))
    # a component that fills blocks gets its own, and those need not meet one another
    large = hot.groupBy("cluster", "component").agg(F.count("*").alias("members")).where(F.col("members") >= BLOCK).select("cluster", "component", F.col("component").alias("own"))
    hot = hot.join(large, ["cluster", "component"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    sizes = hot.groupBy("cluster", "own", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    keys = ["cluster", "own", "band"]
    hot = hot.join(sizes, keys).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    blocks = sizes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"))
    side = {x: blocks.select("cluster", F.struct("own", "band", "salt").alias(x)) for x in "ij"}
    meet = side["i"].join(side["j"], "cluster").where("i <= j and abs(i.band - j.band) <= 1 and (i.own != j.own or i.own = -1)")
    meet = materialize(meet.select("cluster", "i", "j"))
    places = meet.select("cluster", F.col("i").alias("at"), "i", "j", F.lit(0).alias("side"))
    places = places.unionByName(meet.where("i != j").select("cluster", F.col("j").alias("at"), "i", "j", F.lit(1).alias("side")))
    wanted = hot.select("cluster", F.struct("own", "band", "salt").alias("at"), "rep", "component").join(places.select("cluster", "at").distinct(), ["cluster", "at"])
    rows = wanted.join(full, "rep").join(places, ["cluster", "at"]).select("cluster", "i", "j", "side", "component", "full")

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        left = p[p["side"] == 0]
        right = p[p["side"] == 1] if (p["i"].iloc[0] != p["j"].iloc[0]) else left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        held = [np.frombuffer(x, np.uint64) for x in right["full"]]
        n = np.array([len(x) for x in held])
        values, owner = np.concatenate(held), np.repeat(np.arange(len(held)), n)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        parts = right["component"].to_numpy()
        out = []
        for component, x in zip(left["component"], left["full"], strict=True):
            s = np.frombuffer(x, np.uint64)
            low, high = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            count = high - low
            at = np.repeat(high - np.cumsum(count), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(held))
            ok = np.flatnonzero((100 * both >= percent * (len(s) + n - both)) & (parts != component))
            # one link to each component is enough
            out += [(component, other) for other in np.unique(parts[ok])]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()

    return rows.groupBy("cluster", "i", "j").applyInPandas(solve, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, component, text_hash) for every row of docs (doc_id long, text).

    component is that of the row's class (null for an empty set), text_hash the xxhash64 of the row's text.
    """
    marked = materialize(sketches(docs, words))
    classes = materialize(
        marked.where("n > 0").groupBy("n", "key").agg(F.min("doc_id").alias("first"), F.min_by("sketch", "doc_id").alias("sketch")).withColumnRenamed("key", "rep")
    )
    lists = prefix_lists(classes, percent)
    linked = materialize(links(docs, classes, lists, words, percent))
    found = connected_components(linked)
    if lists.where(F.col("df") > COLD).limit(1).count():
        found = materialize(found)
        more = materialize(connected_components(rest_links(docs, classes, lists, found, words, percent)))
        again = more.select(F.col("node").alias("component"), F.col("component").alias("united"))
        alone = more.join(found, "node", "left_anti")  # in no link before
        found = found.join(again, "component", "left").select("node", F.coalesce("united", "component").alias("component")).unionByName(alone.select("node", "component"))
    named = classes.select("n", "rep", "first").join(found, F.col("rep") == F.col("node"), "left").select("n", "rep", "first", F.coalesce("component", "rep").alias("component"))
    named = materialize(named)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("n", F.col("rep").alias("key"), "component", "component_id")
    filled = marked.where("n > 0").select("doc_id", "text_hash", "n", "key").join(named, ["n", "key"]).drop("key")
    empty = marked.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    out = filled.unionByName(empty)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "component", "text_hash")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)
    return found.drop("component", "text_hash")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
keyed AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(1))) AS k, s FROM sets),
classes AS (SELECT min(doc_id) AS rep, n, k, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY n, k),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(u, v) AS (SELECT rep, rep FROM classes UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
least AS (SELECT u AS rep, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, d.n AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM keyed d LEFT JOIN classes c ON d.n = c.n AND d.k = c.k AND d.n > 0 LEFT JOIN least l ON l.rep = c.rep
"""
