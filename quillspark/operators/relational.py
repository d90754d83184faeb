"""Filters, lookups, joins and set operations over the domain tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import text as tx
from quillspark.session import materialize


def first_non_blank(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names])


def search(df: DataFrame, query: str, columns: list[str], limit: int, clamp: int = 200) -> DataFrame:
    """FIL-01: case-insensitive substring in any column; newest first, then id."""
    q = query.strip().lower()
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q) for c in columns])
    return df.where(hit).orderBy(F.desc("year"), "paper_id").limit(max(1, min(clamp, limit)))


def management_list(papers: DataFrame, membership: DataFrame) -> DataFrame:
    """FIL-02: papers with a display title and their collections, sorted."""
    nested = membership.groupBy("paper_id").agg(F.array_sort(F.collect_list("collection_id")).alias("collections"))
    return papers.join(nested, "paper_id", "left").select(
        "paper_id", first_non_blank("title", "paper_source", "paper_id").alias("display_title"), "year", F.coalesce("collections", F.array().cast("array<string>")).alias("collections")
    )


def uncategorised(papers: DataFrame, membership: DataFrame) -> DataFrame:
    """FIL-03: papers in no collection."""
    return papers.join(membership, "paper_id", "left_anti")


def in_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """FIL-04: rows whose key is listed, each once."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def candidate_chunks(chunks: DataFrame, excluded: list[str]) -> DataFrame:
    """FIL-07: neither headings nor blank, and under no section whose name, spaces and joiners removed or not, holds an excluded term."""
    tight = F.regexp_replace(F.lower(F.coalesce("section", F.lit(""))), r"[\s_\-:：]+", "")
    loose = F.lower(F.coalesce("section", F.lit("")))
    bad = reduce(lambda a, b: a | b, [tight.contains(t) | loose.contains(t) for t in excluded], F.lit(False))
    return chunks.where((F.col("kind") != "heading") & (F.trim("text") != "") & ~bad)


#: How captions begin.
CAPTION = r"(?i)^\s*(?:supplementary\s+)?(?:figure|fig\.?|table|scheme|图|表)\s*[0-9a-z]*\s*[.:|]"


def is_caption(text: Column, allowed: str | None = None) -> Column:
    """FIL-08: begins like a caption, unless an allowed term occurs."""
    hit = text.rlike(CAPTION)
    return hit & ~text.rlike(allowed) if allowed else hit


def batch_validated(claims: DataFrame, steps: list[str], kinds: list[str], most: int) -> DataFrame:
    """FIL-11: the first claims of each chunk, with a known step, known kinds and clamped confidence."""
    order = Window.partitionBy("chunk_id").orderBy("claim_id")
    kept = claims.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")
    kept = kept.where(F.col("step_type").isin(steps)).withColumn("kinds", F.array_intersect("kinds", F.array(*[F.lit(k) for k in kinds])))
    return kept.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))


def split_prefixed(ids: DataFrame, col: str = "id") -> DataFrame:
    """FIL-18: PREFIX:rest into one distinct, sorted bucket for each prefix."""
    parts = ids.select(F.split_part(F.col(col), F.lit(":"), F.lit(1)).alias("bucket"), F.expr(f"substring({col}, instr({col}, ':') + 1)").alias("rest")).where(F.col(col).contains(":"))
    return parts.groupBy("bucket").agg(F.array_sort(F.collect_set("rest")).alias("ids"))


def override_overlay(machine: DataFrame, human: DataFrame, key: str, value: str) -> DataFrame:
    """FIL-19/20: human text before machine text; cleared keys are empty; rows only a human wrote appear too."""
    m = machine.select(key, F.col(value).alias("machine"))
    h = human.select(key, F.col(value).alias("human"), "cleared")
    out = m.join(h, key, "full")
    chosen = F.when(F.coalesce("cleared", F.lit(False)), F.lit(None)).when(F.col("human").isNotNull(), F.col("human")).otherwise(F.col("machine"))
    source = F.when(F.coalesce("cleared", F.lit(False)), "cleared").when(F.col("human").isNotNull(), "human").otherwise("machine")
    return out.select(key, chosen.alias(value), source.alias("source"))


def citation_edges(mentions: DataFrame) -> DataFrame:
    """Weighted citation edges: mentions counted for each pair."""
    return mentions.groupBy("src", "dst").agg(F.count("*").alias("total_mentions"))


def neighbourhood(edges: DataFrame, centre: int) -> DataFrame:
    """SET-01: outgoing and incoming edges of a node, each once."""
    out = edges.where(F.col("src") == centre).select("src", "dst", "total_mentions")
    return out.union(edges.where(F.col("dst") == centre).select("src", "dst", "total_mentions")).distinct()


def cross_pairs_top(pairs: DataFrame, group: str, per_source: int, least: float) -> DataFrame:
    """JOIN-03: the best few targets of other papers for each source, from a least score on."""
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    kept = pairs.where((F.col("score") >= least) & (F.col(f"{group}_a") != F.col(f"{group}_b")))
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_source)


#: Steps whose vectors over the entities are multiplied at once with those of as many others; blocks that a step is sent to,
#: until one of them holds the most entries of steps.
STEP_BLOCK = 2048
STEP_SHARES, MOST_ENTRIES = 8, 4_000_000


class _Steps:
    """Steps with their entities and scores, one step's behind the other's."""

    def __init__(self, rows: pa.Table):
        lists = [rows[c].combine_chunks() for c in ("entity_id", "score")]
        self.ids, self.papers = (rows[c].to_numpy() for c in ("step_id", "paper_id"))
        self.begins = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.entities, self.scores = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)

    def held(self, c: int, d: int) -> np.ndarray:
        return np.unique(self.entities[self.begins[c] : self.begins[d]])

    def dense(self, c: int, d: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of steps c to d over these entities: scores, where one is known, where the entity is there."""
        own = slice(self.begins[c], self.begins[d])
        at, entity, score = np.repeat(np.arange(d - c), np.diff(self.begins[c : d + 1])), self.entities[own], self.scores[own]
        inside = np.isin(entity, places)
        at, entity, score = at[inside], np.searchsorted(places, entity[inside]), score[inside]
        total, known, there = (np.zeros((d - c, len(places))) for _ in range(3))
        total[at, entity], known[at, entity], there[at, entity] = np.nan_to_num(score), ~np.isnan(score), 1
        return total, known, there


def _shared(left: _Steps, right: _Steps, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, score): pairs of steps of the two, or of one, that share an entity; `step` steps of either at once."""
    for c in range(0, len(left.ids), step):
        d = min(c + step, len(left.ids))
        mine, one = left.held(c, d), left.ids[c:d]
        for e in range(c if left is right else 0, len(right.ids), step):
            f = min(e + step, len(right.ids))
            places, two = np.intersect1d(mine, right.held(e, f), assume_unique=True), right.ids[e:f]
            total, pairs, shared = (np.zeros((d - c, f - e)) for _ in range(3))
            for p in range(0, len(places), 1024):
                (s, k, t), (z, l, u) = left.dense(c, d, places[p : p + 1024]), right.dense(e, f, places[p : p + 1024])
                total += s @ l.T + k @ z.T
                pairs += k @ l.T
                shared += t @ u.T
            able = (shared > 0) & (left.papers[c:d, None] != right.papers[None, e:f])
            able &= one[:, None] < two[None, :] if left is right and c == e else one[:, None] != two[None, :]
            i, j = np.nonzero(able)
            with np.errstate(invalid="ignore"):
                score = total[i, j] / pairs[i, j] / 2 + 0.05 * shared[i, j]
            first = one[i] < two[j]
            yield np.where(first, one[i], two[j]), np.where(first, two[j], one[i]), score


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        of = np.stack([b[k].to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            if c == d:
                continue
            if held and of[:, c].tolist() != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(c, d - c))
            last = of[:, c].tolist()
    if held:
        yield pa.Table.from_batches(held)


def shared_entity_edges(explains: DataFrame) -> DataFrame:
    """JOIN-04: steps of different papers that share an entity: half the mean of summed scores, plus 0.05 for each entity.

    explains has one row for each entity and step, and a step is of one paper. Blocks of steps meet inside tasks, so that
    no row for each entity of a pair is made. A step is sent once for each block, so blocks grow with the steps up to
    what a task can hold, and pairs leave the task a part of a block at a time.
    """
    vector = F.collect_list(F.struct("entity_id", "score"))
    steps = explains.where("entity_id is not null and step_id is not null and paper_id is not null").groupBy("step_id", "paper_id").agg(vector.alias("xs"))
    steps = materialize(steps.select("step_id", "paper_id", "xs.entity_id", F.transform("xs.score", lambda x: x.cast("double")).alias("score")))
    size = steps.agg(F.count("*").alias("steps"), F.sum(F.size("entity_id")).alias("entries")).first()
    blocks = max(1, min(-(-size["steps"] // STEP_BLOCK), STEP_SHARES), -(-(size["entries"] or 0) // MOST_ENTRIES))
    own = F.pmod(F.xxhash64("step_id"), F.lit(blocks))
    rows = steps.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    # more partitions than pairs of blocks, so that few of them get two
    rows = rows.repartition(min(2000, 2 * blocks * (blocks + 1)), "lo", "hi").sortWithinPartitions("lo", "hi")
    kind = explains.schema["step_id"].dataType
    step, fields = STEP_BLOCK, [to_arrow_type(kind), to_arrow_type(kind), pa.float64()]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _runs(batches, "lo", "hi"):
            lo, hi = (task[c][0].as_py() for c in ("lo", "hi"))
            left = _Steps(task.filter(pc.equal(task["block"], lo)))
            right = left if lo == hi else _Steps(task.filter(pc.equal(task["block"], hi)))
            for found in _shared(left, right, step):
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t, from_pandas=True) for x, t in zip(found, fields, strict=True)], ["a", "b", "score"])

    return rows.mapInArrow(products, f"a {kind.simpleString()}, b {kind.simpleString()}, score double")


def citation_pairs(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """JOIN-05: distinct pairs whose both ends are listed."""
    ids = papers.select("paper_id").distinct()
    inside = edges.join(ids, edges.src == ids.paper_id, "left_semi")
    return inside.join(ids, inside.dst == ids.paper_id, "left_semi").select("src", "dst").distinct()


def citation_boost(similar: DataFrame, pairs: DataFrame) -> DataFrame:
    """JOIN-06: similarity edges whose papers cite each other in either direction."""
    cited = pairs.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    marked = similar.withColumns({"lo": F.least("paper_a", "paper_b"), "hi": F.greatest("paper_a", "paper_b")})
    return marked.join(cited, ["lo", "hi"], "left_semi").drop("lo", "hi")


def first_match(left: DataFrame, right: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """JOIN-08: the first row of the right side for each key."""
    first = right.groupBy(key).agg(F.min_by(value, order).alias(value))
    return left.join(first, key)


def interval_join(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """JOIN-13: rows of points (grp, idx) inside spans (grp, a, b, span_id), a <= idx < b.

    Both sides meet on buckets of the index, so that the join is an equi join whatever the spans.
    """
    cut = spans.where("a < b").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    marked = points.withColumn("bucket", F.floor(F.col("idx") / width))
    return marked.join(cut, ["grp", "bucket"]).where("idx >= a and idx < b").drop("bucket")


def fill_by_first(rows: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """JOIN-14: a missing value is filled from the first row of the lookup."""
    first = lookup.groupBy(key).agg(F.min(F.struct("pos", value)).getField(value).alias("found"))
    return rows.join(first, key, "left").withColumn(value, F.coalesce(value, "found")).drop("found")


#: Sets compared at once of one large group, and of several small ones; blocks of a group that its sets are sent to, until one of them holds the most sets.
BLOCK, BIN = 8192, 2048
SHARES, MOST_SETS = 6, 1 << 17
#: Common words of sets that are counted at once.
COMMON = 2_000_000


def _meetings(frame: pd.DataFrame, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, shared): rows of a frame (block, lo, hi, words) whose sets share enough; those of block lo meet those of block hi."""
    words, block = frame["words"].to_numpy(), frame["block"].to_numpy()
    same = frame["lo"].iat[0] == frame["hi"].iat[0]
    left, right = (np.arange(len(frame)),) * 2 if same else (np.flatnonzero(block == frame["lo"].iat[0]), np.flatnonzero(block == frame["hi"].iat[0]))
    if not len(left) or not len(right):
        return
    sizes = np.array([len(words[j]) for j in right])
    held, place = np.unique(np.concatenate(words[right]), return_inverse=True)
    by = np.argsort(place, kind="stable")
    rows, ends = np.repeat(np.arange(len(right)), sizes)[by], np.cumsum(np.bincount(place, minlength=len(held)))
    begins = np.concatenate([[0], ends[:-1]])
    asked, row = np.concatenate(words[left]), np.repeat(np.arange(len(left)), [len(words[i]) for i in left])
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    known = held[at] == asked
    at, row = at[known], row[known]
    n = ends[at] - begins[at]
    common = np.cumsum(np.bincount(row, n, len(left)).astype(np.int64))
    first, c = np.searchsorted(row, np.arange(len(left) + 1)), 0
    while c < len(left):
        d = max(c + 1, int(np.searchsorted(common, (common[c - 1] if c else 0) + COMMON, "right")))
        part, own = left[c:d], slice(first[c], first[d])
        # the lists of all words asked for, one behind the other
        inside = np.arange(n[own].sum()) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        met = np.repeat(row[own] - c, n[own]) * len(right) + rows[np.repeat(begins[at[own]], n[own]) + inside]
        if len(met) * 4 > len(part) * len(right):
            met = np.bincount(met, minlength=len(part) * len(right))
            hit = np.flatnonzero(met >= least)
            shared = met[hit]
        else:  # few of them meet
            met.sort()
            new = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]])) if len(met) else np.zeros(0, np.int64)
            shared = np.diff(np.append(new, len(met)))
            hit, shared = met[new[shared >= least]], shared[shared >= least]
        i, j, c = part[hit // len(right)], right[hit % len(right)], d
        keep = i < j if same else slice(None)
        yield i[keep], j[keep], shared[keep]


def token_classes(claims: DataFrame, group: list[str], least_shared: int, tokens: Column, *sums: Column) -> DataFrame:
    """(group, words, cls, sums): the distinct token sets of each group that could share enough with another; tokens as 64-bit hashes with their group."""
    hashed = F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: F.xxhash64(*group, t))
    rows = claims.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])).withColumn("words", F.array_sort(F.array_distinct(hashed)))
    return rows.where(F.size("words") >= least_shared).groupBy(*group, "words").agg(*sums).withColumn("cls", F.xxhash64(*group, "words"))


def class_meetings(classes: DataFrame, group: list[str], least: int, found: Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, carried: list[str]) -> DataFrame:
    """What found(frame, i, j, shared) makes of the classes (group, words, cls) of one group that share enough, each two met once.

    A large group is cut into blocks, and a task compares two of them; small groups share a task. No pair is shuffled. A set is
    sent once for each block of its group, so blocks grow with the group up to what a task can hold.
    """
    blocks = F.greatest(F.least(F.ceil(F.col("n") / BLOCK), F.lit(SHARES)), F.ceil(F.col("n") / MOST_SETS))
    sizes = classes.groupBy(*group).agg(F.count("*").alias("n")).withColumn("k", blocks)
    total = sizes.agg(F.sum(F.when(F.col("k") == 1, F.col("n"))).alias("small"), F.sum(F.when(F.col("k") > 1, F.col("k") * (F.col("k") + 1) / 2)).alias("large")).first()
    bins = max(1, -(-(total["small"] or 0) // BIN))
    block = F.pmod("cls", F.col("k"))
    rows = classes.join(sizes, group).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rows = rows.withColumn("task", F.when(F.col("k") == 1, F.pmod(F.xxhash64(*group), F.lit(bins))).otherwise(F.xxhash64(*group, "lo", "hi")))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [found(frame, *met) for met in _meetings(frame, least)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    spread = rows.select("task", "block", "lo", "hi", "words", "cls", *carried).repartition(int(min(2000, bins + (total["large"] or 0))), "task")
    return spread.groupBy("task").applyInPandas(compare, schema)


def pairs_in_group(claims: DataFrame, group: list[str], least_shared: int, tokens: Column) -> DataFrame:
    """JOIN-18: pairs of one group that share enough topic tokens, at least one.

    Claims with equal token sets meet the others as one class, and classes meet block by block inside tasks; only found
    classes are spread out to their claims, large ones over many tasks.
    """
    rows = claims.select(*group, "claim_id", tokens.alias("_tokens"))
    classes = materialize(token_classes(rows, group, least_shared, F.col("_tokens"), F.collect_list("claim_id").alias("ids")))
    met = class_meetings(
        classes, group, least_shared, lambda f, i, j, n: pd.DataFrame({"x": f["cls"].to_numpy()[i], "y": f["cls"].to_numpy()[j], "shared": n}), "x long, y long, shared long", []
    )
    one = classes.select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.size("words").cast("long").alias("shared")).where(F.size("ids") > 1)
    # a class's claims in lists of a hundred, so that no task spreads out the square of a large class
    lists = classes.select(*group, "cls", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(100)), lambda i: F.slice("ids", i, F.lit(100)))).alias("ids"))
    a = lists.select(*group, F.col("cls").alias("x"), F.col("ids").alias("as"))
    b = lists.select(F.col("cls").alias("y"), F.col("ids").alias("bs"))
    both = met.unionByName(one).join(a, "x").join(b, "y")
    out = both.select(*group, "x", "y", "shared", F.explode("as").alias("p"), "bs").select(*group, "x", "y", "shared", "p", F.explode("bs").alias("q"))
    return out.where("x != y or p < q").select(*group, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared").where("a < b")


def jaccard_join(sets: DataFrame, key: str, least: float) -> DataFrame:
    """STR-16: (a, b, score), a < b: rows (key, s array<string> of distinct tokens) whose sets reach the similarity, above 0.

    Two such sets share one of the rarest tokens of either: of n tokens, rarest first, all but the last that `least` could do without.
    So frequent tokens bring nobody together, and sets of sizes too far apart do not meet. A pair is scored once, on its whole sets.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity of 0 would pair everything")
    # a hair less, so that rounding loses no pair at the threshold
    bound = least - 1e-9
    words = sets.select(key, F.explode("s").alias("token"))
    held = words.groupBy("token").agg(F.count("*").alias("df"))
    ranked = words.join(held, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("xs"))
    first = F.slice("xs", F.lit(1), (F.size("xs") - F.ceil(F.size("xs") * F.lit(bound)) + 1).cast("int"))
    lists = ranked.select(F.col(key).alias("id"), F.size("xs").alias("n"), F.explode(first).alias("x")).select("id", "n", "x.token")
    a, b = (lists.select("token", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, "token").where("a < b").where(F.least("na", "nb") >= bound * F.greatest("na", "nb")).select("a", "b").distinct()
    own = {x: sets.select(F.col(key).alias(x), F.col("s").alias(f"s{x}")) for x in "ab"}
    both = F.size(F.array_intersect("sa", "sb"))
    score = both / (F.size("sa") + F.size("sb") - both)
    return met.join(own["a"], "a").join(own["b"], "b").select("a", "b", score.alias("score")).where(F.col("score") >= least)


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """SET-02: rows of the parts, the first part's before the second's; of equal keys the first stays."""
    ranked = reduce(lambda a, b: a.unionByName(b), [p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(key).orderBy("source_rank", order)
    return ranked.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def keep_known(values: Column, allowed: list[str]) -> Column:
    return F.filter(values, lambda v: v.isin(allowed))


def token_blocked_links(steps: DataFrame, entities: DataFrame, least: float = 0.45, top: int = 3) -> DataFrame:
    """JOIN-07: explains links of steps (step_id, step_type, text) to entities (entity_id, name, entity_type).

    A pair without a shared token reaches 0.25 at most, so meeting in inverted token lists loses nothing above that.
    """
    if least <= 0.25:
        raise ValueError("pairs without a shared token could reach the least score")
    s = steps.select("step_id", tx.token_set(F.col("text")).alias("t"), F.lower("step_type").isin("method", "experiment").alias("active"))
    e = entities.select("entity_id", tx.token_set(F.col("name")).alias("t"), F.lower("entity_type").contains("steel").alias("steel"))
    lists = [x.select(*[c for c in x.columns if c != "t"], F.size("t").alias(n), F.explode("t").alias("token")) for x, n in ((s, "ns"), (e, "ne"))]
    # what the sets share is the number of lists in which the two meet, so that no set travels with the pair
    met = lists[0].join(lists[1], "token").groupBy("step_id", "entity_id", "ns", "ne", "active", "steel").agg(F.count("*").alias("both"))
    lexical, covered = F.col("both") / (F.col("ns") + F.col("ne") - F.col("both")), F.col("both") / F.col("ne")
    semantic = F.least(F.lit(1.0), 0.6 * lexical + 0.4 * covered)
    kind = F.when(F.coalesce(F.col("active") & F.col("steel"), F.lit(False)), 1.0).otherwise(0.35)
    met = met.select("step_id", "entity_id", (0.25 * lexical + 0.30 * covered + 0.20 * semantic).alias("by_words"), (0.15 * kind).alias("by_kind"))
    # the texts are looked at only where the name in the text could still lift the pair over the least score
    able = met.where(F.col("by_words") + F.col("by_kind") + 0.10 >= least - 1e-6)
    both = able.join(steps.select("step_id", "text"), "step_id").join(entities.select("entity_id", "name"), "entity_id")
    name_hit = ((F.length("name") >= 4) & F.lower("text").contains(F.lower("name"))).cast("int")
    score = F.round(F.col("by_words") + 0.10 * name_hit + F.col("by_kind"), 6)
    w = Window.partitionBy("step_id").orderBy(F.desc("score"), "entity_id")
    scored = both.select("step_id", "entity_id", score.alias("score")).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
