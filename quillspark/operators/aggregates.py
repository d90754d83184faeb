"""Aggregations: merging, completeness, conflicts, quality gates, labels and histograms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.session import materialize


def first_references(refs: DataFrame) -> DataFrame:
    """AGG-01: of references (ref_num, raw, pos) with one number, the first."""
    return refs.groupBy("paper_id", "ref_num").agg(F.min(F.struct("pos", "raw")).getField("raw").alias("raw"))


def cite_records(events: DataFrame, resolved: DataFrame, least: float = 0.55, evidence: int = 5) -> DataFrame:
    """AGG-01: events (paper_id, ref_num, chunk_id, pos) grouped by the work that their reference resolves to.

    resolved: (paper_id, ref_num, doi, confidence). References below the confidence stay under their own number.
    """
    sure = resolved.where((F.col("confidence") >= least) & (F.trim("doi") != "")).select("paper_id", "ref_num", F.lower("doi").alias("doi"))
    joined = events.join(sure, ["paper_id", "ref_num"], "left")
    target = F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("ref:"), "ref_num"))
    w = Window.partitionBy("paper_id", "target").orderBy("pos", "chunk_id")
    ranked = joined.withColumn("target", target).withColumn("rn", F.row_number().over(w))
    return ranked.groupBy("paper_id", "target").agg(
        F.count("*").alias("total_mentions"),
        F.array_sort(F.collect_set("ref_num")).alias("ref_nums"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= evidence, F.struct("rn", "chunk_id")))), lambda x: x.chunk_id).alias("evidence"),
    )


def merge_claims(claims: DataFrame, steps: list[str]) -> DataFrame:
    """AGG-02: candidates (paper_id, step_type, text, kinds, chunk_id, confidence) merged.

    Candidates of a step with equal normalised text become one: the longest text, all kinds and chunks, the mean
    confidence clamped to 0..1. Equal claims of several steps then collapse into the earliest step.
    """
    rows = claims.withColumn("key", F.lower(tx.norm_text(F.col("text"))))
    one = rows.groupBy("paper_id", F.lower("step_type").alias("step"), "key").agg(
        F.max(F.struct(F.length("text").alias("l"), F.col("text").alias("t"))).getField("t").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunks"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("confidence"))).alias("confidence"),
    )
    order = F.array_position(F.array(*[F.lit(s.lower()) for s in steps]), F.col("step"))
    ranked = one.withColumn("place", F.when(order > 0, order).otherwise(len(steps) + 1))
    return ranked.groupBy("paper_id", "key").agg(
        F.min(F.struct("place", "step")).getField("step").alias("step"),
        F.min_by("text", F.struct("place", "text")).alias("text"),
        F.min_by("kinds", F.struct("place", "text")).alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"),
        F.min_by("confidence", F.struct("place", "text")).alias("confidence"),
        F.count("*").alias("merged_steps"),
    )


def slot_completeness(claims: DataFrame, slots: list[tuple[str, str]], units: DataFrame) -> DataFrame:
    """AGG-03: for each unit (paper_id) the covered share of the slots (step_type, kind) and the missing ones."""
    have = claims.select("paper_id", "step_type", F.explode("kinds").alias("kind")).groupBy("paper_id", "step_type", "kind").agg(F.count("*").alias("n"))
    wanted = units.select("paper_id", F.explode(F.array(*[F.struct(F.lit(s).alias("step_type"), F.lit(k).alias("kind")) for s, k in slots])).alias("slot")).select("paper_id", "slot.*")
    joined = wanted.join(have, ["paper_id", "step_type", "kind"], "left")
    return joined.groupBy("paper_id").agg(
        F.count_if(F.col("n").isNotNull()).alias("covered"),
        F.count("*").alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.concat_ws("/", "step_type", "kind")))).alias("missing"),
    ).withColumn("coverage", F.col("covered") / F.col("total"))


#: Words of either polarity, inflected.
POSITIVE = r"\b(?:increas|improv|better|higher|gain|boost|enhanc|outperform)\w*"
NEGATIVE = r"\b(?:decreas|reduc|lower|worse|worsen|drop|declin|weaker)\w*"


def polarity(text: Column, positive: str = POSITIVE, negative: str = NEGATIVE) -> Column:
    p, n = F.regexp_count(F.lower(text), F.lit(positive)), F.regexp_count(F.lower(text), F.lit(negative))
    return F.when(p > n, 1).when(n > p, -1).otherwise(0)


def conflict_stats(pairs: DataFrame, polarities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-04: of pairs (a, b) with polarities that are not neutral, those with opposite ones; counts and rate, of all or for each group of pairs."""
    p = polarities.where("polarity != 0")
    both = pairs.join(p.select(F.col("claim_id").alias("a"), F.col("polarity").alias("pa")), "a").join(p.select(F.col("claim_id").alias("b"), F.col("polarity").alias("pb")), "b")
    return both.groupBy(*(by or [])).agg(F.count("*").alias("comparable"), F.count_if(F.col("pa") != F.col("pb")).alias("conflicts")).withColumn(
        "rate", F.when(F.col("comparable") > 0, F.col("conflicts") / F.col("comparable")).otherwise(0.0)
    )


def token_conflicts(claims: DataFrame, group: list[str], least_shared: int, tokens: Column, polarity: Column) -> DataFrame:
    """AGG-04 over all pairs of one group (JOIN-18) that share enough tokens: comparable pairs, conflicts and rate, without a row for each pair.

    Neutral claims compare with none. Claims with equal token sets are one class with its claims of either polarity, so that two
    classes that meet add the products of their counts.
    """
    from quillspark.operators.relational import class_meetings, token_classes

    rows = claims.select(*group, tokens.alias("_tokens"), polarity.alias("_polarity")).where("_polarity != 0")
    counts = [F.count_if(F.col("_polarity") > 0).alias("up"), F.count_if(F.col("_polarity") < 0).alias("down")]
    classes = materialize(token_classes(rows, group, least_shared, F.col("_tokens"), *counts))

    def products(frame, i, j, shared):
        up, down = frame["up"].to_numpy(), frame["down"].to_numpy()
        return pd.DataFrame({"comparable": [int(((up + down)[i] * (up + down)[j]).sum())], "conflicts": [int((up[i] * down[j] + down[i] * up[j]).sum())]})

    across = class_meetings(classes, group, least_shared, products, "comparable long, conflicts long", ["up", "down"])
    n = F.col("up") + F.col("down")
    inside = classes.select((n * (n - 1) / 2).cast("long").alias("comparable"), (F.col("up") * F.col("down")).alias("conflicts"))
    total = across.unionByName(inside).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("comparable", "conflicts")])
    return total.withColumn("rate", F.when(F.col("comparable") > 0, F.col("conflicts") / F.col("comparable")).otherwise(0.0))


def judged_conflicts(pairs: DataFrame, judgments: DataFrame, least: float) -> DataFrame:
    """AGG-05: judgments (pair_id, label, score) of pairs: contradictions above the least score, coverage, missing and unknown ids."""
    joined = pairs.join(judgments, "pair_id", "left")
    known = joined.agg(
        F.count("*").alias("pairs"),
        F.count_if((F.col("label") == "contradict") & (F.col("score") >= least)).alias("contradictions"),
        F.count_if(F.col("label") == "insufficient").alias("insufficient"),
        F.count_if(F.col("label").isNull()).alias("missing"),
    )
    unknown = judgments.join(pairs, "pair_id", "left_anti").agg(F.count("*").alias("unknown"))
    return known.withColumn("unknown", unknown.scalar()).withColumn("coverage", F.when(F.col("pairs") > 0, 1 - F.col("missing") / F.col("pairs")).otherwise(0.0))


#: Least supported share, step coverage, slot coverage, most conflict rate, least logic coverage.
GATES = {
    "strict": {"supported": 0.72, "step": 0.55, "slot": 0.65, "conflict": 0.20, "logic": 0.90},
    "balanced": {"supported": 0.50, "step": 0.40, "slot": 0.40, "conflict": 1.0, "logic": 0.83},
    "recall": {"supported": 0.30, "step": 0.25, "slot": 0.20, "conflict": 1.0, "logic": 0.67},
}


def quality_gates(reports: DataFrame, profile: str = "balanced") -> DataFrame:
    """AGG-06/07: reports (supported, step, slot, conflict, logic ratios; comparable, conflicts counts) against a profile.

    The conflict gate counts only from three comparable pairs and one conflict on. Tier: green, yellow, red for 0, 1, more failures.
    """
    g = GATES[profile]
    fails = [F.when(F.col(k) < g[k], F.lit(f"{k}_low")) for k in ("supported", "step", "slot", "logic")]
    fails.append(F.when((F.col("comparable") >= 3) & (F.col("conflicts") >= 1) & (F.col("conflict") > g["conflict"]), F.lit("conflict_high")))
    out = reports.withColumn("reasons", F.filter(F.array(*fails), lambda x: x.isNotNull()))
    n = F.size("reasons")
    tier = F.when(n == 0, "green").when(n == 1, "yellow").otherwise("red")
    return out.withColumns({"tier": tier, "score": F.greatest(F.lit(0.0), 1 - n / 5)})


def keyword_top(tokens: DataFrame, group: str, k: int) -> DataFrame:
    """AGG-14: the k most frequent tokens of each group, ties by token."""
    n = tokens.groupBy(group, "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "token")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Buckets of n-gram hashes, a power of 2, and how many of the fullest are counted first.
NGRAM_BUCKETS, FULL_BUCKETS = 1 << 16, 16


def ngram_label(texts: DataFrame, group: str, generic: list[str]) -> DataFrame:
    """AGG-13: the label of each group: its most frequent 3- or 2-gram of words not all generic; ties by length, then text.

    N-grams are hashed to 64 bits, and only those of the winners are spelt. First the hashes are counted by bucket, a bounded
    number of them; then one by one in the fullest buckets of each group, and last in every other bucket that holds as many hashes as the
    best of those, if there is one. No other can hold a winner, so the result is exact.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+(?:-[a-z0-9]+)?"), F.lit(0))
    rows = texts.select(group, words.alias("w")).where(F.size("w") >= 2)
    runs = rows.select(group, F.inline(F.arrays_zip("w", F.slice("w", F.lit(2), F.size("w")), F.slice("w", F.lit(3), F.size("w"))))).toDF(group, "a", "b", "c")
    plain = F.col("a").isin(generic) & F.col("b").isin(generic)
    three = F.when(F.col("c").isNotNull() & ~(plain & F.col("c").isin(generic)), F.xxhash64("a", "b", "c"))
    two = F.when(F.col("b").isNotNull() & ~plain, F.xxhash64("a", "b"))
    grams = runs.select(group, F.explode(F.array(three, two)).alias("h")).where("h is not null").withColumn("bucket", F.col("h").bitwiseAND(F.lit(NGRAM_BUCKETS - 1)))
    loads = materialize(grams.groupBy(group, "bucket").agg(F.count("*").alias("load")))
    loads = loads.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("load"), "bucket")))

    def counted(buckets: DataFrame) -> DataFrame:
        return materialize(grams.join(F.broadcast(buckets.select(group, "bucket")), [group, "bucket"]).groupBy(group, "h").agg(F.count("*").alias("n")))

    found = counted(loads.where(F.col("place") <= FULL_BUCKETS))
    best = found.groupBy(group).agg(F.max("n").alias("n"))
    rest = materialize(loads.where(F.col("place") > FULL_BUCKETS).join(best, group).where("load >= n"))
    if rest.limit(1).count():
        found = found.unionByName(counted(rest))
    winners = materialize(found.join(found.groupBy(group).agg(F.max("n").alias("n")), [group, "n"]))
    spelt = runs.select(group, "a", "b", "c", F.explode(F.array(F.struct(three.alias("h"), F.lit(3).alias("k")), F.struct(two.alias("h"), F.lit(2).alias("k")))).alias("g"))
    own = winners.select(group, F.col("h").bitwiseAND(F.lit(NGRAM_BUCKETS - 1)).alias("bucket")).distinct()
    spelt = spelt.select(group, "a", "b", "c", "g.h", "g.k").withColumn("bucket", F.col("h").bitwiseAND(F.lit(NGRAM_BUCKETS - 1)))
    named = spelt.join(F.broadcast(own), [group, "bucket"]).join(winners, [group, "h"])
    phrase = F.concat_ws(" ", "a", "b", F.when(F.col("k") == 3, F.col("c")))
    best = named.select(group, "n", phrase.alias("phrase")).groupBy(group).agg(F.max(F.struct("n", F.length("phrase").alias("l"), "phrase")).alias("b"))
    return best.select(group, F.col("b.phrase").alias("title"), F.col("b.n").alias("n"))


def label_histogram(rows: DataFrame, key: str) -> DataFrame:
    """AGG-15: rows (labels, scores) -> the largest score of each label, by key."""
    pairs = rows.select(key, F.explode(F.arrays_zip("labels", "scores")).alias("p"))
    return pairs.groupBy(key, F.col("p.labels").alias("label")).agg(F.max("p.scores").alias("score"))


def merge_segments(rows: DataFrame) -> DataFrame:
    """AGG-24: for each paper and step the surest summary (then the longer), and the union of the evidence in order."""
    return rows.groupBy("paper_id", "step_type").agg(
        F.max_by("summary", F.struct("confidence", F.length("summary"), "summary")).alias("summary"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence"))), lambda x: x.evidence))).alias("evidence"),
    )


def recurrence(rows: DataFrame, cross: int = 2, total: int = 3) -> DataFrame:
    """AGG-25, AGG-20: signatures with their distinct nodes and occurrences, and whether they may grow the schema."""
    return (
        rows.groupBy("signature")
        .agg(F.count_distinct("node").alias("nodes"), F.count("*").alias("n"))
        .withColumn("grows", (F.col("nodes") >= cross) | (F.col("n") >= total))
    )


def materialize_communities(members: DataFrame) -> DataFrame:
    """AGG-12: members (community_id, member_id, paper_id, core) -> counts of members, papers and core members."""
    return members.groupBy("community_id").agg(
        F.count("*").alias("member_count"), F.count_distinct("paper_id").alias("paper_count"), F.count_if("core").alias("core_member_count")
    )
