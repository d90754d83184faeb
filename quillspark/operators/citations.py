"""Citation semantics: purposes, polarity, signals, scopes, mentions and event recovery; upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The purpose labels, and the sets that polarity, signals and scopes derive from.
PURPOSES = ["Survey", "Background", "ProblemSetup", "Theory", "MethodUse", "DataTool", "BaselineCompare", "SupportEvidence", "CritiqueLimit", "ExtendImprove", "FutureDirection", "Unknown"]
POSITIVE = ["SupportEvidence", "ExtendImprove", "MethodUse", "Theory", "DataTool"]
NEGATIVE = ["CritiqueLimit"]
SIGNALS = {
    "gap_hint": ["CritiqueLimit", "ProblemSetup", "FutureDirection"],
    "future_opportunity_hint": ["FutureDirection"],
    "method_transfer_hint": ["ExtendImprove", "MethodUse", "DataTool"],
    "benchmark_hint": ["BaselineCompare"],
}
SCOPES = {
    "method": ["MethodUse", "ExtendImprove", "BaselineCompare"],
    "dataset": ["DataTool"],
    "claim": ["SupportEvidence", "CritiqueLimit", "Theory"],
    "gap": ["FutureDirection", "ProblemSetup"],
}


def _in(labels: Column, names: list[str]) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))


def polarity(labels: Column) -> Column:
    """COL-05"""
    p, n = _in(labels, POSITIVE), _in(labels, NEGATIVE)
    return F.when(p & n, "mixed").when(p, "positive").when(n, "negative").otherwise("neutral")


def signals(labels: Column) -> Column:
    return F.filter(F.array(*[F.when(_in(labels, v), F.lit(k)) for k, v in SIGNALS.items()]), lambda x: x.isNotNull())


def scopes(labels: Column) -> Column:
    return F.filter(F.array(F.lit("paper"), *[F.when(_in(labels, v), F.lit(k)) for k, v in SCOPES.items()]), lambda x: x.isNotNull())


def clean_purposes(labels: Column, scores: Column, most: int = 3) -> Column:
    """CIT-07: known labels with their scores, best first; Unknown / 0.0 where none is left."""
    pairs = F.transform(F.filter(F.arrays_zip(labels.alias("label"), scores.alias("score")), lambda p: p["label"].isin(PURPOSES)), lambda p: F.struct(F.coalesce(p["score"].cast("double"), F.lit(0.0)).alias("score"), p["label"].alias("label")))
    best = F.slice(F.sort_array(pairs, False), 1, most)
    return F.when(F.size(best) > 0, best).otherwise(F.array(F.struct(F.lit(0.0).alias("score"), F.lit("Unknown").alias("label"))))


def single_purpose(labels: Column, scores: Column, most: int = 3) -> Column:
    """EXT-08: known labels of one citation with their scores in 0..1, best first; 0.4 each where a score is missing or the lists do not fit.

    Background with 0.4 where no label is left.
    """
    score = lambda i: F.when(F.size(labels) == F.size(scores), F.try_element_at(scores, i + 1))
    inside = lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(s.try_cast("double"), F.lit(0.4))))
    pairs = F.transform(labels, lambda x, i: F.struct((-inside(score(i))).alias("order"), i.alias("place"), x.alias("label")))
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["label"].isin(PURPOSES))), 1, most)
    named = F.transform(best, lambda p: F.struct((-p["order"]).alias("score"), p["label"].alias("label")))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.struct(F.lit(0.4).alias("score"), F.lit("Background").alias("label"))))


def judge_label(score: Column, contradicted: Column, supported: float = 0.75, weak: float = 0.55) -> Column:
    """CIT-08"""
    return F.when(contradicted, "unsupported").when(score >= supported, "supported").when(score >= weak, "weak").otherwise("unsupported")


def mention_rows(events: DataFrame, cites: DataFrame, acts: DataFrame) -> DataFrame:
    """JOIN-10, CIT-05: events (paper_id, ref_num, chunk_id) -> cited paper -> citation act; the last of doubled keys counts."""
    cited = cites.groupBy("paper_id", "ref_num").agg(F.max_by("cited_id", "pos").alias("cited_id"))
    named = acts.groupBy("paper_id", "cited_id").agg(F.max("act_id").alias("act_id"))
    out = events.join(cited, ["paper_id", "ref_num"]).join(named, ["paper_id", "cited_id"], "left")
    return out.withColumn("act_id", F.coalesce("act_id", F.concat_ws("->", "paper_id", "cited_id")))


def recover_events(chunks: DataFrame, references: DataFrame, events: DataFrame, per_chunk: int = 6) -> DataFrame:
    """CIT-02: bracketed numbers in chunks (paper_id, chunk_id, text) that name a reference (paper_id, ref_num) and are not events yet."""
    from quillspark.functions.text import expand_citation_body

    bodies = F.regexp_extract_all("text", F.lit(r"\[([0-9,;\s–-]+)\]"), F.lit(1))
    found = chunks.select("paper_id", "chunk_id", F.posexplode(bodies).alias("place", "body"))
    nums = found.select("paper_id", "chunk_id", "place", F.posexplode(expand_citation_body(F.col("body"))).alias("k", "ref_num"))
    known = nums.join(references.select("paper_id", "ref_num").distinct(), ["paper_id", "ref_num"], "left_semi")
    once = known.groupBy("paper_id", "chunk_id", "ref_num").agg(F.min(F.struct("place", "k")).alias("at"))
    fresh = once.join(events.select("chunk_id", "ref_num"), ["chunk_id", "ref_num"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("at", "ref_num"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= per_chunk).select("paper_id", "chunk_id", "ref_num", "rank")


def upsert_keep_old(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """SINK-03: existing values are never overwritten; new rows and missing values are filled."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    cols = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in [*keys, *keep]]
    return o.join(n, on, "full").select(*cols)


def upsert_keep_non_blank(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """SINK-11: a new value wins unless it is blank."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    cols = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys] + [F.coalesce(F.nullif(F.trim(F.col(f"n.{c}")), F.lit("")), F.col(f"o.{c}")).alias(c) for c in values]
    return o.join(n, on, "full").select(*cols)


def replace_by_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """SINK-09: all old rows of a source that has new rows go; the new ones come."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def merge_resolved(old: DataFrame, moved: DataFrame, evidence: int = 5) -> DataFrame:
    """SINK-04: mentions add up, reference numbers and evidence unite in order; evidence keeps evidence - 1 entries.

    The reference's own slice leaves out its last place, and so does this one.
    """
    o, m = old.alias("o"), moved.alias("m")
    on = (F.col("o.src") == F.col("m.src")) & (F.col("o.dst") == F.col("m.dst"))
    empty = F.array().cast("array<string>")
    both = lambda c: F.array_distinct(F.concat(F.coalesce(f"o.{c}", empty), F.coalesce(f"m.{c}", empty)))
    return o.join(m, on, "full").select(
        F.coalesce("o.src", "m.src").alias("src"),
        F.coalesce("o.dst", "m.dst").alias("dst"),
        (F.coalesce("o.total_mentions", F.lit(0)) + F.coalesce("m.total_mentions", F.lit(0))).alias("total_mentions"),
        both("ref_nums").alias("ref_nums"),
        F.slice(both("evidence"), 1, evidence - 1).alias("evidence"),
    )


def delete_unshared(entities: DataFrame, links: DataFrame, book: str) -> DataFrame:
    """SINK-14: entities (entity_id) left after a textbook goes: those of other books' chapters, or of no chapter.

    links: (entity_id, textbook_id).
    """
    own = links.where(F.col("textbook_id") == book).select("entity_id").distinct()
    others = links.where(F.col("textbook_id") != book).select("entity_id").distinct()
    gone = own.join(others, "entity_id", "left_anti")
    return entities.join(gone, "entity_id", "left_anti")


def backfill_purposes(cites: DataFrame) -> DataFrame:
    """SINK-06: missing purposes become Background with 0.2."""
    empty = F.coalesce(F.size("labels"), F.lit(0)) <= 0
    return cites.withColumns(
        {"labels": F.when(empty, F.array(F.lit("Background"))).otherwise(F.col("labels")), "scores": F.when(empty, F.array(F.lit(0.2))).otherwise(F.col("scores"))}
    )


def bibtex(papers: DataFrame) -> DataFrame:
    """SINK-17: one escaped entry for each paper (paper_id, title, year)."""
    safe = F.regexp_replace(F.coalesce("title", F.lit("")), r"([{}\\%&_#$])", r"\\$1")
    return papers.select("paper_id", F.format_string("@article{%s,\n  title = {%s},\n  year = {%s}\n}", F.col("paper_id").cast("string"), safe, F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("entry"))
