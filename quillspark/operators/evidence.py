"""Evidence: noise filters, grounding, targets, hydration, plans and overlays."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shapes of definitions, those that need no further sign, comparisons and causes, copulas.
DEFINITIONS = (r"\bis\s+a\s+", r"\bis\s+the\s+", r"\brefers?\s+to\s+", r"\bis\s+defined\s+as\s+", r"\brepresents?\s+")
STRONG = r"(?i)\brefers?\s+to\s+|\bis\s+defined\s+as\s+"
COMPARATIVE = r"(?i)\b(?:better|worse|more|less|higher|lower|outperform\w*|improv\w+|increas\w+|decreas\w+|caus\w+|leads?|leading|led|result\w*)\b"
COPULA = r"(?i)\b(?:is|are|was|were)\b"
DENSITY = 0.08


def has_term(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in a text as a word of its own, in any case; blank terms count for nothing."""
    able = sorted({t.strip() for t in terms if t.strip()}, key=len, reverse=True)
    pattern = rf"(?iuU)(?<!\w)(?:{'|'.join(re.escape(t) for t in able)})(?!\w)"
    return F.coalesce(text.rlike(pattern), F.lit(False)) if able else F.lit(False)


def is_pure_definition(text: Column, following: Column | None = None, exempt: list[str] | None = None) -> Column:
    """FIL-09: neither exempt by a domain term nor a comparison; a strong marker, or two shapes of
    definitions, or one and copulas over DENSITY of the words, unless the next claim compares.

    The strong markers are looked at before the next claim, so those claims are never rescued by it.
    """
    shapes = sum((F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)).cast("int") for p in DEFINITIONS), F.lit(0))
    dense = F.regexp_count(text, F.lit(COPULA)) / F.regexp_count(text, F.lit(r"\S+")) > DENSITY
    rescued = F.coalesce(following.rlike(COMPARATIVE), F.lit(False)) if following is not None else F.lit(False)
    free = text.isNull() | (F.trim(text) == "") | text.rlike(COMPARATIVE)
    free = free | has_term(text, exempt or [])
    return F.when(free, False).when(text.rlike(STRONG), True).otherwise(((shapes >= 2) | ((shapes >= 1) & dense)) & ~rescued)


def filter_claims(claims: DataFrame, caption: Column, by: str, order: str) -> tuple[DataFrame, DataFrame]:
    """FIL-10: claims that are neither captions nor pure definitions, and one row of counters."""
    flagged = claims.withColumns({"caption": caption, "definition": is_pure_definition(F.col("text"), F.lead("text").over(Window.partitionBy(by).orderBy(order)))})
    kept = flagged.where(~F.col("caption") & ~F.col("definition")).drop("caption", "definition")
    stats = flagged.agg(
        F.count("*").alias("seen"), F.count_if("caption").alias("captions"), F.count_if(~F.col("caption") & F.col("definition")).alias("definitions"),
        F.count_if(~F.col("caption") & ~F.col("definition")).alias("kept"),
    )
    return kept, stats.withColumn("rate", F.when(F.col("seen") > 0, 1 - F.col("kept") / F.col("seen")).otherwise(0.0))


def noise_filter(
    claims: DataFrame, caption: Column, by: str, order: str, exempt: list[str] | None = None, captions: bool = True, definitions: bool = True, context: bool = True
) -> tuple[DataFrame, DataFrame]:
    """FIL-10 with all rules: (kept claims, one row of counters) of claims (by, order, text).

    A caption stays if it holds an exempt term; so does a definition, or, with context, one whose next claim of the same document compares.
    Counted are, besides what went, the claims that a term kept (once each) and those that the next claim kept.
    """
    text = F.col("text")
    following = F.lead("text").over(Window.partitionBy(by).orderBy(order)) if context else F.lit(None).cast("string")
    rows = claims.withColumns({"_next": following, "_term": has_term(text, exempt or []), "_caption": F.coalesce(caption, F.lit(False)) & F.lit(captions)})
    pure = lambda nxt, terms: is_pure_definition(text, nxt, terms) & F.lit(definitions)
    rows = rows.withColumns({"_pure": pure(F.col("_next"), exempt), "_bare": pure(F.col("_next"), None), "_alone": pure(None, exempt)})
    gone = F.when(F.col("_caption") & ~F.col("_term"), "caption").when(F.col("_pure"), "definition")
    rows = rows.withColumn("_gone", gone)
    by_term = F.col("_gone").isNull() & F.col("_term") & (F.col("_caption") | F.col("_bare"))
    by_next = F.col("_gone").isNull() & (F.coalesce("_next", F.lit("")) != "") & F.col("_alone")
    n = F.count("*")
    stats = rows.agg(
        n.alias("raw_count"), F.count_if(F.col("_gone").isNull()).alias("filtered_count"), F.count_if(F.col("_gone") == "caption").alias("caption_filtered"),
        F.count_if(F.col("_gone") == "definition").alias("definition_filtered"), F.count_if(by_term).alias("whitelist_preserved"), F.count_if(by_next).alias("context_preserved"),
        F.when(n > 0, F.count_if(F.col("_gone").isNotNull()) / n).otherwise(0.0).alias("filter_rate"),
    )
    return rows.where("_gone is null").select(*claims.columns), stats


def scoped(hits: DataFrame, allowed: list[str]) -> DataFrame:
    """FIL-12: hits of allowed sources; a blank source only from a textbook."""
    blank = F.trim(F.coalesce("paper_source", F.lit(""))) == ""
    return hits.where(F.when(blank, F.col("origin") == "textbook").otherwise(F.col("paper_source").isin(allowed)))


def structured_rows(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """FIL-13: rows of known kinds with an id and a text, blanks as null."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    out = rows.where(F.col("kind").isin(kinds)).select("kind", F.coalesce(blank("id"), blank("alt_id")).alias("id"), F.coalesce(blank("text"), blank("quote")).alias("text"))
    return out.where(F.col("id").isNotNull() & F.col("text").isNotNull())


def grounded(atoms: DataFrame) -> DataFrame:
    """FIL-14: grounded atoms; papers and research questions unless unsupported."""
    free = F.col("type").isin("PAPER", "RESEARCH_QUESTION")
    return atoms.where(F.when(free, F.col("status") != "unsupported").otherwise(F.col("status") == "grounded"))


def capped_buckets(rows: DataFrame, bucket: str, order: str, caps: dict[str, int]) -> DataFrame:
    """FIL-21: the first rows of each bucket, up to the bucket's cap."""
    cap = reduce(lambda a, kv: F.when(F.col(bucket) == kv[0], kv[1]).otherwise(a), caps.items(), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= cap)


def targets_from_citations(claims: DataFrame, cites: DataFrame, kinds: list[str], top: int) -> DataFrame:
    """JOIN-11: for claims of some kinds the papers cited in their chunks, those with most mentions first."""
    wanted = claims.where(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in kinds]))).select("claim_id", F.explode("chunks").alias("chunk_id"))
    best = wanted.join(cites, "chunk_id").groupBy("claim_id", "cited_id").agg(F.max("mentions").alias("mentions"))
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("mentions"), "cited_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cited_id"))), lambda x: x.cited_id).alias("targets"))


def grounding_rows(ids: DataFrame, claims: DataFrame, steps: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """JOIN-12, VEC-12: chunks behind claims and steps, each (kind, id, chunk) once, in order."""
    c = ids.where("kind = 'claim'").join(claims.select(F.col("claim_id").alias("id"), "chunk_id"), "id")
    s = ids.where("kind = 'logic_step'").join(steps.select(F.col("logic_step_id").alias("id"), "chunk_id"), "id")
    both = c.unionByName(s).join(chunks.select("chunk_id", F.col("text").alias("quote")), "chunk_id", "left")
    return both.dropDuplicates(["kind", "id", "chunk_id"]).orderBy("kind", "id", "chunk_id").limit(limit)


def author_year(mentions: DataFrame, references: DataFrame) -> DataFrame:
    """JOIN-19: mentions (mention_id, paper_id, year, token) that name exactly one reference (paper_id, ref_num, year, surname).

    A mention meets one row for each name, with its least and its greatest reference, however many references share that name.
    """
    keys = ["paper_id", "year", "token"]
    named = references.withColumnRenamed("surname", "token").groupBy(*keys).agg(F.min("ref_num").alias("least"), F.max("ref_num").alias("most"))
    hit = mentions.join(named, keys).groupBy("mention_id").agg(F.min("least").alias("ref_num"), F.max("most").alias("most"))
    return hit.where(F.col("ref_num") == F.col("most")).select("mention_id", "ref_num")


def gap_scores(gaps: DataFrame, weights: dict[str, float]) -> DataFrame:
    """AGG-21: distinct nodes of a gap times the weight of its discourse role."""
    weight = reduce(lambda a, kv: F.when(F.col("role") == kv[0], kv[1]).otherwise(a), weights.items(), F.lit(1.0))
    return gaps.groupBy("gap", "role").agg(F.count_distinct("node").alias("nodes")).withColumn("score", F.col("nodes") * weight)


#: Rows of a range of the seeded order, in which predictions are permuted.
ROWS_PER_RANGE = 10_000


def permuted_accuracy(rows: DataFrame, seed: int) -> DataFrame:
    """AGG-22: share of right labels, as they are and with the predictions permuted within ranges of a seeded order."""
    order = F.xxhash64(F.col("id"), F.lit(seed))
    bucket = F.pmod(order, F.lit(max(1, rows.count() // ROWS_PER_RANGE)))
    w = Window.partitionBy("bucket").orderBy("h", "id")
    shifted = rows.withColumns({"h": order, "bucket": bucket}).withColumn("other", F.coalesce(F.lead("predicted").over(w), F.first("predicted").over(w)))
    right = lambda c: F.avg((F.col("label") == F.col(c)).cast("double"))
    return shifted.agg(right("predicted").alias("accuracy"), right("other").alias("permuted"))


def evidence_for(units: DataFrame, chunks: DataFrame, score: Column, most: int, least: float = 2.0) -> DataFrame:
    """EXT-05: the best chunks of a unit's paper; weak where the best score is under the least one.

    units: (unit_id, paper_id, tokens); chunks: (chunk_id, paper_id, text); score is a column over both.
    """
    scored = units.join(chunks, "paper_id").withColumn("score", F.round(score, 6)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("score"), "chunk_id"))
    top = F.max("score").over(Window.partitionBy("unit_id"))
    return scored.withColumns({"rank": rank, "weak": top < least}).where(F.col("rank") <= most).select("unit_id", "chunk_id", "score", "rank", "weak")


def taxonomy_text(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """HG-16: one indented line for each type, in the order of its path."""
    path = closure.groupBy("child").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", F.col("ancestor").cast("string").alias("ancestor"))), False), lambda x: x.ancestor).alias("up"))
    out = nodes.join(path, nodes.node == path.child, "left").withColumn("up", F.coalesce("up", F.array().cast("array<string>")))
    line = F.concat(F.repeat(F.lit("  "), F.size("up")), F.col("node").cast("string"))
    return out.select("node", F.array_join(F.concat("up", F.array(F.col("node").cast("string"))), "/").alias("path"), line.alias("line"))


def outgoing_enrichment(cites: DataFrame, human: DataFrame, mentions: DataFrame) -> DataFrame:
    """CIT-06: labels of people before those of machines, cleared ones empty; pending machine labels; mentions nested in order."""
    nested = mentions.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("ref_num", "chunk"))).alias("mentions"))
    joined = cites.join(human, ["src", "dst"], "left").join(nested, ["src", "dst"], "left")
    cleared = F.coalesce("cleared", F.lit(False))
    labels = F.when(cleared, F.array().cast("array<string>")).otherwise(F.coalesce("human_labels", "labels"))
    source = F.when(cleared, "cleared").when(F.col("human_labels").isNotNull(), "human").otherwise("machine")
    pending = F.when(F.col("human_labels").isNotNull() & F.coalesce("needs_review", F.lit(False)), F.col("labels"))
    return joined.select("src", "dst", labels.alias("labels"), source.alias("source"), pending.alias("pending"), F.coalesce(F.size("mentions"), F.lit(0)).alias("n_mentions"))


#: The intents and plans of a question, and the queries that a plan may bring.
INTENTS = ["paper_detail", "foundational", "hybrid_explanation", "comparison"]
PLANS = ["paper_first_then_textbook", "textbook_first_then_paper", "hybrid_parallel", "claim_first", "community_first"]
PLAN_QUERIES = ["main_query", "paper_query", "textbook_query", "community_query"]


def json_object(answer: Column) -> Column:
    """COL-06: the JSON object of an answer as text: the answer itself, or what stands between its first and last brace; null for anything else."""
    text = F.trim(F.regexp_replace(answer, r"^\s+|\s+$", ""))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    is_object = lambda x: F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT")
    return F.when(F.try_parse_json(text).isNotNull(), F.when(is_object(text), text)).when(F.coalesce(is_object(inner), F.lit(False)), inner)


def query_plan(question: Column, answer: Column) -> Column:
    """COL-08: the plan of a planner's JSON answer, or the fallback plan where it is no valid one.

    A query under an old name (ending in _query) becomes the community query where that is blank; a plan that is not supported becomes
    community_first only with a community query. An answer is valid with a known intent, a known plan, a main query
    that is not empty, text or nothing as the other queries and the reason, and a confidence within 0 to 1 or none.
    """
    body = json_object(answer)
    v = F.try_parse_json(body)
    fields = F.from_json(body, "map<string,string>")
    kind = {c: F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) for c in ["intent", "retrieval_plan", *PLAN_QUERIES, "confidence", "reason"]}
    raw = {c: F.try_variant_get(v, f"$.{c}", "string") for c in kind}
    strip = lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))
    # a null under an old name is the text None
    old = F.filter(F.map_entries(fields), lambda e: e.key.endswith("_query") & ~e.key.isin(PLAN_QUERIES) & (strip(F.coalesce(e.value, F.lit("None"))) != ""))
    promoted = strip(F.coalesce(F.get(old, F.lit(0)).value, F.when(F.size(old) > 0, "None")))
    blank = strip(F.coalesce(raw["community_query"], F.lit(""))) == ""
    community = F.when(blank & promoted.isNotNull(), promoted).otherwise(raw["community_query"])
    asked = strip(F.coalesce(raw["retrieval_plan"], F.lit("")))
    plan = F.when((asked != "") & ~asked.isin(PLANS) & (F.coalesce(community, F.lit("")) != ""), "community_first").otherwise(raw["retrieval_plan"])
    none_or_text = [kind[c].isNull() | kind[c].isin("VOID", "STRING") for c in ("paper_query", "textbook_query", "reason")]
    none_or_text.append(kind["community_query"].isNull() | kind["community_query"].isin("VOID", "STRING") | (blank & promoted.isNotNull()))
    confidence = F.try_variant_get(v, "$.confidence", "double")
    sure = kind["confidence"].isNull() | (kind["confidence"] == "VOID") | confidence.between(0.0, 1.0)
    valid = (kind["intent"] == "STRING") & raw["intent"].isin(INTENTS) & plan.isin(PLANS) & (kind["main_query"] == "STRING") & (raw["main_query"] != "") & sure
    for ok in none_or_text:
        valid = valid & ok
    valid = F.coalesce(valid, F.lit(False))
    asked_for = strip(F.coalesce(question, F.lit("")))
    fallback = {"intent": F.lit("paper_detail"), "retrieval_plan": F.lit("paper_first_then_textbook"), "main_query": F.when(asked_for == "", "question").otherwise(asked_for)}
    found = raw | {"retrieval_plan": plan, "community_query": community, "confidence": confidence}
    out = {c: F.when(valid, x).otherwise(fallback.get(c, F.lit(None))) for c, x in found.items()}
    return F.struct(*[x.alias(c) for c, x in out.items()], (~valid).alias("fallback"))


def norm_string_list(values: Column) -> Column:
    """COL-01: trimmed, without blanks, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))
