"""Extraction around injected model calls, schema growth, and small rules on records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.session import materialize


def call_model(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, batch: int) -> DataFrame:
    """EXT-03: an injected callable over batches of rows; a batch that raises gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                try:
                    out = call(f.iloc[i : i + batch])
                except Exception:  # the next tier takes the batch's rows
                    continue
                if len(out):
                    yield out

    return rows.mapInPandas(run, schema)


def tiered_extraction(rows: DataFrame, key: str, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batches: tuple[int, ...] = (16, 8, 1)) -> DataFrame:
    """EXT-03: batch, half batch, single row; each tier takes the rows that the one before left without a result."""
    done: list[DataFrame] = []
    left = rows
    for i, batch in enumerate(batches):
        got = materialize(call_model(left, call, schema, batch).withColumn("tier", F.lit(i)))
        done.append(got)
        left = left.join(got.select(key).distinct(), key, "left_anti")
    return reduce(lambda a, b: a.unionByName(b), done)


def multi_model(rows: DataFrame, calls: dict[str, Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch: int = 16) -> DataFrame:
    """EXT-13: the atoms of several injected models with the column model; a model's batch that raises gives none."""
    return reduce(lambda a, b: a.unionByName(b), [call_model(rows, call, schema, batch).withColumn("model", F.lit(name)) for name, call in calls.items()])


def evidence_quotes(quotes: DataFrame, chunks: DataFrame, by: str, key: str) -> DataFrame:
    """EXT-04: quotes (by, key, quote) with the first chunk (by, chunk_id, pos, text) of their document that holds them, white space aside.

    Steps without a quote are gone; a quote that stands nowhere has a null chunk.
    """
    from quillspark.functions.text import compact_whitespace

    asked = quotes.where(F.trim("quote") != "").select(by, key, compact_whitespace(F.col("quote")).alias("quote"))
    held = chunks.select(by, "chunk_id", "pos", compact_whitespace(F.col("text")).alias("text"))
    hits = asked.join(held, by).where(F.contains("text", "quote")).groupBy(by, key).agg(F.min_by("chunk_id", "pos").alias("chunk_id"))
    return asked.join(hits, [by, key], "left")


def recheck(atoms: DataFrame, verdicts: DataFrame, texts: DataFrame, key: str, by: str, least: float = 0.4, raised: float = 0.6) -> DataFrame:
    """EXT-11: flagged atoms (key, by, values, grounded, confidence) after a second look; (key, grounded, confidence, unsupported).

    Flagged are those ungrounded or under `least`. A confirmed verdict (key, verdict, span) counts only if the span stands in the
    text (by, text), white space aside, and supports the values again; then confidence is `raised` at least. If not, the atom is
    ungrounded. Atoms without a verdict stay as they are.
    """
    from quillspark.functions.text import compact_whitespace, supports

    flagged = ~F.coalesce("grounded", F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) < least)
    asked = atoms.where(flagged).join(verdicts.where("verdict = 'confirmed'").select(key, "span"), key).join(texts.select(by, "text"), by)
    stands = (F.trim("span") != "") & F.contains(compact_whitespace(F.col("text")), compact_whitespace(F.col("span"))) & supports(F.col("values"), F.col("span"))
    passed = asked.select(key, F.coalesce(stands, F.lit(False)).alias("passed"))
    out = atoms.join(passed, key, "left").join(verdicts.select(key, "verdict"), key, "left")
    confidence = F.when(F.col("passed"), F.greatest("confidence", F.lit(raised))).otherwise(F.col("confidence"))
    return out.select(
        key, F.coalesce("passed", "grounded").alias("grounded"), confidence.alias("confidence"), (flagged & (F.coalesce("verdict", F.lit("")) == "unsupported")).alias("unsupported")
    )


def section_map(sections: DataFrame, n_blocks: Column) -> DataFrame:
    """EXT-09: sections (section_id, start, end) with their ranges clamped to the blocks; empty ones go."""
    start, end = F.greatest(F.lit(0), F.col("start")), F.least(n_blocks, F.col("end"))
    return sections.withColumns({"section_id": F.col("section_id").cast("string"), "start": start, "end": end}).where("start < end")


def chained_levels(levels: DataFrame, edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """EXT-10: for each section (node, level) the summaries of its predecessors in order, as the context of its call."""
    before = edges.join(summaries, edges.src == summaries.node).groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list(F.struct("src", "summary"))).alias("xs"))
    return levels.join(before, "node", "left").select("node", "level", F.coalesce(F.array_join(F.transform("xs", lambda x: x.summary), "\n"), F.lit("")).alias("context"))


def middle_truncated(text: Column, most: int) -> Column:
    """EXT-33: head and tail of a text that is too long, with a mark between."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.right(text, F.lit(most - half))))


def path_identity(path: Column) -> tuple[Column, Column]:
    """EXT-29: (paper id, source) of a Markdown path: the file's folder names the source, a paper: prefix is stripped."""
    source = F.element_at(F.split(path, "/"), -2)
    return F.concat(F.lit("paper:"), F.substring(F.sha2(path, 256), 1, 24)), F.regexp_replace(source, "^paper:", "")


def source_metadata(blocks: DataFrame, key: str) -> DataFrame:
    """EXT-17: title, DOI and year from the first blocks (key, idx, text) of each paper; four digits of a phone number are no year."""
    from quillspark.functions.text import doi_of, year_of

    first = blocks.where("idx < 12")
    without_phones = F.regexp_replace("text", r"\+[0-9][ ().0-9-]+[0-9]", " ")
    return first.groupBy(key).agg(
        F.min_by("text", F.when(F.length("text") >= 10, F.col("idx"))).alias("title"), F.min_by(doi_of(F.col("text")), F.when(doi_of(F.col("text")).isNotNull(), F.col("idx"))).alias("doi"),
        F.max(year_of(without_phones)).alias("year"),
    )


def grow_schema(known: DataFrame, proposed: DataFrame) -> DataFrame:
    """EXT-15: known types (type_id, version) and new ones, ids lower-cased, under the next version; known ones stay."""
    fresh = proposed.select(F.lower(F.trim("type_id")).alias("type_id")).where("type_id != ''").distinct().join(known.select("type_id"), "type_id", "left_anti")
    version = known.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).scalar()
    return known.select("type_id", "version").unionByName(fresh.withColumn("version", version.cast("int")))


def rebuild_groups(old: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """EXT-18/19, SINK-19: the rows of rebuilt groups replace theirs; other groups stay."""
    return old.join(rebuilt.select(key).distinct(), key, "left_anti").unionByName(rebuilt)


def batch_delete(table: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """EXT-23: what is left, and for each id whether it was there."""
    asked = ids.select(key).distinct()
    there = asked.join(table.select(key).distinct().withColumn("deleted", F.lit(True)), key, "left")
    return table.join(asked, key, "left_anti"), there.select(key, F.coalesce("deleted", F.lit(False)).alias("deleted"))


#: LaTeX wrappers that formula matching strips, and Greek commands by name.
WRAPPERS = ["mathrm", "mathbf", "mathit", "text", "operatorname"]
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "mu": "μ", "phi": "φ", "rho": "ρ", "sigma": "σ", "tau": "τ", "theta": "θ"}


def formula(text: Column) -> Column:
    """STR-07: wrappers stripped, Greek commands as letters, spaces between digits and letters removed."""
    out = F.regexp_replace(text, r"\\(?:" + "|".join(WRAPPERS) + r")\s*\{([^{}]*)\}", "$1")
    for name, letter in GREEK.items():
        out = F.regexp_replace(out, rf"\\{name}(?![a-z])", letter)
    return F.regexp_replace(F.translate(out, "−–’", "--'"), r"(?<=[0-9])\s+(?=[α-ω0-9])", "")


def float_list(values: Column) -> Column:
    """COL-10: values that read as numbers."""
    return F.filter(F.transform(values, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def layered_settings(layers: DataFrame, by: str, bounds: dict[str, tuple[float, float, float]]) -> DataFrame:
    """EXT-27: one row for each profile (by), with each setting from the highest layer that gives a number, kept inside its bounds.

    layers: (by, layer, key, value string); bounds: setting -> (default, low, high). Unknown settings are ignored.
    """
    number = F.col("value").try_cast("double")
    known = layers.withColumn("number", F.when(F.isnan(number), None).otherwise(number))
    given = {k: F.max_by("number", F.when((F.col("key") == k) & F.col("number").isNotNull(), F.col("layer"))) for k in bounds}
    return known.groupBy(by).agg(*[F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(given[k], F.lit(float(default))))).alias(k) for k, (default, low, high) in bounds.items()])


def paper_workers(limit: Column, per_paper: Column, slots: Column, fallback: Column, low: int, high: int) -> Column:
    """EXT-27: papers at a time, from the calls allowed at once and the slots of the routable workers, or a fallback where there are none."""
    papers = F.greatest(F.lit(1), F.floor(limit / per_paper))
    return F.greatest(F.lit(low), F.least(F.lit(high), papers, F.when(slots > 0, slots).otherwise(fallback))).cast("int")


#: Paper types of a schema, and the rules with their least and greatest values; a pair is a rule's minimum and maximum.
PAPER_TYPES = ["research", "review", "software", "theoretical", "case_study"]
RULE_PAIRS = {"claims_per_paper": (1, None), "machine_evidence": (0, 6), "logic_evidence": (0, 8)}
RULES = {
    "citation_context_sentence_window": (0, 3), "targets_per_claim_max": (0, 5), "phase1_claim_worker_count": (1, 16), "phase1_logic_chunks_max": (8, 300),
    "phase1_logic_chunk_chars_max": (120, 3000), "phase1_logic_lexical_topk_min": (1, 64), "phase1_logic_lexical_topk_multiplier": (1, 12), "phase1_claim_chunks_max": (1, 9999),
    "phase1_claims_per_chunk_max": (1, 12), "phase1_claim_batch_size": (1, 12), "phase1_claim_batch_chars_max": (1000, 60000), "phase1_chunk_chars_max": (200, 20000), "phase1_doc_chars_max": (2000, 120000),
}
#: Rules in which 0 stands for the default, and the form of an id.
ZERO_IS_DEFAULT = ["phase1_claim_worker_count", "phase1_logic_chunks_max", "phase1_logic_chunk_chars_max", "phase1_claim_chunks_max", "phase1_claims_per_chunk_max", "phase1_chunk_chars_max", "phase1_doc_chars_max"]
SCHEMA_ID = "^[A-Za-z][A-Za-z0-9_-]{0,47}$"


def schema_faults(schemas: DataFrame, types: list[str] = PAPER_TYPES) -> DataFrame:
    """HG-15: schemas (schema_id, paper_type, steps, claim_kinds, rules) with the names of what is wrong in each, in a fixed order.

    steps and claim_kinds are lists of ids, which must be there, well formed and distinct; rules maps names to whole numbers,
    and a rule that is absent is not checked unless it is one of a pair, which counts as 0. Rules that are no whole numbers are not covered.
    """
    ids = lambda c: F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.rlike(SCHEMA_ID)) & (F.size(F.array_distinct(c)) == F.size(c)), F.lit(False))
    rule = lambda name: F.try_element_at("rules", F.lit(name))
    checks = {"paper_type": F.coalesce(F.col("paper_type").isin(types), F.lit(False)), "steps": ids("steps"), "claim_kinds": ids("claim_kinds")}
    for name, (low, high) in RULE_PAIRS.items():
        least, most = (F.coalesce(rule(f"{name}_{end}"), F.lit(0)) for end in ("min", "max"))
        checks[name] = (least >= low) & (most >= least) & ((most <= high) if high is not None else F.lit(True))
    for name, (low, high) in RULES.items():
        given = F.nullif(rule(name), F.lit(0)) if name in ZERO_IS_DEFAULT else rule(name)
        checks[name] = F.coalesce(given.between(low, high), F.lit(True))
    return schemas.select("schema_id", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()])).alias("faults"))


#: The six steps of a summary.
SUMMARY_STEPS = ["Background", "Problem", "Method", "Experiment", "Result", "Conclusion"]


def summary_steps(papers: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """EXT-06: all six steps of each paper (key), with what a model found (key, step_type, summary, confidence); confidence 0.5 where it gave none."""
    every = papers.select(key, F.explode(F.array(*map(F.lit, SUMMARY_STEPS))).alias("step_type"))
    sure = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))
    return every.join(found, [key, "step_type"], "left").select(key, "step_type", F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), sure.alias("confidence"))


def keyed_claims(claims: DataFrame) -> DataFrame:
    """EXT-06: claims (path, doi, text, confidence) with an id within their file and a key that equal claims of one DOI share; blank ones go."""
    from quillspark.functions.text import norm_text

    text = F.trim("text")
    ident = lambda a, b: F.substring(F.sha2(F.concat(a, F.lit("\0"), b), 256), 1, 24)
    doi = F.lower(F.trim(F.coalesce("doi", F.lit(""))))
    return claims.where(text != "").select(
        ident(F.col("path"), text).alias("claim_id"), ident(doi, norm_text(text)).alias("claim_key"), text.alias("text"), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)).alias("confidence")
    )


def rename_triggers(patterns: DataFrame, known: list[str], longest: int = 45) -> DataFrame:
    """EXT-14: concrete patterns (pattern_id, abstract) whose id is all upper case, or long and stitched from three words or more; known ones stay."""
    name = F.col("pattern_id")
    shout = (F.upper(name) == name) & (F.lower(name) != name) & (F.length(name) > 4)
    stitched = (F.length(name) >= longest) & (F.size(F.split(name, "_")) > 2)
    reason = F.when(shout, "upper").when(stitched, "long_stitched")
    return patterns.where(~F.col("abstract") & ~name.isin(known)).select("pattern_id", reason.alias("reason"), F.length(name).alias("len")).where("reason is not null")


def split_groups(edges: DataFrame, groups: DataFrame, least: int = 3) -> DataFrame:
    """EXT-14: the groups that a model made of each pattern's edges, as a partition: (pattern, edge, grp, fires).

    edges: (pattern, edge); groups: (pattern, grp, edge). An edge in several groups is the first one's, edges in none form the
    last group, and edges that the pattern lacks go. A pattern splits (fires) only if two groups hold `least` edges each.
    """
    first = groups.groupBy("pattern", "edge").agg(F.min("grp").alias("grp"))
    rest = groups.groupBy("pattern").agg((F.max("grp") + 1).alias("rest"))
    placed = edges.distinct().join(first, ["pattern", "edge"], "left").join(rest, "pattern", "left")
    placed = placed.select("pattern", "edge", F.coalesce("grp", "rest", F.lit(0)).cast("int").alias("grp"))
    large = placed.groupBy("pattern", "grp").agg(F.count("*").alias("n")).groupBy("pattern").agg((F.count_if(F.col("n") >= least) >= 2).alias("fires"))
    return placed.join(large, "pattern")


def recovery_due(references: Column, chars: Column, existing: int = 12, least: int = 18, per_thousand: float = 0.45) -> Column:
    """CIT-03: whether a document has so few references for its length that their recovery is due."""
    threshold = F.greatest(F.lit(existing), F.least(F.lit(least), F.floor(chars / 1000 * per_thousand)))
    return references < threshold


def answer_graph(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRAPH-19: evidence rows (question, paper_id, paper_source, chunk_id) as nodes and edges, each once."""
    paper = F.coalesce(F.col("paper_id").cast("string"), F.nullif(F.col("paper_source"), F.lit("")), F.lit("unknown"))
    rows = evidence.withColumn("paper", F.concat(F.lit("paper:"), paper))
    nodes = rows.select(F.col("question").alias("id"), F.lit("question").alias("kind")).unionByName(rows.select(F.col("paper").alias("id"), F.lit("paper").alias("kind")))
    nodes = nodes.unionByName(rows.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind")))
    edges = rows.select(F.col("question").alias("source"), F.col("chunk_id").alias("target")).unionByName(rows.select(F.col("chunk_id").alias("source"), F.col("paper").alias("target")))
    return nodes.distinct(), edges.distinct()


def topic_candidates(communities: DataFrame, least: int = 2) -> DataFrame:
    """FIL-17: communities of enough papers."""
    return communities.where(F.col("paper_count") >= least)


def preview_update(refs: DataFrame, resolved: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """SINK-05: the resolution columns of the given references are overwritten."""
    r = resolved.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    return refs.join(r, key, "left").select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in refs.columns])


def write_partition(df: DataFrame, path: str, by: str) -> None:
    """SRC-12, SINK-19: one partition of a store rewritten, the others left as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
