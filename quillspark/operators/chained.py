"""Extraction along a graph of sections: one round of model calls for each level, with what the levels before gave.

All papers go through a level together. A call sees the summaries of its section's predecessors and the schema of its paper as
the levels before left it: a value that the schema lacks, found with evidence and confirmed, extends the schema for all
later levels of that paper. Each round is written before the next begins, so that no call is made twice. Joins of what grows with
the sections merge, as broadcasts would send the rows of every round through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.extraction import call_model
from quillspark.operators.graph import topological_levels
from quillspark.session import materialize

#: How much a gap counts by the discourse role of its section; other roles count 1.
DISCOURSE_WEIGHT = {"definition": 1.5, "summary": 1.2, "claim": 1.2, "interpretation": 1.0, "context": 1.0, "observation": 0.7}
#: The parts of a schema that can grow in a run.
GAP_KINDS = ["entity_type", "contribution_subtype", "relation_type"]
_ATOM = "struct<layer:string,type:string,entity_type:string,subtypes:array<string>,relation:string,evidence_span:string>"
_GAP = "paper_id string, node string, level int, gap_type string, value string, evidence string, cross_node long, score double"


@dataclass
class Chained:
    """calls: (paper_id, node, level, context, schema); atoms: (paper_id, node, atom JSON); summaries: (paper_id, node, summary);
    gaps: what the schema lacked, with their scores; extensions: (paper_id, kind, value, level) that the run added."""

    calls: DataFrame
    atoms: DataFrame
    summaries: DataFrame
    gaps: DataFrame
    extensions: DataFrame


def schema_prompts(added: DataFrame, base: dict[str, list[str]]) -> tuple[DataFrame, str]:
    """(paper_id, schema) of papers with values of their own (paper_id, kind, value), and the schema of all others.

    One line for each kind that has values, both in order; base is small and goes into the plan.
    """
    kinds = sorted({*base, *GAP_KINDS})
    own = added.groupBy("paper_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in kinds])
    full = {k: F.array_sort(F.array_union(F.col(k), F.array(*[F.lit(v) for v in base.get(k, [])]).cast("array<string>"))) for k in kinds}
    lines = [F.when(F.size(x) > 0, F.concat(F.lit(f"{k}: "), F.array_join(x, ", "))) for k, x in full.items()]
    return own.select("paper_id", F.concat_ws("\n", *lines).alias("schema")), "\n".join(f"{k}: {', '.join(sorted(set(base[k])))}" for k in kinds if base.get(k))


def atom_gaps(atoms: DataFrame) -> DataFrame:
    """HG-12 within a run: (paper_id, node, gap_type, value, evidence) of the values that atoms use, before the schema is asked."""
    a = atoms.select("paper_id", "node", F.from_json("atom", _ATOM).alias("a"))

    def of(where: Column, kind: str, value: Column) -> DataFrame:
        return a.where(where).select("paper_id", "node", F.lit(kind).alias("gap_type"), value.alias("value"), F.trim(F.coalesce("a.evidence_span", F.lit(""))).alias("evidence"))

    l3 = F.col("a.layer") == "L3"
    found = of(F.col("a.layer") == "L1", "entity_type", F.upper("a.entity_type"))
    found = found.unionByName(of(l3 & (F.col("a.type") == "CONTRIBUTION"), "contribution_subtype", F.explode(F.transform("a.subtypes", lambda x: F.lower(x)))))
    found = found.unionByName(of(l3 & (F.col("a.type") == "CONTRIBUTION_RELATION"), "relation_type", F.lower("a.relation")))
    return found.where("value is not null and value != ''")


def extract_chained(
    sections: DataFrame, deps: DataFrame, schema: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame],
    confirm: Callable[[pd.DataFrame], pd.DataFrame] | None = None, evolve: bool = True, batch: int = 16,
) -> Chained:
    """EXT-10: sections (paper_id, node, role, text), deps (paper_id, node, dep, pos), base schema (kind, value), all strings but pos.

    call gets (paper_id, node, role, text, context, schema) and returns (paper_id, node, atoms, summary), atoms as a JSON array; a
    batch that raises gives nothing, and its sections have no summary. confirm gets gaps (paper_id, gap_type, value, evidence) and
    returns those that hold, their gap_type corrected; without it all with evidence hold. Sections with a blank text are not called.
    """
    spark = sections.sparkSession
    key = lambda n: F.concat_ws("\x01", "paper_id", n)
    deps = materialize(deps.select("paper_id", "node", "dep", "pos"))
    levels = topological_levels(deps.select(key("dep").alias("src"), key("node").alias("dst")), sections.select(key("node").alias("node"))).withColumnRenamed("node", "k")
    placed = materialize(sections.withColumn("k", key("node")).join(levels.hint("merge"), "k").drop("k"))
    # level: that of the node which waits for the summary
    waits = materialize(deps.withColumn("k", key("node")).join(levels.distinct().hint("merge"), "k").drop("k"))
    last = placed.agg(F.max("level")).first()[0]
    base: dict[str, list[str]] = {}
    for r in schema.select("kind", "value").distinct().collect():
        base.setdefault(r.kind, []).append(r.value)
    given = F.lit(False)
    for kind, values in base.items():
        given = given | ((F.col("gap_type") == kind) & F.col("value").isin(values))
    foreign = ~F.coalesce(given, F.lit(False))
    calls = spark.createDataFrame([], "paper_id string, node string, level int, context string, schema string")
    atoms = spark.createDataFrame([], "paper_id string, node string, atom string")
    summaries = spark.createDataFrame([], "paper_id string, node string, summary string")
    gaps = spark.createDataFrame([], _GAP)
    extensions = spark.createDataFrame([], "paper_id string, kind string, value string, level int")
    lines = waits.where(F.lit(False)).select("paper_id", "node", "level", "pos", F.lit("").alias("line"))
    section = ["paper_id", "node"]
    for level in range(-1 if last is None else last + 1):
        now = placed.where((F.col("level") == level) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
        before = lines.where(F.col("level") == level).groupBy("paper_id", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("xs"))
        context = before.select("paper_id", "node", F.concat(F.lit("Predecessor extracts:\n"), F.array_join(F.transform("xs", lambda x: x.line), "\n")).alias("context"))
        own, plain = schema_prompts(extensions, base)
        asked = now.join(own.hint("merge"), "paper_id", "left").join(context.hint("merge"), section, "left").na.fill("", ["context"])
        asked = materialize(asked.select("paper_id", "node", "role", "text", "context", F.coalesce("schema", F.lit(plain)).alias("schema")))
        got = materialize(call_model(asked, call, "paper_id string, node string, atoms string, summary string", batch))
        calls = calls.unionByName(asked.select("paper_id", "node", F.lit(level).alias("level"), "context", "schema"))
        new = got.select("paper_id", "node", F.explode(F.from_json("atoms", "array<string>")).alias("atom"))
        atoms = atoms.unionByName(new)
        # every section of the level counts, with or without an answer
        silent = placed.where(F.col("level") == level).select("paper_id", "node").join(got.select("paper_id", "node").hint("merge"), section, "left_anti")
        told = materialize(got.select("paper_id", "node", F.coalesce("summary", F.lit("")).alias("summary")).unionByName(silent.withColumn("summary", F.lit(""))))
        summaries = summaries.unionByName(told)
        if level < last:
            line = F.concat(F.lit("["), "dep", F.lit("] "), "summary").alias("line")
            heard = waits.where(F.col("level") > level).join(told.withColumnRenamed("node", "dep").hint("merge"), ["paper_id", "dep"])
            lines = lines.unionByName(materialize(heard.select("paper_id", "node", "level", "pos", line)))
        if not evolve:
            continue
        grown = extensions.select("paper_id", F.col("kind").alias("gap_type"), "value")
        lacking = atom_gaps(new).where(foreign).join(grown.hint("merge"), ["paper_id", "gap_type", "value"], "left_anti")
        met = gaps.select("paper_id", "gap_type", "value", "node").unionByName(lacking.select("paper_id", "gap_type", "value", "node"))
        cross = met.groupBy("paper_id", "gap_type", "value").agg(F.count_distinct("node").alias("cross_node"))
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in DISCOURSE_WEIGHT.items() for x in kv])[F.col("role")], F.lit(1.0))
        scored = lacking.join(cross.hint("merge"), ["paper_id", "gap_type", "value"]).join(now.select("paper_id", "node", "role").hint("merge"), section)
        scored = materialize(scored.select("paper_id", "node", F.lit(level).alias("level"), "gap_type", "value", "evidence", "cross_node", F.round(F.col("cross_node") * weight, 2).alias("score")))
        gaps = gaps.unionByName(scored)
        fresh = scored.where("evidence != ''").groupBy("paper_id", "gap_type", "value").agg(F.min("evidence").alias("evidence"))
        if confirm:
            held = call_model(fresh, confirm, "paper_id string, gap_type string, value string, evidence string", batch)
            # a corrected kind can name a value that the schema has
            fresh = held.select("paper_id", "gap_type", "value").distinct().where(foreign).join(grown.hint("merge"), ["paper_id", "gap_type", "value"], "left_anti")
        extensions = extensions.unionByName(materialize(fresh.select("paper_id", F.col("gap_type").alias("kind"), "value", F.lit(level).alias("level"))))
    return Chained(calls, atoms, summaries, gaps, extensions)

