"""Hypergraph operators: incidence tables, pattern validation, schema evolution triggers and edits.

Tables: nodes (nid, surface, labels), edges (eid, pattern, qualifiers map), incidence (eid, pos, nid, role),
patterns (pattern, ord, abstract), slots (pattern, role, repeatable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.kernels import surface_key

#: Qualifier keys with their allowed values; None for free text.
QUALIFIERS = {
    "method": ["experiment", "simulation", "theory", "review"],
    "evidence_strength": ["measured", "derived", "hypothesized", "assumed"],
    "cited_from": ["this_work", "prior_art", "definition"],
    "applies_in_regime": ["dense", "quasi-static", "inertial", "solid-like", "flow", "static", "unknown"],
    "dependency_type": ["monotonic", "derivation", "analogy", "composition"],
    "condition": None,
    "relation_type": None,
    "function_form": None,
    "parameters": None,
}

#: The seed patterns with their role slots; True marks a repeatable role.
SEED_PATTERNS = {
    "constitutive_law": [("output", True), ("input", True)],
    "influences": [("source", True), ("target", True)],
    "defines": [("subject", True), ("definition", True)],
    "composed_of": [("whole", True), ("component", True)],
    "measures": [("object", False), ("instrument", True)],
    "claim_relation": [("from", True), ("to", True)],
}


def qualifiers_valid(q: Column) -> Column:
    """COL-09: every key is registered, enum values match whatever their case, free text is not blank."""
    def one(e: Column) -> Column:
        ok = F.lit(False)
        for key, values in QUALIFIERS.items():
            fits = F.lower(e["value"]).isin(values) if values else F.trim(e["value"]) != ""
            ok = F.when(e["key"] == key, fits).otherwise(ok)
        return ok

    return F.forall(F.map_entries(q), one)


def merge_surfaces(nodes: DataFrame) -> DataFrame:
    """HG-01, HG-03: nodes (paper_id, nid, surface, labels) merged by normalised surface; the first surface stays, labels unite."""
    key = surface_key(F.col("surface"))
    return nodes.groupBy(key.alias("key")).agg(
        F.min_by("surface", F.struct("paper_id", "nid")).alias("surface"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.count_distinct("paper_id").alias("papers"),
    )


def match_patterns(incidence: DataFrame, slots: DataFrame) -> DataFrame:
    """HG-02: (eid, pattern): the first pattern whose roles are exactly the edge's, once each where not repeatable.

    slots: (pattern, ord, role, repeatable), a small table of the schema, which goes into the plan: an edge is one row of
    counts by role, from a single aggregation.
    """
    patterns: dict[tuple, dict] = {}
    for s in slots.distinct().collect():
        patterns.setdefault((s.ord, s.pattern), {})[s.role] = s.repeatable
    roles = {role: f"_n{i}" for i, role in enumerate(sorted({role for p in patterns.values() for role in p}))}
    other = F.coalesce(~F.col("role").isin(list(roles)), F.lit(True))
    have = incidence.where("eid is not null").groupBy("eid").agg(F.count_if(other).alias("_other"), *[F.count_if(F.col("role") == role).alias(n) for role, n in roles.items()])
    first = [F.lit(None).cast("string")]
    for (_, pattern), own in sorted(patterns.items()):
        fits = F.col("_other") == 0
        for role, n in roles.items():
            fits &= (F.col(n) == 0) if role not in own else (F.col(n) > 0) if own[role] else (F.col(n) == 1)
        first.insert(-1, F.when(fits, F.lit(pattern)))
    return have.select("eid", F.coalesce(*first).alias("pattern")).where("pattern is not null")


def constraint_violations(nodes: DataFrame, incidence: DataFrame, edges: DataFrame) -> DataFrame:
    """HG-04: numeric nodes in edges that define nothing, whose surface no definition edge holds."""
    placed = incidence.join(edges.select("eid", "pattern"), "eid").join(nodes.select("nid", "surface", "labels"), "nid")
    defined = placed.where("pattern = 'defines'").select("surface").distinct()
    used = placed.where("pattern != 'defines'").where(F.array_contains("labels", "NUMERIC"))
    return used.join(defined, "surface", "left_anti").select("eid", "nid", "surface")


def pattern_dependencies(nodes: DataFrame, incidence: DataFrame, edges: DataFrame) -> DataFrame:
    """HG-05: a pattern that shares a surface with a definition pattern depends on it."""
    placed = incidence.join(edges.select("eid", "pattern"), "eid").join(nodes.select("nid", "surface"), "nid").select("pattern", "surface").distinct()
    base = placed.where("pattern = 'defines'").select("surface", F.col("pattern").alias("on"))
    return placed.where("pattern != 'defines'").join(base, "surface").select("pattern", "on").distinct()


def split_triggers(edges: DataFrame, ratio: float = 0.6, cluster: int = 3) -> DataFrame:
    """HG-06: patterns whose values of a qualifier are few (distinct / total <= ratio) and form at least two clusters of enough edges."""
    q = edges.select("pattern", F.explode("qualifiers").alias("key", "value"))
    n = q.groupBy("pattern", "key", "value").agg(F.count("*").alias("n"))
    return (
        n.groupBy("pattern", "key")
        .agg(F.sum("n").alias("total"), F.count("*").alias("values"), F.count_if(F.col("n") >= cluster).alias("clusters"))
        .where((F.col("values") / F.col("total") <= ratio) & (F.col("clusters") >= 2))
    )


def split_apply(edges: DataFrame, pattern: str, key: str) -> DataFrame:
    """HG-07: edges of a pattern move to a sub-pattern named after their qualifier value."""
    new = F.concat_ws("__", F.lit(pattern), F.regexp_replace(F.lower(F.col("qualifiers")[key]), r"\W+", "_"))
    return edges.withColumn("pattern", F.when((F.col("pattern") == pattern) & F.col("qualifiers")[key].isNotNull(), new).otherwise(F.col("pattern")))


def merge_apply(edges: DataFrame, old: list[str], new: str) -> DataFrame:
    """HG-07: edges of merged patterns move to the new one."""
    if len(old) < 2:
        return edges
    return edges.withColumn("pattern", F.when(F.col("pattern").isin(old), new).otherwise(F.col("pattern")))


def merge_triggers(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """HG-08: pattern pairs (a, b, same_structure, score) similar enough (0.85, else 0.90) and not related by descent."""
    near = pairs.where(F.col("score") >= F.when(F.col("same_structure"), 0.85).otherwise(0.90))
    down = closure.select(F.col("child").alias("a"), F.col("ancestor").alias("b"))
    up = closure.select(F.col("ancestor").alias("a"), F.col("child").alias("b"))
    return near.join(down.unionByName(up), ["a", "b"], "left_anti")


def retire_triggers(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """HG-09: patterns without an edge."""
    return patterns.join(edges.select("pattern").distinct(), "pattern", "left_anti")


def enum_gaps(atoms: DataFrame, enums: DataFrame) -> DataFrame:
    """HG-12: values of atoms (layer, value) outside the layer's enum, with counts."""
    return atoms.join(enums, ["layer", "value"], "left_anti").groupBy("layer", "value").agg(F.count("*").alias("n"))


def rebind_candidates(atoms: DataFrame) -> DataFrame:
    """HG-13: surfaces with more than one type."""
    return atoms.groupBy("surface").agg(F.count_distinct("type").alias("types"), F.count("*").alias("n")).where("types > 1")


def questions(edges: DataFrame) -> DataFrame:
    """HG-14: a question for each edge by its pattern's template."""
    text = (
        F.when(F.col("pattern") == "defines", F.format_string("How is %s defined?", F.col("first")))
        .when(F.col("pattern") == "influences", F.format_string("What does %s influence?", F.col("first")))
        .when(F.col("pattern") == "measures", F.format_string("How is %s measured?", F.col("first")))
        .otherwise(F.format_string("How does %s relate to %s?", F.col("first"), F.col("second")))
    )
    return edges.withColumn("question", text)


def proposal_gate(proposals: DataFrame, known: DataFrame, cross: int = 2, total: int = 3) -> DataFrame:
    """HG-10: proposals (name, evidence, nodes, n) with evidence, not yet known, and recurring enough."""
    fresh = proposals.where(F.trim("evidence") != "").join(known.select(F.lower("name").alias("k")), F.lower(proposals["name"]) == F.col("k"), "left_anti")
    return fresh.where((F.col("nodes") >= cross) | (F.col("n") >= total))


def retrieve(edges: DataFrame, incidence: DataFrame, nodes: DataFrame, pattern: str | None = None, qualifier: tuple[str, str] | None = None, surface: str | None = None) -> DataFrame:
    """FIL-15/16: edges that meet all given filters."""
    out = edges
    if pattern:
        out = out.where(F.lower("pattern").contains(pattern.lower()))
    if qualifier:
        out = out.where(F.lower(F.col("qualifiers")[qualifier[0]]).contains(qualifier[1].lower()))
    if surface:
        hit = incidence.join(nodes.where(F.lower("surface").contains(surface.lower())).select("nid"), "nid", "left_semi")
        out = out.join(hit.select("eid").distinct(), "eid", "left_semi")
    return out
