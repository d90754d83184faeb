"""JSON payloads read by a schema, with what is wrong in the others, and claims gathered from atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"
_LINE = "paper_id string, atoms array<string>"
_ATOM = "layer string, type string, `from` string, relation string, `to` string, qualifier string"


def validated(raw: Column, schema: str, required: list[str]) -> tuple[Column, Column]:
    """COL-07: (payload, fault): the payload by its schema, null with a fault; blank, malformed (or of another type), or the first required field that is missing."""
    fields = StructType.fromDDL(schema).add(CORRUPT, "string")
    got = F.from_json(raw, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    fault = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "blank").when(got.isNull() | got[CORRUPT].isNotNull(), "malformed")
    for name in required:
        fault = fault.when(got[name].isNull(), f"missing {name}")
    kept = F.struct(*[got[f.name].alias(f.name) for f in fields if f.name != CORRUPT])
    return F.when(fault.isNull(), kept), fault


def atom_lines(lines: DataFrame) -> DataFrame:
    """SRC-13: lines (line_no, line) with paper_id, atoms (an array of JSON texts) and fault."""
    payload, fault = validated(F.col("line"), _LINE, ["paper_id", "atoms"])
    return lines.select("line_no", payload.alias("p"), fault.alias("fault")).select("line_no", "p.paper_id", "p.atoms", "fault")


def claim_relations(lines: DataFrame) -> DataFrame:
    """SRC-13: (line_no, paper_id, claim, relations array<struct<relation, to, qualifier>>): the relations of each claim of a line, in its order.

    Relations are atoms of layer L3 and type CONTRIBUTION_RELATION that name a claim; atoms that are no objects count for nothing.
    """
    atoms = atom_lines(lines).where("fault is null").select("line_no", "paper_id", F.posexplode("atoms").alias("no", "atom"))
    parsed = atoms.where(F.trim("atom").startswith("{")).withColumn("a", F.from_json("atom", _ATOM))
    held = parsed.where("a.layer = 'L3' and a.type = 'CONTRIBUTION_RELATION' and a.from != ''")
    rows = held.groupBy("line_no", "paper_id", F.col("a.from").alias("claim")).agg(F.array_sort(F.collect_list(F.struct("no", "a.relation", "a.to", "a.qualifier"))).alias("xs"))
    relations = F.transform("xs", lambda x: F.struct(x.relation.alias("relation"), x.to.alias("to"), x.qualifier.alias("qualifier")))
    return rows.select("line_no", "paper_id", "claim", relations.alias("relations"))
