"""The domain tables of the engine, derived from the driver's tables, in Spark and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import table

#: Fixed value: the steps of a research paper, in order.
STEPS = ["Background", "Problem", "Method", "Experiment", "Result", "Conclusion"]
_STEP_SQL = "['" + "','".join(STEPS) + "']"


def papers(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, title, paper_source, collection_id, year): one for each document."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("paper_id"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("paper_source"),
        F.col("lang").alias("collection_id"),
        (F.lit(2000) + F.col("n_chars") % 25).cast("int").alias("year"),
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, paper_id, paper_source, pos, text, kind): the lines of each document; short ones without a full stop are headings."""
    lines = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select(
        F.concat_ws(":", "doc_id", "pos").alias("chunk_id"),
        F.col("doc_id").alias("paper_id"),
        F.col("source").alias("paper_source"),
        "pos",
        "text",
        F.when((F.length("text") < 40) & ~F.col("text").contains("."), "heading").otherwise("block").alias("kind"),
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    """(claim_id, paper_id, step_type, text, confidence, kinds, chunk_id, pos): the non-blank blocks."""
    steps = F.array(*[F.lit(s) for s in STEPS])
    kinds = F.array(F.lit("Method"), F.lit("Gap"), F.lit("Result"), F.lit("Limitation"))
    return (
        chunks(spark, d)
        .where((F.col("kind") == "block") & (F.trim("text") != ""))
        .select(
            F.concat(F.lit("c"), "chunk_id").alias("claim_id"),
            "paper_id",
            "paper_source",
            steps[F.col("pos") % len(STEPS)].alias("step_type"),
            "text",
            (F.length("text") % 101 / 100).alias("confidence"),
            F.when(F.length("text") % 3 == 0, F.array(kinds[F.length("text") % 4])).otherwise(
                F.array(kinds[F.length("text") % 4], kinds[(F.length("text") + 1) % 4])
            ).alias("kinds"),
            "chunk_id",
            "pos",
        )
    )


def logic_steps(spark: SparkSession, d: str) -> DataFrame:
    """(logic_step_id, paper_id, step_type, step_order, summary): the first claim of each paper and step."""
    order = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("step_type")).cast("int")
    first = claims(spark, d).groupBy("paper_id", "step_type").agg(F.min_by("text", "pos").alias("summary"))
    return first.select(F.concat_ws(":", "paper_id", "step_type").alias("logic_step_id"), "paper_id", "step_type", order.alias("step_order"), "summary")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, name, entity_type, chapter): parts."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("chapter")
    )


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, chunk, ref_num): one row for each line item, citing its supplier."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("ref_num")
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, paper_id, vec): embeddings; another label is another paper."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").alias("paper_id"), F.col("embedding").alias("vec"))


SQL = {
    "paper": "SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, source AS paper_source, lang AS collection_id, (2000 + n_chars % 25)::INT AS year FROM documents",
    "chunk": """SELECT doc_id || ':' || (pos - 1) AS chunk_id, doc_id AS paper_id, source AS paper_source, (pos - 1)::INT AS pos, text,
      CASE WHEN length(text) < 40 AND NOT contains(text, '.') THEN 'heading' ELSE 'block' END AS kind
      FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)""",
    "claim": f"""SELECT 'c' || chunk_id AS claim_id, paper_id, paper_source, ({_STEP_SQL})[pos % 6 + 1] AS step_type, text, (length(text) % 101) / 100.0::DOUBLE AS confidence,
      CASE WHEN length(text) % 3 = 0 THEN [(['Method','Gap','Result','Limitation'])[length(text) % 4 + 1]]
      ELSE [(['Method','Gap','Result','Limitation'])[length(text) % 4 + 1], (['Method','Gap','Result','Limitation'])[(length(text) + 1) % 4 + 1]] END AS kinds,
      chunk_id, pos FROM chunk WHERE kind = 'block' AND trim(text) <> ''""",
    "step": f"""SELECT paper_id || ':' || step_type AS logic_step_id, paper_id, step_type, list_position({_STEP_SQL}, step_type)::INT AS step_order, arg_min(text, pos) AS summary
      FROM claim GROUP BY paper_id, step_type""",
    "entity": "SELECT p_partkey AS entity_id, p_name AS name, p_type AS entity_type, p_brand AS chapter FROM part",
    "mention": "SELECT o_custkey AS src, l_suppkey AS dst, l_orderkey AS chunk, l_linenumber AS ref_num FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "vector": "SELECT vec_id AS node_id, label AS paper_id, embedding AS vec FROM embeddings",
}


def sql(*names: str) -> str:
    """WITH clauses of the named fixtures and those they stand on; a query or further clauses follow."""
    needed = {"step": ["chunk", "claim", "step"], "claim": ["chunk", "claim"]}
    order: list[str] = []
    for n in names:
        order += [x for x in needed.get(n, [n]) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)


#: A layered graph over all parts: edges to the next parts, none out of a block of 32 keys, so that its paths stay short in any table.
LAYERS = """e AS (SELECT DISTINCT p_partkey AS src, dst FROM (SELECT p_partkey, unnest([p_partkey + p_size % 7 + 1, p_partkey + 3]) AS dst FROM part) WHERE p_partkey // 32 = dst // 32)"""


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ends = table(spark, sf_dir, "part").select(k.alias("src"), F.explode(F.array(k + F.col("p_size") % 7 + 1, k + 3)).alias("dst"))
    return ends.where("src div 32 = dst div 32").distinct()
