"""Sources: Markdown lines, sections, references, chapters, content blocks and graph payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directories that a Markdown scan leaves out, and those by which a root is taken for a project's.
EXCLUDED_DIRS = [".git", ".venv", "__pycache__", "backend", "docs", "frontend", "node_modules", "dist", "runs"]
PROJECT_DIRS = ["backend", "frontend", "docs", ".git"]


def markdown_paths(files: DataFrame, root: str) -> DataFrame:
    """SRC-01: the paths of Markdown files among files (path) below a root, each once.

    READMEs, files below excluded directories and, in a project's root, files right under it go. Where any
    other file lies beside a folder images that holds files, only such files stay.
    """
    place = r"^[a-z0-9]+:(//[^/]*)?"
    base = re.sub(place, "", root).rstrip("/")
    path = F.regexp_replace("path", place, "")
    named = lambda dirs: "/(" + "|".join(d.replace(".", r"\.") for d in dirs) + ")/"
    below = files.select("path", F.when(path.startswith(base + "/"), F.substr(path, F.lit(len(base) + 1))).otherwise(path).alias("below")).distinct()
    project = below.where(F.col("below").rlike("^" + named(PROJECT_DIRS))).limit(1).count() > 0
    folder = F.regexp_replace("below", "/[^/]*$", "")
    name = F.lower(F.element_at(F.split("below", "/"), -1))
    papers = below.where(name.endswith(".md") & (name != "readme.md") & ~F.col("below").rlike(named(EXCLUDED_DIRS)))
    papers = papers.withColumn("folder", folder).where(F.lit(not project) | (F.col("folder") != ""))
    images = below.select(folder.alias("inner")).where("inner like '%/images'").select(F.regexp_replace("inner", "/images$", "").alias("folder")).distinct()
    beside = papers.join(images, "folder", "left_semi")
    return (beside if beside.limit(1).count() else papers).select("path")


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC-01: (path, text) of the Markdown files that markdown_paths finds below a root; hidden files are not listed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = markdown_paths(files.load(root).select("path"), root)
    texts = files.option("pathGlobFilter", "*.[mM][dD]").load(root).select("path", F.col("content").cast("string").alias("text"))
    return texts.join(found, "path", "left_semi")


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, content): the numbered lines of each text."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "content"))


def sections(numbered: DataFrame, key: str) -> DataFrame:
    """SRC-02: adds heading level, the running section, whether the line stands inside a code fence, and the paragraph number."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("content").rlike(r"^\s*```").cast("int")
    level = F.length(F.regexp_extract("content", r"^(#{1,6})\s", 1))
    out = numbered.withColumn("fenced", F.sum(fence).over(w) % 2 == 1).withColumn("level", F.when(F.col("fenced"), 0).otherwise(level))
    title = F.when(F.col("level") > 0, F.trim(F.regexp_replace("content", r"^#{1,6}\s+", "")))
    blank = ((F.trim("content") == "") | (F.col("level") > 0)).cast("int")
    return out.withColumns({"section": F.last(title, ignorenulls=True).over(w), "paragraph": F.sum(blank).over(w)})


def paragraphs(sectioned: DataFrame, key: str) -> DataFrame:
    """SRC-02: blocks of neighbouring lines with their span, section and text."""
    body = sectioned.where((F.col("level") == 0) & (F.trim("content") != ""))
    xs = F.array_sort(F.collect_list(F.struct("line", "content")))
    return body.groupBy(key, "paragraph").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.first("section").alias("section"), F.array_join(F.transform(xs, lambda x: x.content), "\n").alias("text")
    )


def merged_references(numbered: DataFrame, key: str) -> DataFrame:
    """SRC-02, STR-27: references that begin with [n] or n. and go on until the next one begins."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    num = F.regexp_extract("content", r"^\s*(?:\[([0-9]{1,3})\]|([0-9]{1,3})\.)\s", 0)
    n = F.regexp_extract("content", r"^\s*\[?([0-9]{1,3})[\].]\s", 1)
    marked = numbered.withColumn("ref_num", F.when(num != "", n.cast("int"))).withColumn("ref", F.sum(F.col("ref_num").isNotNull().cast("int")).over(w))
    xs = F.array_sort(F.collect_list(F.struct("line", F.trim("content").alias("content"))))
    return marked.where((F.col("ref") > 0) & (F.trim("content") != "")).groupBy(key, "ref").agg(
        F.max("ref_num").alias("ref_num"), F.array_join(F.transform(xs, lambda x: x.content), " ").alias("raw")
    )


def chapters(sectioned: DataFrame, key: str) -> DataFrame:
    """SRC-06: top headings outside code fences, with the lines they hold; what comes before is chapter 0."""
    top = Window.partitionBy(key)
    level = F.when(F.min(F.when(F.col("level") > 0, F.col("level"))).over(top) == 1, 1).otherwise(2)
    run = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = sectioned.withColumn("top", level).withColumn("chapter", F.sum((F.col("level") == F.col("top")).cast("int")).over(run))
    return marked.groupBy(key, "chapter").agg(
        F.min_by("content", "line").alias("heading"), F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count_if(F.trim("content") != "").alias("n_lines")
    )


#: How a Chinese chapter heading begins.
_CHAPTER = r"^第\s*(\$?\s*[0-9]+\s*\$?|[一二三四五六七八九十百零〇]+)\s*章"
#: Hundreds, tens and ones of a Chinese number; a mark without a digit before it counts once.
_CHINESE = "^(?:([一二三四五六七八九])?百)?[零〇]?(?:([一二三四五六七八九])?十)?([一二三四五六七八九])?$"


def chapter_number(title: Column) -> Column:
    """SRC-07: the Arabic or Chinese number of a chapter heading, below a thousand in Chinese; null without one or with a malformed one.

    After the English word any digits count.
    """
    line = F.trim(title)
    inner = F.regexp_replace(F.regexp_extract(line, _CHAPTER, 1), r"[$\s]", "")
    arabic = F.when(F.lower(line).startswith("chapter "), F.regexp_extract(line, "([0-9]+)", 1)).when(inner.rlike("^[0-9]+$"), inner)
    part = lambda g: F.regexp_extract(inner, _CHINESE, g)
    digit = lambda g: F.when(part(g) == "", 0).otherwise(F.instr(F.lit("一二三四五六七八九"), part(g)))
    times = lambda g, mark: F.when(inner.contains(mark), F.greatest(F.lit(1), digit(g))).otherwise(0)
    chinese = F.when(inner.rlike(_CHINESE), 100 * times(1, "百") + 10 * times(2, "十") + digit(3))
    return F.coalesce(arabic.try_cast("int"), F.nullif(chinese, F.lit(0)))


def block_offsets(blocks: DataFrame, key: str) -> DataFrame:
    """SRC-10: blocks (key, idx, text) of ten characters or more that are no reference lines, with running offsets."""
    kept = blocks.where((F.length("text") >= 10) & ~F.col("text").rlike(r"^\s*\[[0-9]+\]"))
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return kept.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def graph_payload(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-08: triples (start, relation, end) -> entities (id by hash, name) and relations between them."""
    ident = lambda c: F.concat(F.lit("n:"), F.substring(F.sha2(F.lower(F.trim(c)), 256), 1, 12))
    clean = triples.where((F.trim("start") != "") & (F.trim("end") != ""))
    names = clean.select(F.explode(F.array("start", "end")).alias("name"))
    entities = names.groupBy(ident(F.col("name")).alias("entity_id")).agg(F.min("name").alias("name"))
    return entities, clean.select(ident(F.col("start")).alias("source"), "relation", ident(F.col("end")).alias("target")).distinct()


def without_artefacts(nodes: DataFrame, edges: DataFrame, labels: list[str], relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-09: nodes (id, label) of artefact labels go, and edges of artefact relations or at dropped nodes."""
    kept = nodes.where(~F.col("label").isin(labels))
    ids = kept.select("id")
    inside = edges.where(~F.col("relation").isin(relations)).join(ids, edges.source == ids.id, "left_semi")
    return kept, inside.join(ids, inside.target == ids.id, "left_semi")


def figures(numbered: DataFrame, key: str) -> DataFrame:
    """SRC-05: image lines under images/ with the caption around them: the line before if it reads like one, else up to three after."""
    w = Window.partitionBy(key).orderBy("line")
    near = [F.trim(F.lead("content", i).over(w)) for i in range(1, 8)]
    path = F.regexp_extract("content", r"!\[[^\]]*\]\((images/[^)]+)\)", 1)
    before = F.trim(F.lag("content").over(w))
    after = F.array_join(F.slice(F.filter(F.array(*near), lambda x: x.isNotNull() & (x != "")), 1, 3), " ")
    rows = numbered.withColumns({"rel_path": path, "before": before, "after": after}).where(F.col("rel_path") != "")
    caption = F.when(F.col("before").rlike(r"(?i)^(figure|fig\.?|图)\s*[0-9]"), F.col("before")).otherwise(F.nullif(F.col("after"), F.lit("")))
    return rows.select(key, F.col("line").alias("img_line"), "rel_path", caption.alias("caption"), F.substring(F.sha2(F.concat_ws("|", key, "rel_path"), 256), 1, 16).alias("figure_id"))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """SRC-21: n rows in an order that a seed fixes."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)
