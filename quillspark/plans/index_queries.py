"""Queries over persisted indexes: vectors of four corpora, words of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import corpus_index as ci
from quillspark.operators import lexical_index as li
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import shared_folder, table

#: The embedder of these queries: the shares of eight letters. A model takes its place outside.
LETTERS = "etaonisr"


def letter_shares(texts: list[str]) -> list[list[float]]:
    return [[t.count(c) / max(1, len(t)) for c in LETTERS] for t in texts]


def corpora(spark, d):
    """The four corpora of a rebuild: chunks, logic steps, claims, and communities (a source's papers of one year)."""
    papers = fx.papers(spark, d)
    nothing = F.lit(None).cast("string")
    chunk = fx.chunks(spark, d).select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), "paper_source", F.to_json(F.struct("pos")).alias("meta"), "text")
    steps = fx.logic_steps(spark, d).join(papers.select("paper_id", "paper_source"), "paper_id")
    step = steps.select(F.col("logic_step_id").alias("id"), F.lit("logic_step").alias("kind"), "paper_source", F.to_json(F.struct("paper_id", "step_type")).alias("meta"), F.col("summary").alias("text"))
    claim = fx.claims(spark, d).select(F.col("claim_id").alias("id"), F.lit("claim").alias("kind"), "paper_source", F.to_json(F.struct("paper_id", "step_type", "confidence")).alias("meta"), "text")
    groups = papers.groupBy("paper_source", "year").agg(F.concat_ws(" ", F.min("title"), F.max("title")).alias("text"))
    community = groups.select(F.concat_ws(":", "paper_source", "year").alias("id"), F.lit("community").alias("kind"), nothing.alias("paper_source"), nothing.alias("meta"), "text")
    return {"chunks": chunk, "logic_steps": step, "claims": claim, "communities": community}


#: Segments of long texts: windows of 6000 that end behind the strongest mark in their second half, each 300 before the last one's end.
_TAIL = "substr(substr(text, beg + 1, 6000), 3001)"
_CUTS = " ".join(
    f"WHEN contains({_TAIL}, {m}) THEN beg + 3000 + length({_TAIL}) - strpos(reverse({_TAIL}), reverse({m})) + 1"
    for m in ["chr(10) || chr(10)", "chr(10)", "'</tr>'", "'</p>'", "'. '", "'; '", "' '", "'><'"]
)
_CORPORA = (
    fx.sql("step", "paper")
    + f""", community AS (SELECT paper_source || ':' || year AS id, min(title) || ' ' || max(title) AS text FROM paper GROUP BY paper_source, year),
    raw AS (SELECT 'chunks' AS corpus, chunk_id AS id, 'chunk' AS kind, paper_source, text FROM chunk UNION ALL SELECT 'claims', claim_id, 'claim', paper_source, text FROM claim
      UNION ALL SELECT 'logic_steps', logic_step_id, 'logic_step', paper_source, summary FROM step JOIN paper USING (paper_id) UNION ALL SELECT 'communities', id, 'community', NULL, text FROM community),
    rows AS (SELECT corpus, id, kind, paper_source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM raw),
    seg(corpus, id, kind, paper_source, text, beg, til, no) AS (
      SELECT *, 0::BIGINT, CASE WHEN length(text) <= 6000 THEN length(text) {_CUTS.replace("beg + ", "0 + ")} ELSE 6000 END, 0 FROM rows WHERE text <> ''
      UNION ALL SELECT corpus, id, kind, paper_source, text, beg, CASE WHEN beg + 6000 >= length(text) THEN length(text) {_CUTS} ELSE beg + 6000 END, no
        FROM (SELECT * REPLACE (greatest(beg + 1, til - 300) AS beg, no + 1 AS no) FROM seg WHERE til < length(text))),
    segments AS (SELECT corpus, id, kind, paper_source, no, regexp_replace(substr(text, beg + 1, til - beg), '^\\s+|\\s+$', '', 'g') AS text FROM seg)"""
).replace("WITH ", "WITH RECURSIVE ", 1)


def _shares(x: str) -> str:
    return "[" + ", ".join(f"(length({x}) - length(replace({x}, '{c}', '')))::DOUBLE / greatest(1, length({x}))" for c in LETTERS) + "]"


@register("index_rebuild", _CORPORA + " SELECT corpus, count(DISTINCT id) AS rows_indexed, count(*) AS segments_indexed FROM segments GROUP BY corpus")
def index_rebuild(spark, d):
    """SINK-18, EXT-20: four corpora cut into segments, embedded and stored anew, with their counts."""
    return ci.build_index(corpora(spark, d), letter_shares, shared_folder(spark, "index"))


@register(
    "corpus_search",
    _CORPORA
    + rf""", v AS (SELECT *, {_shares("text")} AS vec FROM segments WHERE corpus IN ('claims', 'logic_steps')), q AS (SELECT item_id AS qid, text, {_shares("text")} AS vec FROM benchmark),
    near AS (SELECT qid, corpus, kind, id, paper_source, round(list_sum(list_transform(list_zip(q.vec, v.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS score, no FROM q, v),
    k AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY qid, corpus ORDER BY score, id, no) <= 8),
    hit AS (SELECT qid, corpus, kind, id, paper_source, max(score) AS score, 'vector' AS mode FROM k GROUP BY ALL),
    t AS (SELECT id, paper_source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_:+./-]+|[\x{{4e00}}-\x{{9fff}}]+')) AS t FROM rows WHERE corpus = 'communities' AND trim(text) <> ''),
    w AS (SELECT qid, regexp_extract_all(lower(text), '[a-z0-9_:+./-]+|[\x{{4e00}}-\x{{9fff}}]+') AS w FROM q),
    lex AS (SELECT qid, 'communities' AS corpus, 'community' AS kind, id, paper_source, round(len(list_filter(w, lambda x: list_contains(t, x))) / greatest(1, len(list_distinct(w)))::DOUBLE, 9) AS score, 'lexical' AS mode FROM w, t)
    SELECT *, row_number() OVER (PARTITION BY qid, corpus ORDER BY score DESC, coalesce(paper_source, ''), id)::INT AS rank FROM (FROM hit UNION ALL FROM lex) QUALIFY rank <= 8""",
)
def corpus_search(spark, d):
    """VEC-07: the passages of the benchmark asked of claims and steps by vector, and of communities, which have no index here, by their words."""
    rows = corpora(spark, d)
    folder = shared_folder(spark, "index")
    ci.build_index({c: rows[c] for c in ("claims", "logic_steps")}, letter_shares, folder)
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    found = [ci.search_corpus(questions, folder, c, rows[c], 8, letter_shares).withColumn("corpus", F.lit(c)) for c in ("claims", "logic_steps", "communities")]
    return found[0].unionByName(found[1]).unionByName(found[2])


_TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z]+|[0-9]+'), lambda x: x NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'an'))"


def _evidence(units: str) -> str:
    """(unit_id, chunk_id, score, place) of units (unit_id, paper_id, query) over the blocks of their papers."""
    return f"""units AS ({units}), tk AS (SELECT unit_id, paper_id, t, count(*) AS times FROM (SELECT unit_id, paper_id, unnest(CASE WHEN len({_TOKENS.format("query")}) > 0 THEN {_TOKENS.format("query")} ELSE [lower(trim(query))] END) AS t FROM units) WHERE t <> '' GROUP BY ALL),
    b AS (SELECT chunk_id, paper_id, pos, lower(text) AS text FROM chunk WHERE kind = 'block' AND trim(text) <> ''),
    met AS (SELECT paper_id, t, chunk_id, pos, (length(text) - length(replace(text, t, ''))) // length(t) AS n FROM (SELECT DISTINCT paper_id, t FROM tk) JOIN b USING (paper_id) WHERE contains(text, t)),
    s AS (SELECT unit_id, chunk_id, any_value(pos) AS pos, round(sum(times * (1 + 0.3::DOUBLE * least(5, n))), 6) AS score FROM tk JOIN met USING (paper_id, t) GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, pos, chunk_id) AS place FROM s QUALIFY place <= 2)"""


@register(
    "step_evidence_index",
    fx.sql("step") + ", " + _evidence("SELECT logic_step_id AS unit_id, paper_id, summary AS query FROM step")
    + """ SELECT u.unit_id, coalesce(string_agg(chunk_id, ';' ORDER BY place), '') AS chunk_ids, max(score) AS score, coalesce(max(score), 0) < 2.0 AND any_value(trim(query)) <> '' AS weak FROM units u LEFT JOIN best USING (unit_id) GROUP BY 1""",
)
def step_evidence_index(spark, d):
    """EXT-05, STR-17: each step's two best blocks by its own tokens, through an inverted index."""
    units = fx.logic_steps(spark, d).select(F.col("logic_step_id").alias("unit_id"), "paper_id", F.col("summary").alias("query"))
    found = li.lexical_evidence(units, _blocks(spark, d), "paper_id")
    return found.select("unit_id", F.array_join("chunk_ids", ";").alias("chunk_ids"), "score", "weak")


def _blocks(spark, d):
    return fx.chunks(spark, d).where("kind = 'block' and trim(text) != ''").select("chunk_id", "paper_id", "pos", "text")


@register(
    "claim_evidence",
    fx.sql("claim") + ", " + _evidence("SELECT claim_id AS unit_id, paper_id, text AS query FROM claim WHERE pos % 3 <> 0")
    + """, all_ids AS (SELECT unit_id, string_agg(chunk_id, ';' ORDER BY place) AS ids FROM best GROUP BY 1)
    SELECT claim_id, CASE WHEN pos % 3 = 0 THEN chunk_id ELSE coalesce(ids, '') END AS chunk_ids, pos % 3 <> 0 AND ids IS NOT NULL AS weak FROM claim LEFT JOIN all_ids ON unit_id = claim_id""",
)
def claim_evidence(spark, d):
    """EXT-05: a third of the claims with a model's pick, the others by their own tokens."""
    claims = fx.claims(spark, d)
    # a claim with a pick asks nothing
    units = claims.select(F.col("claim_id").alias("unit_id"), "paper_id", F.when(F.col("pos") % 3 != 0, F.col("text")).alias("query"))
    picked = claims.where("pos % 3 = 0").select(F.col("claim_id").alias("unit_id"), F.array("chunk_id").alias("chunk_ids"), F.lit(False).alias("weak"))
    found = li.claim_evidence(units, _blocks(spark, d), picked, "paper_id")
    return found.select(F.col("unit_id").alias("claim_id"), F.array_join("chunk_ids", ";").alias("chunk_ids"), "weak")
