"""Queries of sources, text functions and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import kernels as k
from quillspark.functions import text as tx
from quillspark.plans import fixtures as fx
from quillspark.registry import register
from quillspark.session import table
from quillspark.sources import documents as s
from quillspark.streaming import events as st

_PAGES = r"""ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)"""


@register(
    "section_blocks",
    f"""WITH {_PAGES}, m AS (SELECT doc_id, line, CASE WHEN line % 5 = 0 THEN '# ' || content ELSE content END AS content FROM ls),
    l AS (SELECT *, (line % 5 = 0) AS head FROM m), w AS (SELECT *, last_value(CASE WHEN head THEN trim(regexp_replace(content, '^#{{1,6}}\\s+', '')) END IGNORE NULLS) OVER q AS section,
      sum((trim(content) = '' OR head)::INT) OVER q AS paragraph FROM l WINDOW q AS (PARTITION BY doc_id ORDER BY line))
    SELECT doc_id, min(line)::INT AS start_line, max(line)::INT AS end_line, any_value(section) AS section, string_agg(content, chr(10) ORDER BY line) AS text FROM w WHERE NOT head AND trim(content) <> '' GROUP BY doc_id, paragraph""",
)
def section_blocks(spark, d):
    """SRC-02: paragraphs under their running section; every fifth line plays the heading."""
    rows = s.lines(table(spark, d, "documents"), "doc_id").withColumn("content", F.when(F.col("line") % 5 == 0, F.concat(F.lit("# "), "content")).otherwise(F.col("content")))
    return s.paragraphs(s.sections(rows, "doc_id"), "doc_id").select("doc_id", "start_line", "end_line", "section", "text")


@register(
    "reference_merge",
    f"""WITH {_PAGES}, m AS (SELECT doc_id, line, CASE WHEN line % 3 = 1 THEN '[' || (line % 90 + 1) || '] ' || content ELSE content END AS content, line % 3 = 1 AS new FROM ls),
    w AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY line) AS ref FROM m) SELECT doc_id, max(CASE WHEN new THEN line % 90 + 1 END)::INT AS ref_num, string_agg(trim(content), ' ' ORDER BY line) AS raw FROM w WHERE ref > 0 AND trim(content) <> '' GROUP BY doc_id, ref""",
)
def reference_merge(spark, d):
    """SRC-02, STR-27: references over several lines."""
    line = F.col("line")
    content = F.when(line % 3 == 1, F.concat(F.lit("["), line % 90 + 1, F.lit("] "), "content")).otherwise(F.col("content"))
    return s.merged_references(s.lines(table(spark, d, "documents"), "doc_id").withColumn("content", content), "doc_id").select("doc_id", "ref_num", "raw")


@register(
    "reference_lines",
    r"""WITH l AS (SELECT o_orderkey, 'Ref ' || o_orderpriority || ', a study. ' || (o_orderkey % 3000) || CASE WHEN o_custkey % 2 = 0 THEN ', doi:10.1234/x' ELSE '' END AS t FROM orders)
    SELECT o_orderkey FROM l WHERE length(t) >= 12 AND regexp_matches(t, '(19|20)[0-9]{2}') AND (contains(lower(t), 'doi') OR (contains(t, ',') AND contains(t, '.')))""",
)
def reference_lines(spark, d):
    """SRC-03, EXT-30"""
    o = table(spark, d, "orders")
    t = F.concat(F.lit("Ref "), "o_orderpriority", F.lit(", a study. "), F.col("o_orderkey") % 3000, F.when(F.col("o_custkey") % 2 == 0, ", doi:10.1234/x").otherwise(""))
    return o.where(tx.looks_like_reference(t)).select("o_orderkey")


@register("block_offsets", fx.sql("chunk") + r""", b AS (SELECT paper_id, pos, text FROM chunk WHERE length(text) >= 10 AND NOT regexp_matches(text, '^\s*\[[0-9]+\]'))
    SELECT paper_id, pos, coalesce(sum(length(text) + 1) OVER (PARTITION BY paper_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM b""")
def block_offsets(spark, d):
    """SRC-10"""
    blocks = fx.chunks(spark, d).select("paper_id", F.col("pos").alias("idx"), "text")
    return s.block_offsets(blocks, "paper_id").select("paper_id", F.col("idx").alias("pos"), "start")


@register("graph_payload", "WITH t AS (SELECT c_mktsegment AS a, 'in' AS r, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT a AS name FROM t UNION SELECT b FROM t) SELECT 'n:' || substr(sha256(lower(trim(name))), 1, 12) AS entity_id, name FROM n")
def graph_payload(spark, d):
    """SRC-08"""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return s.graph_payload(c.select(F.col("c_mktsegment").alias("start"), F.lit("in").alias("relation"), F.col("n_name").alias("end")))[0]


@register("artefact_filter", "SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS relation FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY') AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY')")
def artefact_filter(spark, d):
    """SRC-09"""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"))
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relation"))
    return s.without_artefacts(nodes, edges, ["ECONOMY"], ["R"])[1]


@register("normalised_texts", r"""SELECT item_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.;。；\s]+$', '') AS text, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')))[1:24] AS fingerprint FROM benchmark""")
def normalised_texts(spark, d):
    """STR-01, STR-02, STR-26"""
    return table(spark, d, "benchmark").select("item_id", tx.norm_text(F.col("text")).alias("text"), tx.title_fingerprint(F.col("text")).alias("fingerprint"))


@register("token_lists", r"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+|[0-9]+'), lambda t: t NOT IN ('the','and','of','to','in','a','an'))) AS n_tokens,
    len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{4e00}-\x{9fff}]+'))) AS n_set, len(regexp_extract_all(lower(text), '[a-z0-9_:+./-]+|[\x{4e00}-\x{9fff}]+')) AS n_structured FROM documents""")
def token_lists(spark, d):
    """STR-03, STR-04, STR-06"""
    x = F.col("text")
    n = lambda c: F.size(c).cast("long")
    return table(spark, d, "documents").select("doc_id", n(tx.tokens(x)).alias("n_tokens"), n(tx.token_set(x)).alias("n_set"), n(tx.structured_tokens(x)).alias("n_structured"))


@register("extracted_years", r"SELECT page_id, TRY_CAST(nullif(regexp_extract(html, '\b((?:19|20)[0-9]{2})\b', 1), '') AS INT) AS year FROM pages")
def extracted_years(spark, d):
    """STR-23"""
    return table(spark, d, "pages").select("page_id", tx.year_of(F.col("html")).alias("year"))


@register("document_types", r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\b(review|survey|overview)\b') THEN 'review' WHEN regexp_matches(lower(text), '\b(theorem|proof|theory)\b') THEN 'theoretical' ELSE 'research' END AS kind FROM documents""")
def document_types(spark, d):
    """STR-21, EXT-07"""
    return table(spark, d, "documents").select("doc_id", tx.document_type(F.lit(""), F.col("text")).alias("kind"))


@register("evidence_support", r"""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{4e00}-\x{9fff}]+')) AS t FROM benchmark) SELECT item_id, len(list_intersect(t, ['the','of','thing'])) >= 1.5 AND len(list_intersect(t, ['and', 'in'])) >= 1 AS supported FROM b""")
def evidence_support(spark, d):
    """STR-19"""
    values = F.array(F.lit("the of thing"), F.lit("and in"))
    return table(spark, d, "benchmark").select("item_id", tx.supports(values, F.col("text")).alias("supported"))


_WINDOW = "substr(substr(text, {b} + 1, 3000), 1501)"
_SEGMENT = "CASE WHEN {b} + 3000 >= length(text) THEN length(text) " + " ".join(
    f"WHEN contains({_WINDOW}, {m}) THEN {{b}} + 1500 + length({_WINDOW}) - strpos(reverse({_WINDOW}), reverse({m})) + 1"
    for m in ("chr(10) || chr(10)", "chr(10)", "'</tr>'", "'</p>'", "'. '", "'; '", "' '", "'><'")
) + " ELSE {b} + 3000 END"
_NEXT = "greatest(beg + 1, til - 150)"


@register(
    "text_segments",
    f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM documents), c(doc_id, text, beg, til, no) AS (SELECT doc_id, text, 0::BIGINT, {_SEGMENT.format(b="0")}, 0 FROM t WHERE text <> ''
      UNION ALL SELECT doc_id, text, {_NEXT}, {_SEGMENT.format(b=_NEXT)}, no + 1 FROM c WHERE til < length(text)),
    p AS (SELECT doc_id, no, regexp_replace(substr(text, beg + 1, til - beg), '^\\s+|\\s+$', '', 'g') AS segment FROM c)
    SELECT doc_id, (count(*) OVER (PARTITION BY doc_id))::INT AS segment_count, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INT AS segment_index, segment FROM p WHERE segment <> ''""",
)
def text_segments(spark, d):
    """STR-14, STR-15, SINK-18"""
    return k.segmented(table(spark, d, "documents").select("doc_id", "text"), most=3000, overlap=150)


_TAIL = "substr(text, {b} + 1501, 4500)"
_ENDS = "CASE WHEN {b} + 3000 >= length(text) THEN length(text) " + " ".join(
    f"WHEN contains({_TAIL}, '{m}') THEN {{b}} + 1500 + length({_TAIL}) - strpos(reverse({_TAIL}), reverse('{m}'))" for m in (". ", "? ", "! ")
) + " ELSE least({b} + 3200, length(text)) END"


@register(
    "sentence_chunks",
    f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c(doc_id, text, beg, til, no) AS (SELECT doc_id, text, 0::BIGINT, {_ENDS.format(b="0")}, 0 FROM t
      UNION ALL SELECT doc_id, text, til, {_ENDS.format(b="til")}, no + 1 FROM c WHERE til < length(text)),
    p AS (SELECT doc_id, no, length(text) AS n, substr(text, beg + 1, til - beg) AS chunk FROM c)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INT AS chunk_index, md5(chunk) AS chunk FROM p WHERE n <= 3000 OR regexp_replace(chunk, '\\s+', '', 'g') <> ''""",
)
def sentence_chunks(spark, d):
    """STR-15: the documents in pieces that end with sentences."""
    return k.sentence_chunked(table(spark, d, "documents").select("doc_id", "text"), most=3000).withColumn("chunk", F.md5("chunk"))


@register(
    "surface_norms",
    r"""SELECT item_id, trim(regexp_replace(lower(text), '[\s\-_]+', ' ', 'g'), ' .,;:()') AS surface, trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g')) AS matchable FROM benchmark""",
)
def surface_norms(spark, d):
    """STR-10, STR-11"""
    return table(spark, d, "benchmark").select("item_id", k.norm_surface("text").alias("surface"), k.norm_for_match("text").alias("matchable"))


@register("quote_spans")
def quote_spans(spark, d):
    """STR-08: the first sentence of each passage, searched in the passage with other white space."""
    q = F.upper(F.substring(F.split_part("text", F.lit("."), F.lit(1)), 1, 100))
    return table(spark, d, "benchmark").select("item_id", k.quote_span(q, F.regexp_replace("text", " ", "  ")).alias("span")).select("item_id", "span.*")


@register("events_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    """Streaming: tumbling windows over the event stream, run to the end of what is there."""
    out = st.run_to_end(st.tumbling_counts(st.event_stream(spark, d), "1 day", "1 hour"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(
    "events_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k""",
)
def events_session(spark, d):
    """Streaming: sessions by gap, on the batch side of the same operator."""
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sessions(ev, "6 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("incremental_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def incremental_counts(spark, d):
    """VEC-04 as a stream: a table brought up to date by every batch."""

    def update(old, new):
        fresh = new.groupBy("user_id").agg(F.count("*").alias("n"))
        return fresh if old is None else old.unionByName(fresh).groupBy("user_id").agg(F.sum("n").alias("n"))

    return st.upsert_each_batch(st.event_stream(spark, d), update)


@register("run_chunk_scan", fx.sql("chunk") + " SELECT chunk_id FROM chunk WHERE kind <> 'heading' AND paper_id IN (SELECT doc_id FROM labels)")
def run_chunk_scan(spark, d):
    """SRC-11, SRC-16, SRC-17: chunks of known papers."""
    known = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"))
    return fx.chunks(spark, d).where("kind != 'heading'").join(known, "paper_id", "left_semi").select("chunk_id")


@register("priority_chunks", fx.sql("chunk") + ", p AS (SELECT chunk_id, pos, paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY (contains(text, 'the'))::INT DESC, pos)::INT AS rank FROM chunk) SELECT chunk_id, rank FROM p WHERE rank <= 40")
def priority_chunks(spark, d):
    """EXT-01, EXT-02: evidence chunks first, then the rest, forty of each paper."""
    first = F.desc(F.col("text").contains("the").cast("int"))
    return fx.chunks(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(first, "pos"))).where("rank <= 40").select("chunk_id", "rank")


@register(
    "chapter_numbers",
    """WITH n AS (SELECT p_partkey, p_partkey % 4 AS form, CASE p_partkey % 4 WHEN 2 THEN p_partkey % 999 + 1 ELSE p_partkey % 400 END AS n FROM part)
    SELECT p_partkey, form, CASE WHEN form < 3 THEN n END::INT AS number FROM n""",
)
def chapter_numbers(spark, d):
    """SRC-07: English, Arabic and Chinese headings, and ones without a number."""
    k = F.col("p_partkey")
    n = k % 999 + 1
    digit = lambda c: F.when(c == 0, "").otherwise(F.substr(F.lit("一二三四五六七八九"), c.cast("int"), F.lit(1)))
    ones, tens, hundreds = n % 10, F.floor(n / 10) % 10, F.floor(n / 100)
    ten = F.when(tens > 0, F.concat(F.when((tens == 1) & (hundreds == 0), "").otherwise(digit(tens)), F.lit("十"))).otherwise(F.when((hundreds > 0) & (ones > 0), "零").otherwise(""))
    chinese = F.concat(F.when(hundreds > 0, F.concat(digit(hundreds), F.lit("百"))).otherwise(""), ten, digit(ones))
    arabic = (k % 400).cast("string")
    title = F.when(k % 4 == 0, F.concat(F.lit("Chapter "), arabic, F.lit(": flows"))).when(k % 4 == 1, F.concat(F.lit("第 $"), arabic, F.lit("$ 章")))
    title = title.when(k % 4 == 2, F.concat(F.lit("第"), chinese, F.lit("章 流"))).otherwise(F.lit("Appendix 3"))
    return table(spark, d, "part").select("p_partkey", (k % 4).alias("form"), s.chapter_number(title).alias("number"))


@register("markdown_paths", "SELECT '/data/lib/p' || page_id || '/paper.md' AS path FROM pages")
def markdown_paths(spark, d):
    """SRC-01: the papers among the files of a project: those beside their images, outside of excluded directories."""
    names = ["p%d/paper.md", "p%d/images/1.png", "p%d/README.md", "n%d/notes.md", "node_modules/n%d/images/1.png", "node_modules/n%d/x.md"]
    files = F.array(*[F.format_string("file:/data/lib/" + n, "page_id") for n in names], F.lit("file:/data/lib/docs/a.md"), F.lit("file:/data/lib/root.md"), F.lit("file:/data/lib/images/r.png"))
    found = s.markdown_paths(table(spark, d, "pages").select(F.explode(files).alias("path")), "/data/lib/")
    return found.select(F.replace("path", F.lit("file:"), F.lit("")).alias("path"))


#: A sentence, and how its bytes read under another code.
_SENTENCE = "引言，摘要，方法。，"
_MISREAD = _SENTENCE.encode().decode("gb18030")


@register("mojibake_recovery", f"SELECT c_custkey, '{_SENTENCE}' || c_name AS text FROM customer")
def mojibake_recovery(spark, d):
    """STR-09: names after a sentence, read wrongly for two thirds of them."""
    lead = F.when(F.col("c_custkey") % 3 > 0, _MISREAD).otherwise(F.lit(_SENTENCE))
    return table(spark, d, "customer").select("c_custkey", k.recover_mojibake(F.concat(lead, "c_name")).alias("text"))


@register("events_first", "SELECT DISTINCT user_id, event_type FROM events")
def events_first(spark, d):
    """Streaming: the first event of each user and type ; a key leaves the state two days behind the latest event."""
    first = st.distinct_first(st.event_stream(spark, d), ["user_id", "event_type"], "2 days")
    return st.run_to_end(first, "append").select("user_id", "event_type")
