"""Document fingerprints: weighted term hashes vote on signed bits, 128 of them.

Terms are pairs of adjacent words (a single word where there is only one), each weighted by its
length up to 15, so that pairs of function words count for less. Two long counters share one
64-bit sum, so 64 sums hold the votes for 128 bits; a document may have 2^32 / 15 words.

Near fingerprints are found through permuted block tables: two fingerprints within RADIUS = r bits
agree on one of r + 1 blocks, and of the bits outside that block on one of r + 1 parts. Each of the
(r + 1)^2 tables is keyed by those equal bits (39 of them for r = 5), so only close fingerprints meet
in it. Equal fingerprints form one class before that.

Only DataFrame functions run. Defined results: a null text is empty; the empty text's fingerprint
is that of the one term ''; a row without id takes no part; rows with equal ids are ordered by
text and each is fingerprinted; a table of one row is its own next document; an empty table gives
an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

MAX_WEIGHT = 15
RADIUS = 5
#: Ranges of ids in which documents meet their successors; the driver holds their bounds.
RANGES = 16_384
#: Parts in which the rows of one fingerprint are joined with its count.
PARTS = 1024
_PAIR = 0x0000000100000001


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys..., hi long, lo long): one fingerprint for each row of texts, whose keys are unique."""
    words = texts.select(*keys, F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\u000B\f\r]+").alias("words"))
    terms = words.select(
        *keys, F.explode(F.expr("transform(words, (w, i) -> if(i + 1 < size(words), concat(w, ' ', words[i + 1]), if(i = 0, w, null)))")).alias("term")
    ).where("term is not null")
    hashed = terms.select(
        *keys,
        F.xxhash64("term").alias("h0"),
        F.xxhash64("term", F.lit(1)).alias("h1"),
        F.greatest(F.lit(1), F.least(F.length("term"), F.lit(MAX_WEIGHT))).cast("long").alias("w"),
    )
    sums = [
        F.sum(F.expr(f"(shiftright(h{h}, {j}) & {_PAIR}L) * w")).alias(f"s{h}_{j}")
        for h in (0, 1)
        for j in range(32)
    ]
    votes = hashed.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    return votes.select(*keys, _signs(0).alias("hi"), _signs(1).alias("lo"))


def _signs(h: int) -> Column:
    """Bit j of the hash is set where more than half of the weight voted for it."""
    bits = []
    for j in range(32):
        low, high = f"(s{h}_{j} & 4294967295L)", f"shiftrightunsigned(s{h}_{j}, 32)"
        bits += [f"if(2 * {low} > total, {_long(1 << j)}, 0L)", f"if(2 * {high} > total, {_long(1 << (j + 32))}, 0L)"]
    return F.expr(" | ".join(bits))


def _long(x: int) -> str:
    return "shiftleft(1L, 63)" if x == 1 << 63 else f"{x}L"


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of two fingerprints given as structs of hi and lo."""
    return 1 - F.expr(f"bit_count({a}.hi ^ {b}.hi) + bit_count({a}.lo ^ {b}.lo)") / 128.0


def _bits(hi: str, lo: str, places: list[int]) -> str:
    """The bits of the fingerprint at the given places, 0 the highest of hi, as one number."""
    out, at = [], 0
    while at < len(places):
        end = at + 1
        while end < len(places) and places[end] == places[end - 1] + 1 and places[end] != 64:
            end += 1
        word, low = (hi, 63 - places[end - 1]) if places[at] < 64 else (lo, 127 - places[end - 1])
        out.append(f"shiftleft(shiftrightunsigned({word}, {low}) & {(1 << (end - at)) - 1}L, {len(places) - end})")
        at = end
    return "(" + " | ".join(out) + ")"


def _cut(places: list[int], parts: int) -> list[list[int]]:
    ends = [len(places) * i // parts for i in range(parts + 1)]
    return [places[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def block_tables(radius: int) -> list[tuple[list[int], list[int]]]:
    """(block, part): the places of the bits that key each table."""
    blocks = _cut(list(range(128)), radius + 1)
    return [(block, part) for block in blocks for part in _cut([p for p in range(128) if p not in block], radius + 1)]


def near_counts(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, n_near): for each distinct fingerprint of marks the number of other rows of marks within the radius, 3 to 7.

    Equal rows are counted by class and never paired.
    """
    if not 3 <= radius <= 7:
        raise ValueError("keys of tables hold the bits for a radius of 3 to 7")
    classes = materialize(marks.groupBy("hi", "lo").agg(F.count("*").alias("n")))
    tables, shift = block_tables(radius), max(len(b) + len(p) for b, p in block_tables(radius))
    keys = F.array(*[F.expr(f"{t << shift}L | {_bits('hi', 'lo', block + part)}") for t, (block, part) in enumerate(tables)])
    keyed = classes.select("hi", "lo", F.explode(keys).alias("key"))
    a, b = (keyed.select("key", F.col("hi").alias(f"{x}_hi"), F.col("lo").alias(f"{x}_lo")) for x in "ab")
    near = a.join(b, "key").where(F.expr("bit_count(a_hi ^ b_hi) + bit_count(a_lo ^ b_lo)") <= radius).where("a_hi < b_hi or a_hi = b_hi and a_lo < b_lo")
    pairs = near.drop("key").distinct()
    ends = pairs.select(F.explode(F.expr("array(struct(a_hi as hi, a_lo as lo, b_hi, b_lo), struct(b_hi as hi, b_lo as lo, a_hi as b_hi, a_lo as b_lo))")).alias("e")).select("e.*")
    sizes = classes.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), "n")
    others = ends.join(sizes, ["b_hi", "b_lo"]).groupBy("hi", "lo").agg(F.sum("n").alias("others"))
    return classes.join(others, ["hi", "lo"], "left").select("hi", "lo", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))


def _place(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts x reaches, by halving."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*map(F.lit, cuts)) if len(cuts) < 3 else F.lit(cuts)
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(bounds, at + step) <= x), at + step).otherwise(at))


def with_next(docs: DataFrame, rows_per_range: int = 2048) -> DataFrame:
    """(part, place, doc_id, text, next_text, last): every document, in ranges of the id, with the text of the next one.

    Each range ends with a copy of the first document of the range after it (last = true; the
    first of all after the last), so a row's successor is always in its own range. Ranges end at
    quantiles of the ids, so that they hold like numbers of rows whatever the ids; there are RANGES at most.
    """
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(RANGES, max(256, docs.count() // rows_per_range))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 8 * ranges)).first()[0] or []
    docs = docs.withColumn("part", _place(F.col("doc_id"), sorted(set(cuts))))
    firsts = docs.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")  # RANGES rows at most
    follows = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("first"))
    heads = docs.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("head")).select("head.*")
    copies = follows.join(heads, follows["first"] == heads["doc_id"]).select("doc_id", "text", "part", F.lit(True).alias("last"))
    w = Window.partitionBy("part").orderBy("last", "doc_id", "text")
    together = docs.withColumn("last", F.lit(False)).unionByName(copies)
    return together.withColumns({"place": F.row_number().over(w), "next_text": F.lead("text").over(w)})


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its text with the last quarter replaced by the next one's beginning."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(~F.col("last"), edited))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))
    keys = ["part", "place", "doc_id", "last", "n_chars", "which", "sha"]
    texts = rows.select("part", "place", "doc_id", "last", "n_chars", F.explode(both).alias("t")).where("t.text is not null")
    texts = texts.select("part", "place", "doc_id", "last", "n_chars", "t.which", F.when(F.col("t.which") == 1, F.sha2("t.text", 256)).alias("sha"), "t.text")
    # the ranges are already together, so neither this nor the next step moves rows
    marks = fingerprints(texts, keys).groupBy("part", "place", "doc_id", "last").agg(
        F.max("n_chars").alias("n_chars"),
        F.max("sha").alias("edited_sha256"),
        *[F.first(F.when(F.col("which") == i, F.struct("hi", "lo")), ignorenulls=True).alias(c) for i, c in enumerate(("own", "changed"))],
    )
    marks = marks.withColumn("next", F.lead("own").over(Window.partitionBy("part").orderBy("place")))
    marks = materialize(marks.where(~F.col("last")).select("doc_id", "n_chars", "edited_sha256", "own", "changed", "next", "own.hi", "own.lo"))
    # a class meets its count once for each part of its rows, so that no task gets all rows of a large one
    marks = marks.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    counts = marks.groupBy("hi", "lo", "part").agg(F.count("*").alias("n")).drop("n").join(near_counts(marks), ["hi", "lo"])
    counted = marks.join(counts, ["hi", "lo", "part"], "left")
    text = lambda c: F.lower(F.concat(*[F.lpad(F.hex(f"{c}.{x}"), 16, "0") for x in ("hi", "lo")]))
    return counted.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("own").alias("fingerprint"),
        text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
        "n_near",
    )
