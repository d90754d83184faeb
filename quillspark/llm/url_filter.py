"""URL filters: path rules, and exact host lists held in a cascade of Bloom filters.

Level 0 encodes the listed keys. Level 1 encodes the unlisted keys of the complete key
universe that level 0 lets through, level 2 the listed keys that level 1 lets through, and so
on until a level lets nothing wrong through. A lookup stops at the first level that rejects
the key; the level's parity is the answer, which is exact for every key of the universe.
Only DataFrame functions are used. A filter reaches the tasks as one array through an
uncorrelated scalar subquery, so no rows are joined. A list whose first level would take more
than MAX_BITS is too large to send to every task: its keys are joined by a shuffle, with the same answers.

Defined results: a null url, or one without "://", has an empty host and path; a null or empty key is
never listed; repeated rows are judged each on its own; an empty list or universe lists nothing;
columns of the input stay, except those named like an output, which are replaced.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize

#: A level's bits, 32 MB, go to every task.
MAX_BITS = 1 << 28


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first "://" to "/", "?", "#" or the end, A-Z lower-cased; path from there to "?" or "#"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the few (verdict, "host/path") rules that fits; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        of, _, below = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        array = self.words.scalar()
        at = [F.floor(p / 64).cast("int") + 1 for p in _positions(key, self)]
        bit = [F.pmod(p, F.lit(64)).cast("int") for p in _positions(key, self)]
        one = F.lit(1).cast("long")
        return reduce(
            lambda a, b: a & b,
            [F.call_function("shiftright", F.element_at(array, i), b).bitwiseAND(one) == 1 for i, b in zip(at, bit, strict=True)],
        )


def _positions(key: Column, level: Level) -> list[Column]:
    first, second = F.xxhash64(key, F.lit(2 * level.seed)), F.xxhash64(key, F.lit(2 * level.seed + 1)).bitwiseOR(F.lit(1).cast("long"))
    # the step is kept small, so that the sum of a few of them stays within a long
    start, step = F.shiftrightunsigned(first, 8), F.shiftrightunsigned(second, 16)
    return [F.pmod(start + step * F.lit(j), F.lit(level.bits)) for j in range(level.hashes)]


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """Whether the key is listed; exact for keys of the universe, false for null."""
        answer: Column = F.lit(bool(self.levels) and len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[k].holds(key), F.lit(k % 2 == 1)).otherwise(answer)
        return F.when(key.isNull(), F.lit(False)).otherwise(answer)


def build_cascade(universe: DataFrame, first_bits: int = 8, further_bits: int = 4, max_bits: int = MAX_BITS) -> Cascade | None:
    """universe: (key string, listed boolean), every key once. None where a level would be larger than max_bits.

    Each level is one pass over the keys that are still undecided, which shrink geometrically.
    """
    undecided = materialize(universe.where(F.col("key").isNotNull()).select("key", "listed"))
    levels: list[Level] = []
    while True:
        k = len(levels)
        inside = F.col("listed") == F.lit(k % 2 == 0)
        encoded, other = undecided.agg(F.count_if(inside), F.count_if(~inside)).first()
        if not encoded:
            break
        bits = -(-max(64, encoded * (first_bits if k == 0 else further_bits)) // 64) * 64
        if bits > max_bits:
            return None
        level = Level(undecided, bits, 5 if k == 0 else 3, k)
        spots = undecided.where(inside).select(F.explode(F.array(*_positions(F.col("key"), level))).alias("at"))
        words = spots.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("set")
        )
        # every word that no key sets is a zero of the dense array; one row of at most max_bits
        zeros = undecided.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
        dense = words.unionByName(zeros).groupBy("word").agg(F.bit_or("set").alias("set"))
        level.words = materialize(dense.agg(F.array_sort(F.collect_list(F.struct("word", "set"))).getField("set").alias("words")))
        levels.append(level)
        if not other:
            break
        undecided = materialize(undecided.where(inside | level.holds(F.col("key"))))
        if not undecided.where(~inside).limit(1).count():
            break
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: Column, url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """Adds host, path, rule and verdict. Where no rule fits, hosts for which the aggregate `listed`
    (over the columns of pages with host and path) holds are blocked, through a cascade over all hosts of pages."""
    host, path = url_parts(F.col(url_col))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    universe = parsed.where("host != ''").groupBy(F.col("host").alias("key")).agg(F.coalesce(listed, F.lit(False)).alias("listed"))
    cascade = build_cascade(universe, max_bits=max_bits)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    if cascade:
        held = (F.col("host") != "") & cascade.holds(F.col("host"))
    else:  # a hot host's pages can be split between tasks
        own = max(parsed.columns, key=len) + "_key"  # no column of the input has a name as long
        keys = materialize(universe.where("listed").select(F.col("key").alias(own)))
        parsed = parsed.join(keys, F.col("host") == F.col(own), "left")
        held = F.col(own).isNotNull()
    out = parsed.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(held, "block").otherwise("allow"))})
    return out if cascade else out.drop(own)


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Hosts that served a tracked url are the list; one row for each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge_urls(pages, RULES, F.bool_or(F.col("url").contains("utm_source=") | F.col("host").contains("spam-farm")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH rest AS (
  SELECT page_id, url,
         CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, url,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
hosts AS (
  SELECT host, host <> '' AND coalesce(bool_or(contains(url, 'utm_source=') OR contains(host, 'spam-farm')), false) AS listed
  FROM parts GROUP BY host),
ruled AS (
  SELECT p.page_id, p.host, p.path, h.listed,
    CASE WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(p.path, '/en/') THEN 'example.net/en/'
         WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(p.path, '/de/') THEN 'example.com/de/'
         WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(p.path, '/fr/') THEN 'org/fr/'
         WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(p.path, '/') THEN 'net/' END AS rule
  FROM parts p JOIN hosts h USING (host))
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'net/' THEN 'block' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""
