"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds of the base (email, ip, card, phone) stand on their pattern and validator alone: context
only raises their score. Added kinds (iban, secret, ssn) count from MIN_SCORE on: an IBAN by its
mod-97 remainder, a secret or social security number by words shortly before it.

Only SQL functions run. A pattern's matches and the pieces between them give every position by a
running sum of lengths. It is taken in blocks of as many matches as there are blocks, since every
step of a running sum copies what was found before: m matches cost m to the power of 1.5. Patterns are possessive, so that no
text, however long, recurses in the matcher; a look-behind keeps a run of characters from being
tried again from each of its positions. \\G lets a match start right behind the one before.

Defined results: a null text is empty and has no spans; repeated rows are each judged; an empty
table gives an empty one; other columns of the input stay, except those named like an output or
beginning with __m_, __p_ or __b_ and a kind, which are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.7
CONTEXT_CHARS = 32


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without a match of this cheap pattern has no span of the kind
    valid: str  # SQL over t.m, the matched text
    prior: float  # score of a valid match
    words: str  # context words, which add 0.4
    base: bool = False


_DIGITS = "regexp_replace(t.m, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + (
  int(substring({_DIGITS}, -i, 1)) * if(i % 2 = 0, 2, 1)
  - if(i % 2 = 0 and int(substring({_DIGITS}, -i, 1)) > 4, 9, 0))) % 10 = 0"""
_IBAN = "regexp_replace(t.m, ' ', '')"
_MOD97 = f"""length({_IBAN}) between 15 and 34 and
aggregate(split(substring({_IBAN}, 5) || left({_IBAN}, 4), ''), 0, (a, c) -> if(c = '', a,
  if(c >= '0' and c <= '9', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97))) = 1"""

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9, "mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]",
         "not exists(split(t.m, '[.]'), x -> not (x rlike '^0*+$' or regexp_replace(x, '^0++', '') rlike '^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$'))",
         0.7, "ip|host|address|server", True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", _LUHN, 0.8, "card|credit|visa|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", f"length({_DIGITS}) between 9 and 15", 0.8, "phone|call|tel|mobile", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", _MOD97, 0.8, "iban|account|bank|konto"),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", r"(?i)token|secret|password|passwd|api.?key", "t.m rlike '[0-9]' and t.m rlike '[A-Za-z]'", 0.4, r"(?:token|secret|password|passwd|api.?key)\W{0,6}$"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"(?i)ssn|social.security", "left(t.m, 3) not in ('000', '666')", 0.4, "ssn|social.security"),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _blocks(kind: Kind) -> Column:
    """Where each block of matches of one kind begins in the text: the sums of what lies before it."""
    m, p = f"__m_{kind.name}", f"__p_{kind.name}"
    length = f"aggregate(sequence(k * {_WIDTH.format(m)} + 1, least(size({m}), (k + 1) * {_WIDTH.format(m)})), 0, (a, i) -> a + length({p}[i - 1]) + length({m}[i - 1]))"
    lengths = f"transform(sequence(0, cast(ceil(size({m}) / {_WIDTH.format(m)}) as int) - 1), k -> {length})"
    return F.expr(f"if(size({m}) > 0, aggregate({lengths}, array(0), (a, x) -> array_append(a, element_at(a, -1) + x)), array())")


#: Matches in a block.
_WIDTH = "cast(ceil(sqrt(size({}))) as int)"


def _spans(kind: Kind, no: int) -> Column:
    """Valid spans of one kind, in order; __m_<kind>, __p_<kind> and __b_<kind> hold the matches, the pieces around them and the blocks."""
    m, p, b = (f"__{c}_{kind.name}" for c in "mpb")
    words = kind.words if kind.words.startswith("(?i)") else f"(?i){kind.words}"
    score = f"least(1.0D, {kind.prior}D + if(right(t.c, {CONTEXT_CHARS}) rlike {_quoted(words)}, 0.4D, 0.0D))"
    keep = f"({kind.valid})" + ("" if kind.base else f" and {score} >= {MIN_SCORE}D")
    # s: the place reached and the spans so far; t: the next match, the piece before it and its place
    step = f"""transform(
      array(struct(element_at({m}, i) as m, element_at({p}, i) as c, s.at + length(element_at({p}, i)) as start)),
      t -> struct(t.start + length(t.m) as at,
        if({keep}, array_append(s.spans, struct({no} as kind, t.start as start, t.start + length(t.m) as end, {score} as score)), s.spans) as spans))[0]"""
    none = "cast(array() as array<struct<kind:int,start:int,end:int,score:double>>)"
    block = f"""aggregate(sequence(k * {_WIDTH.format(m)} + 1, least(size({m}), (k + 1) * {_WIDTH.format(m)})),
      struct({b}[k] as at, {none} as spans), (s, i) -> {step}, s -> s.spans)"""
    return F.expr(f"if(size({m}) > 0, flatten(transform(sequence(0, size({b}) - 2), k -> {block})), {none})")


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Adds `out`: array<struct<kind int, start int, end int, score double>>, ordered by kind and start.

    kind indexes KINDS; start and end count code points, end exclusive.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.drop(out)
    for k in KINDS:
        has = text.contains(k.needs) if k.needs == "@" else text.rlike(k.needs)
        empty = F.array().cast("array<string>")
        found = found.withColumn(f"__m_{k.name}", F.when(has, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(empty))
    for k in KINDS:
        found = found.withColumn(f"__p_{k.name}", F.when(F.size(f"__m_{k.name}") > 0, F.split(text, k.pattern, -1)))
    found = found.withColumns({f"__b_{k.name}": _blocks(k) for k in KINDS})
    found = found.withColumn(out, F.concat(*[_spans(k, i) for i, k in enumerate(KINDS)]))
    return found.drop(*[f"__{c}_{k.name}" for k in KINDS for c in "mpb"])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every found span by its kind in brackets; overlapping spans become one, named after the first."""
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    found = find_pii(docs, text_col, "__pii").withColumn("__names", names)
    merged = """aggregate(array_sort(transform(__pii, x -> struct(x.start as start, x.end as end, x.kind as kind))),
      struct(0 as at, '' as out),
      (s, x) -> if(x.start >= s.at,
        struct(x.end as at, concat(s.out, substring({t}, s.at + 1, x.start - s.at), __names[x.kind]) as out),
        struct(greatest(s.at, x.end) as at, s.out as out)),
      s -> concat(s.out, substring({t}, s.at + 1)))""".replace("{t}", f"`{text_col}`")
    return found.withColumn(text_col, F.when(F.size("__pii") > 0, F.expr(merged)).otherwise(F.col(text_col))).drop("__pii", "__names")


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k.name}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')"


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    base = sum(k.base for k in KINDS)
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = {i})) as bigint)").alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(_joined(f"filter(pii, x -> x.kind < {base})")), 256).alias("base_sha256"),
        F.expr(_joined("pii")).alias("spans"),
    )


def _oracle() -> str:
    """The query in DuckDB's SQL: its patterns are linear, so they need no look-behind; neighbours are looked at in the pieces."""
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = f"""length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda j:
      CASE WHEN j % 2 = 1 THEN substr({digits}, length({digits}) - j + 1, 1)::INT
      ELSE (2 * substr({digits}, length({digits}) - j + 1, 1)::INT) // 10 + (2 * substr({digits}, length({digits}) - j + 1, 1)::INT) % 10 END)) % 10 = 0"""
    bare = "replace(x.m, ' ', '')"
    mod97 = f"""length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr({bare}, 5) || left({bare}, 4), ''),
      lambda c: CASE WHEN c >= '0' AND c <= '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda c: c::INT), lambda a, b: (a * 10 + b) % 97) = 1"""
    apart = lambda cls: f"NOT regexp_matches(right(x.c, 1), '{cls}') AND NOT regexp_matches(left(x.n, 1), '{cls}')"
    secret = r"regexp_matches(x.m, '[0-9]') AND regexp_matches(x.m, '[A-Za-z]') AND regexp_matches(right(x.c, 32), '(?i)(?:token|secret|password|passwd|api.?key)\W{0,6}$')"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0"),
        ("card", r"[0-9](?:[ -]?[0-9])+", luhn),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", f"{apart('[A-Za-z0-9]')} AND {mod97}"),
        ("secret", r"[A-Za-z0-9+/_-]{20,}", secret),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{apart('[0-9-]')} AND left(x.m, 3) NOT IN ('000', '666') AND regexp_matches(right(x.c, 32), '(?i)ssn|social.security')"),
    ]
    found = []
    for name, pattern, valid in kinds:
        found.append(f"""(SELECT list_transform(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i], 'c': p[i], 'n': coalesce(p[i + 1], ''),
          's': list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)}}), lambda x: {valid}),
          lambda x: '{name}:' || x.s::BIGINT || ':' || (x.s + length(x.m))::BIGINT)
          FROM (SELECT regexp_extract_all(t.text, '{pattern}') AS m, regexp_split_to_array(t.text, '{pattern}') AS p)) AS k_{name}""")
    base, added = ["email", "ip", "card", "phone"], ["iban", "secret", "ssn"]
    joined = lambda ks: " || ".join(f"k_{k}" for k in ks)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, {', '.join(found)} FROM t)
    SELECT doc_id, {', '.join(f'len(k_{k})::BIGINT AS n_{k}' for k in base)}, sha256(array_to_string({joined(base)}, ',')) AS base_sha256,
    array_to_string({joined(base + added)}, ',') AS spans FROM f"""


ORACLE_SQL = _oracle()
