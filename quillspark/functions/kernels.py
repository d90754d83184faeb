"""Text kernels that SQL has no function for, run as Arrow batches."""

from __future__ import annotations

import codecs
import contextlib
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("mode", T.StringType())])
#: Marks behind which a window may end, the strongest first.
_MARKS = ["\n\n", "\n", "</tr>", "</p>", ". ", "; ", " ", "><"]


@F.pandas_udf(T.StringType())
def norm_surface(texts: pd.Series) -> pd.Series:
    """STR-10: lower case, NFKC, white space, hyphens and underscores collapsed, blanks and marks at either end stripped."""

    def one(t: str | None) -> str:
        folded = unicodedata.normalize("NFKC", (t or "").lower())
        return re.sub(r"[\s\-_]+", " ", folded).strip(" .,;:()")

    return texts.map(one)


def surface_key(x: Column) -> Column:
    """STR-10 inside the JVM for plain ASCII; only other surfaces go through norm_surface."""
    other = x.rlike(r"[^\x00-\x7F]")
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\s_-]+", " "), r"^[ .,;:()]+|[ .,;:()]+$", "")
    return F.when(F.coalesce(other, F.lit(False)), norm_surface(F.when(other, x))).otherwise(plain)


@F.pandas_udf(T.StringType())
def norm_for_match(texts: pd.Series) -> pd.Series:
    """STR-11: NFKC, marks that take no space dropped, white space collapsed."""

    def one(t: str | None) -> str:
        apart = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t or ""))
        return " ".join("".join(c for c in apart if unicodedata.category(c) != "Mn").split())

    return texts.map(one)


@F.pandas_udf(_SPAN)
def quote_span(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """STR-08: where a quote of 20 to 220 characters stands in a text: exact, else with white space collapsed and case ignored."""

    def one(q: str | None, t: str | None) -> tuple[int, int, str]:
        q, t = (q or "").strip(), t or ""
        if not q or not t:
            return -1, -1, "none"
        if not 20 <= len(q) <= 220:
            return -1, -1, "invalid_len"
        at = t.find(q)
        if at >= 0:
            return at, at + len(q), "exact"
        pattern = r"\s+".join(re.escape(w) for w in q.split())
        found = re.search(pattern, t, re.IGNORECASE)
        return (found.start(), found.end(), "normalized") if found else (-1, -1, "none")

    return pd.DataFrame([one(q, t) for q, t in zip(quotes, texts, strict=True)], columns=["start", "end", "mode"])


#: Strings that UTF-8 Chinese shows where it was read as GBK.
MISREAD = ("寮曡█", "鎽樿", "鍙傝€冩枃鐚", "鍩", "銆", "锛", "锟", "鈥")


def _misread(texts: pd.Series) -> pd.Series:
    """How often the strings of MISREAD occur in each text."""
    return sum((texts.str.count(re.escape(m)) for m in MISREAD), pd.Series(0, texts.index))


def _read_again(text: str) -> str | None:
    """The text's bytes in GB18030 as UTF-8; None where they are none."""
    with contextlib.suppress(UnicodeError):
        return codecs.decode(codecs.encode(text, "gb18030"), "utf-8")
    return None


@F.pandas_udf(T.StringType())
def recover_mojibake(texts: pd.Series) -> pd.Series:
    """STR-09: texts with three or more signs of a wrong reading are read again, and stay so where fewer signs are left."""
    signs = _misread(texts)
    doubtful = texts[signs >= 3].map(_read_again).dropna()
    better = doubtful[_misread(doubtful) < signs[doubtful.index]] if len(doubtful) else doubtful
    out = texts.copy()
    out[better.index] = better
    return out


def segments(text: str, most: int, overlap: int) -> list[str]:
    """STR-14: windows of at most `most` characters that end at the strongest mark in their second half, white space at the ends stripped; none for a blank text."""
    text = text.strip()
    out, at = [], 0
    overlap = min(overlap, most // 2)
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            for m in _MARKS:
                cut = text.rfind(m, at + most // 2, end)
                if cut >= 0:
                    end = cut + len(m)
                    break
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def sentence_chunks(text: str, most: int = 6000) -> list[str]:
    """STR-15: pieces of about `most` characters, without overlap, that end behind the last full stop from their half up to twice that
    length, else the last question or exclamation mark, else 200 characters further on; a short text stays as it is."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            ends = (text.rfind(mark, at + most // 2, end + most) for mark in (". ", "? ", "! "))
            cut = next((e for e in ends if e > 0), None)
            end = cut + 1 if cut else min(end + 200, len(text))
        out.append(text[at:end])
        at = end
    return [p for p in out if p.strip()]


#: What str.strip takes for white space.
_BLANK = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once."""
    return F.transform(F.array(value), use)[0]


def _pieces(text: Column, step: int, size: Callable[[Column], Column], back: int, most: int) -> Column:
    """The pieces of a text from its start on, each of size(rest) characters, the next one `back` before its end; the last is a rest of at most `most`.

    step: the least that a piece advances. Texts never leave the JVM, so no batch of long ones is held in Python.
    """

    def cut(state: Column, _: Column) -> Column:
        rest = state["rest"]
        last = F.struct(F.lit("").alias("rest"), F.concat(state["out"], F.array(rest)).alias("out"))
        more = _bound(size(rest), lambda e: F.struct(F.substr(rest, F.greatest(F.lit(1), e - back) + 1).alias("rest"), F.concat(state["out"], F.array(F.substr(rest, F.lit(1), e))).alias("out")))
        return F.when(rest == "", state).when(F.length(rest) <= most, last).otherwise(more)

    begin = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.length(text) / step).cast("int")), begin, cut, lambda state: state["out"])


def _last_mark(window: Column, before: int, marks: Iterable[str], inside: Callable[[str], int], none: Column) -> Column:
    """The end behind the last occurrence of the first mark that a window has, which begins behind `before` characters; inside(mark): how many of the mark's characters are left out."""

    def of(w: Column) -> Column:
        ends = none
        for m in reversed(list(marks)):
            ends = F.when(F.contains(w, F.lit(m)), before + F.length(w) - F.length(F.substring_index(w, m, -1)) - inside(m)).otherwise(ends)
        return ends

    return _bound(window, of)


def segmented(rows: DataFrame, text: str = "text", most: int = 6000, overlap: int = 300) -> DataFrame:
    """STR-14: rows with long texts become several, as by segments, with segment index and count."""
    half, overlap = most // 2, min(overlap, most // 2)
    # short texts pass as they are, but for white space at their ends; blank ones have no segment
    full = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    size = lambda rest: _last_mark(F.substr(rest, F.lit(half + 1), F.lit(most - half)), half, _MARKS, lambda m: 0, F.lit(most))
    long = F.filter(F.transform(_pieces(_stripped(full), max(1, half + 1 - overlap), size, overlap, most), _stripped), lambda x: x != "")
    parts: Column = F.when(F.length(full) > most, long).otherwise(F.filter(F.array(full), lambda x: x != ""))
    with_parts = rows.withColumn("_parts", parts)
    return with_parts.select("*", F.size("_parts").alias("segment_count"), F.posexplode("_parts").alias("segment_index", "segment")).drop("_parts", text)


def sentence_chunked(rows: DataFrame, text: str = "text", most: int = 6000) -> DataFrame:
    """STR-15: rows with long texts become several, as by sentence_chunks. Columns chunk_index and chunk replace the text."""
    half = most // 2
    full = F.coalesce(text, F.lit(""))
    size = lambda rest: _last_mark(F.substr(rest, F.lit(half + 1), F.lit(2 * most - half)), half, (". ", "? ", "! "), lambda m: len(m) - 1, F.least(F.lit(most + 200), F.length(rest)))
    long = F.filter(_pieces(full, half + 1, size, 0, most), lambda x: _stripped(x) != "")
    parts = F.when(F.length(full) > most, long).otherwise(F.array(full))
    return rows.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("chunk_index", "chunk")).drop("_parts", text)
