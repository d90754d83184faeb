"""Text functions on columns: normalisers, tokenisers, similarities and scores, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval tokenisers drop.
STOP_WORDS = ["the", "and", "of", "to", "in", "a", "an"]
CJK = r"一-鿿"


def compact_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def norm_text(x: Column) -> Column:
    """White space collapsed, closing full stops and semicolons stripped."""
    return F.regexp_replace(compact_whitespace(x), r"[.;。；\s]+$", "")


def tokens(x: Column) -> Column:
    """Letters, digits or CJK runs in order; CJK runs over two characters fall apart; stop words go."""
    # at the beginning of a CJK run one or two characters up to its end, elsewhere in it one
    parts = F.regexp_extract_all(F.lower(x), F.lit(rf"[a-z]+|[0-9]+|(?<![{CJK}])[{CJK}]{{1,2}}(?![{CJK}])|[{CJK}]"), F.lit(0))
    return F.filter(parts, lambda t: ~t.isin(STOP_WORDS))


def token_set(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(rf"[a-z0-9{CJK}]+"), F.lit(0)))


def structured_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(rf"[a-z0-9_:+./-]+|[{CJK}]+"), F.lit(0))


def latex_tokens(x: Column) -> Column:
    """Commands dropped, punctuation as space, tokens of one character dropped except i."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), r"\\[a-z]+", " "), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(plain), " +"), lambda t: (F.length(t) > 1) | (t == "i"))


def occurrences(x: Column, token: str) -> Column:
    """Non-overlapping occurrences of a token in lower-cased text."""
    low = F.lower(x)
    return ((F.length(low) - F.length(F.replace(low, F.lit(token), F.lit("")))) / len(token)).cast("int")


def lexical_score(x: Column, query_tokens: list[str]) -> Column:
    """Sum over the query's tokens (repeated ones count again) of 1 + 0.3 min(5, occurrences), where there are any."""

    def one(t: str) -> Column:
        n = occurrences(x, t)
        return F.when(n > 0, 1 + 0.3 * F.least(F.lit(5), n)).otherwise(0.0)

    return reduce(lambda a, b: a + b, [one(t) for t in query_tokens], F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def coverage(query_tokens: Column, text_tokens: Column) -> Column:
    """Matched query tokens, repeated ones again, over distinct query tokens; so it can exceed 1."""
    hit = F.size(F.filter(query_tokens, lambda t: F.array_contains(text_tokens, t)))
    n = F.size(F.array_distinct(query_tokens))
    return F.when(n > 0, hit / n).otherwise(0.0)


def looks_like_reference(line: Column) -> Column:
    """At least 12 characters and a year, with a DOI, a comma and a full stop, two commas or two full stops."""
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    year = line.rlike(r"(19|20)[0-9]{2}")
    doi = F.lower(line).contains("doi") | line.rlike(r"10\.[0-9]{4,9}/")
    return (F.length(line) >= 12) & year & (doi | ((count(",") >= 1) & (count(".") >= 1)) | (count(",") >= 2) | (count(".") >= 2))


def expand_citation_body(body: Column) -> Column:
    """'13-15, 19' -> [13, 14, 15, 19]; numbers from 1 to 999, first occurrence kept."""
    part = F.split(F.regexp_replace(body, r"\s+", ""), "[,;]")
    ends = F.transform(part, lambda p: F.array(F.try_to_number(F.split_part(p, F.lit("-"), F.lit(1)), F.lit("999")), F.try_to_number(F.element_at(F.split(p, "[-–]"), -1), F.lit("999"))))
    full = F.transform(ends, lambda e: F.when(e[0].isNotNull() & e[1].isNotNull() & (e[0] <= e[1]), F.sequence(e[0].cast("int"), e[1].cast("int"))).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.filter(F.flatten(full), lambda n: (n >= 1) & (n <= 999)))


def doi_of(x: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(x, r"(10\.[0-9]{4,9}/[^\s\"<>]+[^\s\"<>.,;)])", 1)), F.lit(""))


def year_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


#: Marks that end a sentence, in the order in which a cut looks for them.
TERMINATORS = [".", "!", "?", "。", "！", "？", ";", "；"]


def truncate_to_sentence(x: Column, most: int) -> Column:
    """STR-12: white space collapsed; a longer text ends at the last full stop in its second half, else at the last of the next mark, else cut hard with an ellipsis."""
    compact = compact_whitespace(F.coalesce(x, F.lit("")))
    window = F.substring(compact, 1, most)
    out = F.when(F.length(compact) <= most, compact)
    for mark in TERMINATORS:
        upto = F.regexp_extract(window, rf"(?s)^(.*\Q{mark}\E)", 1)
        out = out.when(F.length(upto) > most // 2, F.trim(upto))
    return out.otherwise(F.concat(F.regexp_replace(window, r"[ ,;:]+$", ""), F.lit("...")))


def overlap_tokens(x: Column) -> Column:
    """The CJK characters of a text that has any, else its words and numbers, lower-cased; each once."""
    one = F.array_distinct(F.regexp_extract_all(x, F.lit(rf"[{CJK}]"), F.lit(0)))
    words = F.regexp_extract_all(x, F.lit(r"[A-Za-z][A-Za-z0-9_:+./-]*|[0-9][0-9_./-]*"), F.lit(0))
    return F.when(F.size(one) > 0, one).otherwise(F.array_distinct(F.transform(words, lambda w: F.lower(w))))


def best_sentence(x: Column, anchor: Column, most: int = 220) -> Column:
    """STR-13: of the sentences of a text the one that shares most tokens with the anchor, then the shorter, then the earlier, cut to a length.

    Where one of the two has no tokens, a sentence counts the anchor's characters if it holds the anchor as it stands.
    """
    sentences = F.filter(F.split(compact_whitespace(F.coalesce(x, F.lit(""))), r"(?<=[.!?。！？;；])\s+"), lambda s: F.trim(s) != "")
    wanted = compact_whitespace(F.coalesce(anchor, F.lit("")))

    def score(s: Column) -> Column:
        own, asked = overlap_tokens(s), overlap_tokens(wanted)
        holds = (wanted != "") & F.contains(F.lower(s), F.lower(wanted))
        return F.when((F.size(own) > 0) & (F.size(asked) > 0), F.size(F.array_intersect(own, asked))).when(holds, F.length(wanted)).otherwise(0)

    ranked = F.transform(sentences, lambda s, i: F.struct(score(s).alias("n"), (-F.length(s)).alias("l"), (-i).alias("p"), s.alias("s")))
    return F.coalesce(truncate_to_sentence(F.array_max(ranked).getField("s"), most), F.lit(""))


def title_fingerprint(x: Column) -> Column:
    """Hash of the title with case, punctuation and white space taken out."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")), 256), 1, 24)


#: Verbs that lead a summary, and words before which its operation ends.
LEADING_VERBS = "uses?|used|using|proposes?|proposed|presents?|presented|introduces?|introduced|applies?|applied|employs?|employed|leverages?|leveraged"
ENDING_WORDS = "for|to|via|through|with|by"


def operation_phrase(x: Column) -> Column:
    """STR-20: lower case, without a leading verb, up to the first ending word, marks as blanks, blanks and hyphens stripped at the ends."""
    bare = F.regexp_replace(F.lower(compact_whitespace(F.coalesce(x, F.lit("")))), rf"^(?:{LEADING_VERBS})\s+", "")
    first = F.element_at(F.split(bare, rf"\b(?:{ENDING_WORDS})\b", 2), 1)
    return F.regexp_replace(compact_whitespace(F.regexp_replace(first, r"[^a-z0-9\s-]+", " ")), r"^[- ]+|[- ]+$", "")


def supports(values: Column, span: Column) -> Column:
    """Every value has at least half of its tokens in the span."""
    have = token_set(span)
    return F.forall(values, lambda v: (F.size(token_set(v)) > 0) & (F.size(F.array_intersect(token_set(v), have)) >= 0.5 * F.size(token_set(v))))


def document_type(title: Column, abstract: Column) -> Column:
    """The first of the ordered keyword rules that fits; software by the title alone."""
    both = F.lower(F.concat_ws(" ", title, abstract))
    return (
        F.when(F.lower(title).rlike(r"\b(software|toolkit|library|package)\b"), "software")
        .when(both.rlike(r"\b(review|survey|overview)\b"), "review")
        .when(both.rlike(r"\b(theorem|proof|theory)\b"), "theoretical")
        .otherwise("research")
    )


def or_default(x: Column, default) -> Column:
    """Falsy values (null, blank, zero) give way to the default."""
    return F.when(x.isNull() | (x.cast("string").isin("", "0", "0.0", "false")), F.lit(default)).otherwise(x)


def render_template(template: str, values: dict[str, Column]) -> Column:
    """{{name}} replaced by the value's text; unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
