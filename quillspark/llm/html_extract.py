"""Main text of web pages: nearest-URL page differencing, confirmed by what the markup says.

1. Only urls are read at first. Pages are sorted by host and path in ranges of about RANGE_PAGES rows; the first
   and the last key of each range are its ends. A hot host fills many ranges.
2. Each page is split once into lines, one for each block, with what the markup says of each: chrome
   (menus, footers, forms, comments and the like), main (inside an article or a main element), or nothing.
3. Pages go to their ranges with their lines' hashes and the texts that may stay; a page at an end of its
   range goes to the neighbouring one too, hashes alone, so that every page meets both its neighbours.
4. A page is paired with the neighbour on its host whose path has the longer common beginning. A longest
   common subsequence aligns the lines of the two, and the shared lines are deleted, unless the markup puts
   them inside the main text: pages of one host may quote each other or hold copies of an article.
   Lines that are not shared go where the markup calls them chrome or, on pages with a marked main text,
   where they stand outside of it.

The markup is asked because differencing alone errs in both ways: it takes a copied or repeated line of an
article for boilerplate, and cannot see a notice or an advert that only one page shows.

Defined results: a null html or one without main text gives an empty text; a null url, or one without "://", has
an empty host and path; repeated rows are extracted each on its own; equal pages say nothing of each other; urls
that agree in the first KEY_CHARACTERS characters of host and path are sorted by a hash; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.url_filter import url_parts

RANGE_PAGES = 2_000
#: Ends of ranges go to every task, 2 keys of about 100 bytes each; beyond so many ranges it is the ranges that grow, whose rows are only streamed.
MOST_RANGES = 20_000
KEY_CHARACTERS = 256
CHROME, UNSAID, MAIN = 0, 1, 2

#: Bits of the table of a longest common subsequence that are held at once (16 MB).
TABLE_BITS = 1 << 27

# Fixed values of HTML: what holds no text, what is void, what begins a block.
_SKIPPED = {"script", "style", "template", "noscript", "textarea", "svg", "iframe", "object", "canvas", "audio", "video", "head", "select", "math"}
_RAW = {"script", "style", "textarea", "iframe", "noscript", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table caption tbody tfoot thead tr ul".split()
)
_SPACED = {"br", "td", "th", "img"}
# Elements, roles and words in class or id that name what surrounds a main text, or the main text.
_CHROME_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "search"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended comment comments commentlist reply replies disqus respond pagination pager widget skip hidden copyright legal disclaimer imprint".split()
)
_MAIN_WORDS = {"article", "content", "post", "entry", "story", "main"}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:=\s*+\"[^\"]*+\"?|=\s*+'[^']*+'?|[^>])*+)>?", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?""")


def _words(value: str) -> list[str]:
    """The words of a class or id: camel case, hyphens and underscores separate them."""
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)]


def _named(value: str) -> list[str]:
    """The words of one class or id, but for those that say something is or is not beside it, as in has-sidebar."""
    words = _words(value)
    return [] if words and words[0] in ("has", "with", "no", "without", "show", "hide") else words


def _said(tag: str, rest: str, inside_main: bool) -> int:
    """What an element says of the text inside it."""
    known = {}
    if rest and not rest.isspace():
        known = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
    role = known.get("role", "").lower()
    names = [w for x in f"{known.get('class', '')} {known.get('id', '')}".split() for w in _named(x)]
    if tag in _CHROME_TAGS or role in _CHROME_ROLES or "hidden" in known or known.get("aria-hidden", "").lower() == "true" or (tag == "header" and not inside_main):
        return CHROME
    head = "header" in names and not inside_main and not any(n in _MAIN_WORDS for n in names)
    if tag not in ("html", "body", "article", "main") and (head or any(n in _CHROME_WORDS for n in names)):
        return CHROME
    if tag in ("article", "main") and any(n in ("comment", "comments", "reply") for n in names):
        return CHROME
    if tag in ("article", "main") or role in ("main", "article") or known.get("itemprop", "").lower() == "articlebody":
        return MAIN
    return UNSAID


def _hinted(tag: str, rest: str) -> bool:
    """A class or id that names the main text, for pages without an element of that name."""
    return tag in ("div", "section", "td") and any(w in _MAIN_WORDS for k, v in _ATTRIBUTE.findall(rest) if k.lower() in ("class", "id") for w in _words(v))


@dataclass
class Page:
    lines: list[str] = field(default_factory=list)
    said: list[int] = field(default_factory=list)


def split_lines(source: str) -> Page:
    """The blocks of a page in order, white space collapsed and references decoded, with what the markup says of each."""
    # open elements: (tag, what holds inside, whether a hint holds inside)
    stack: list[tuple[str, int, bool]] = [("", UNSAID, False)]
    opened: Counter[str] = Counter()
    lines, said, hinted = [], [], []
    pieces: list[tuple[str, int, bool]] = []
    aside: list[tuple[str, int, bool]] = []
    skipped = 0

    def add(text: str) -> None:
        _, kind, hint = stack[-1]
        (aside if kind == CHROME else pieces).append((text, kind, hint))

    def flush() -> None:
        # chrome inside a block, such as a marked span, is a line of its own
        for held in (aside, pieces):
            text = " ".join("".join(x for x, _, _ in held).split())
            if text:
                first = next(x for x in held if not x[0].isspace())
                lines.append(text)
                said.append(first[1])
                hinted.append(first[2])
            held.clear()

    def pop_to(tag: str) -> None:
        nonlocal skipped
        while True:
            name = stack.pop()[0]
            opened[name] -= 1
            skipped -= name in _SKIPPED
            if name == tag:
                return

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text and not skipped:
            add(html.unescape(text))
        if not m:
            break
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag in _BLOCKS:
                flush()
            if opened[tag] > 0:
                pop_to(tag)
            continue
        if tag in _RAW:  # everything up to the end tag is no markup
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(source, at)
            at = close.end() if close else len(source)
            continue
        if tag == "body" and skipped:  # a head that was not closed
            while opened["head"] > 0:
                pop_to("head")
        if tag in _BLOCKS:
            flush()
            if opened["p"] > 0:
                pop_to("p")
        elif tag in _SPACED and not skipped:
            add(" ")
        if tag in _VOID:
            continue
        _, kind, hint = stack[-1]
        own = _said(tag, m["rest"], kind == MAIN)
        if kind != CHROME and own != UNSAID:
            kind = own
        stack.append((tag, kind, hint or _hinted(tag, m["rest"])))
        opened[tag] += 1
        skipped += tag in _SKIPPED
    flush()
    if MAIN not in said:
        said = [MAIN if h and s == UNSAID else s for s, h in zip(said, hinted, strict=True)]
    return Page(lines, said)


def _row_ends(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of a with every beginning of b, by one bit a place."""
    full = (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | (1 << j)
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b."""
    found: list[int] = []
    todo = [(list(enumerate(a)), list(b))]
    while todo:
        x, y = todo.pop()
        while x and y and x[0][1] == y[0]:
            found.append(x[0][0])
            skip = 1
            while skip < min(len(x), len(y)) and x[skip][1] == y[skip]:
                found.append(x[skip][0])
                skip += 1
            x, y = x[skip:], y[skip:]
        while x and y and x[-1][1] == y[-1]:
            found.append(x.pop()[0])
            y.pop()
        here, there = {h for _, h in x}, set(y)
        x, y = [e for e in x if e[1] in there], [h for h in y if h in here]
        if not x or not y:
            continue
        if len(x) == 1:
            found.append(x[0][0])
            continue
        if len(x) * len(y) > TABLE_BITS:  # halves meet where their lengths add up to the most
            mid = len(x) // 2
            keys = [h for _, h in x]
            lengths = _row_ends(keys[:mid], y) + _row_ends(keys[mid:][::-1], y[::-1])[::-1]
            cut = int(np.argmax(lengths))
            todo += [(x[:mid], y[:cut]), (x[mid:], y[cut:])]
            continue
        full = (1 << len(y)) - 1
        where: dict[int, int] = {}
        for j, h in enumerate(y):
            where[h] = where.get(h, 0) | (1 << j)
        rows = [full]
        for _, h in x:
            v = rows[-1]
            u = v & where.get(h, 0)
            rows.append(((v + u) | (v - u)) & full)
        # a zero bit of row i at j is a step up there; walk back from the end
        i, j = len(x), len(y)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                found.append(x[i - 1][0])
                i, j = i - 1, j - 1
    return sorted(found)


def _shared_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def nearest(own: tuple, before: tuple | None, after: tuple | None) -> tuple | None:
    """Of the neighbours (host, path, lines, ...) on the same host the one with the longer common path, the first if equal; an equal page says nothing."""
    near = [p for p in (before, after) if p is not None and p[0] == own[0] and p[2] != own[2]]
    return max(near, key=lambda p: _shared_path(own[1], p[1]), default=None)


def main_text(lines: list[str], said: list[int], shared: set[int]) -> str:
    marked = MAIN in said
    kept = [x for i, (x, s) in enumerate(zip(lines, said, strict=True)) if s == MAIN or (s == UNSAID and not marked and i not in shared)]
    return "\n\n".join(kept)


def _keyed(pages: DataFrame) -> DataFrame:
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", *[c for c in ("html",) if c in pages.columns])
    key = [F.left(host, F.lit(KEY_CHARACTERS)), F.left(path, F.lit(KEY_CHARACTERS)), F.hex(F.xxhash64(host, path, F.col("url"), F.col("page_id")))]
    return rows.withColumns({"host": host, "path": path, "key": F.concat_ws("\x01", *key)})


def range_ends(pages: DataFrame, range_pages: int = RANGE_PAGES) -> tuple[list[str], list[str]]:
    """(first keys, last keys) of the ranges, in order: two keys of bounded length for each of at most MOST_RANGES ranges."""
    keys = _keyed(pages.select("page_id", "url")).select("key")
    ranges = min(MOST_RANGES, max(pages.sparkSession.sparkContext.defaultParallelism * 2, -(-keys.count() // range_pages)))
    ends = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"), F.max("key").alias("last"))
    found = sorted((r.first, r.last) for r in ends.select("first", "last").collect())
    return [f for f, _ in found], [x for _, x in found]


def extract_text(pages: DataFrame, range_pages: int = RANGE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared, nearest_id) of every row of pages (page_id long, url, html).

    n_lines counts the page's lines, n_shared those it shares with the page nearest_id.
    """
    firsts, lasts = range_ends(pages, range_pages)
    sent = pages.sparkSession.sparkContext.broadcast((firsts, lasts))
    columns = "part int, ghost boolean, page_id long, url string, host string, path string, key string, hashes binary, said binary, texts array<string>"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, lasts = sent.value
        for b in batches:
            rows = []
            for page_id, url, source, host, path, key in zip(b["page_id"].astype("Int64"), b["url"], b["html"], b["host"], b["path"], b["key"], strict=True):
                page = split_lines(source or "")
                hashes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in page.lines], np.uint64).tobytes()
                part = max(0, bisect_right(firsts, key) - 1)
                marked = MAIN in page.said
                texts = [x if s == MAIN or (s == UNSAID and not marked) else None for x, s in zip(page.lines, page.said, strict=True)]
                own = (page_id, url, host, path, key, hashes, bytes(page.said))
                rows.append((part, False, *own, texts))
                if key == firsts[part] and part > 0:
                    rows.append((part - 1, True, *own, None))
                if key == lasts[part] and part + 1 < len(firsts):
                    rows.append((part + 1, True, *own, None))
            yield pd.DataFrame(rows, columns=["part", "ghost", "page_id", "url", "host", "path", "key", "hashes", "said", "texts"]).astype({"page_id": "Int64"})

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted; each is decided when the next one is known."""
        before = own = None

        def decided(after: tuple | None) -> list[tuple]:
            if own is None or own[3]["ghost"]:
                return []
            # rows of another range may stand beside it in the same task
            sides = [p if p is not None and p[3]["part"] == own[3]["part"] else None for p in (before, after)]
            partner = nearest(own, *sides)
            row, shared = own[3], set()
            if partner is not None:
                shared = set(common_lines(np.frombuffer(own[2], np.uint64).tolist(), np.frombuffer(partner[2], np.uint64).tolist()))
            text = main_text(list(row["texts"]), list(row["said"]), shared)
            return [(row["page_id"], row["url"], text, len(text), len(row["said"]), len(shared), None if partner is None else partner[3]["page_id"])]

        for b in batches:
            rows = []
            for row in b.astype({"page_id": "Int64"}).to_dict("records"):
                after = (row["host"], row["path"], row["hashes"], row)
                rows += decided(after)
                before, own = own, after
            if rows:
                yield _output(rows)
        if rows := decided(None):
            yield _output(rows)

    dealt = _keyed(pages).mapInPandas(split, columns).repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "key", F.xxhash64("hashes"))
    return dealt.mapInPandas(differ, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, nearest_id long")


def _output(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "nearest_id"]).astype({"page_id": "Int64", "nearest_id": "Int64"})


def op13_html(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
