"""HTML extraction by nearest-URL page differencing (operator 11).

A page becomes lines, one for each block of text.  Within a host the URL paths
are put in order, so that the neighbours of a path share the longest beginning
with it; each page is paired with the pages on both sides, the lines of the two
are aligned by a longest common subsequence, and shared lines are deleted: what
two near pages of a host have in common is the site's, not the article's.

Two things the difference alone can't tell, and markup can.  A page may mark
articles (``article``, ``main``): the difference says which of the marked elements
is the page's own, that with a line no neighbour has, and this one keeps the lines
that a neighbour has too: copies of an article, a licence or a quotation are text
of both.  A marked element of shared lines alone (a teaser, a notice) is the site's.
And what is left outside of it, or in elements that name themselves as menus,
headers, footers, sidebars, notices, adverts, forms or comments, goes in a check
of its own after the difference: a site's variants of a menu or an advert may
lie on pages far apart.

Paths are numbered within a host without bringing a host into one task; the
neighbours' lines travel as hashes.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadenza.operators.ordering import positions

from .common import others

# --- a page's lines -----------------------------------------------------------

#: Elements whose content is no text of the page at all.
_SKIPPED = "script style noscript template svg math iframe object canvas audio video head title textarea select".split()
#: Elements that are no article whatever they are called.
_CHROME = set("nav footer aside form menu dialog button datalist".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
              "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
              "option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Open elements of these names end where another of their group begins.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
_LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
          "th": ("tr", "table"), "option": ("select",)}
#: Words in class, id or role that name an element as no article.
_CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe sidebar widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer share sharing social related recommended "
    "login signin signup search skip complementary contentinfo dialog alert".split())
_COMMENT_WORDS = set("comment comments commentlist reply replies respond disqus".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<skip>" + "|".join(_SKIPPED) + r")\b(?P<void>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=skip)\s*>|(?=<body\b)|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

#: What a line is in: some element that is no article; a marked article, whose
#: number in the page is in the flags' bits from NUMBER on.
CHROME, ARTICLE, NUMBER = 1, 2, 2


def _kind(name: str, rest: str, inside: int) -> int:
    """Flags of an element within one of flags ``inside``."""
    if name in _CHROME or (name == "header" and not inside & ARTICLE):
        return inside | CHROME
    words = set()
    if rest and name not in ("html", "body"):
        for key, *values in _NAMES.findall(rest):
            found = _WORD.findall(html.unescape("".join(values)).lower())
            if key.lower() == "role" and "main" in found:
                inside |= ARTICLE
            words.update(found)
    if words & _COMMENT_WORDS:
        return inside | CHROME
    if name in ("article", "main"):
        return inside | ARTICLE
    if words & _CHROME_WORDS or ("banner" in words and not inside & ARTICLE):
        return inside | CHROME
    return inside


def page_lines(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each with its flags: character references
    decoded, white space as one space."""
    lines, parts = [], []
    stack, marks = [("", 0)], 0

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, stack[-1][1]))
            parts.clear()

    def close(names, until=()):
        """End the innermost open element of one of the names, and all in it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, rest = name.lower(), m["rest"]
        block = name in _BLOCKS
        if name == "br":
            parts.append(" ")
            continue
        if block:
            flush()
        if m["end"]:
            if len(stack) > 1:
                if not block and any(s[0] == name for s in stack[1:]) and stack[-1][0] == name:
                    changed = stack[-1][1] != stack[-2][1]
                    if changed:             # an inline advert in a line
                        flush()
                close((name,))
            continue
        if block:
            close(("p",), ("table", "button", "article", "section", "div", "li", "td", "blockquote"))
            if name in _SIBLINGS:
                close(_SIBLINGS[name], _LISTS[name])
        if name not in _VOID and not rest.rstrip().endswith("/"):
            kind = _kind(name, rest, stack[-1][1])
            if kind & ARTICLE and not kind & CHROME and (name in ("article", "main") or not stack[-1][1] & ARTICLE):
                marks += 1                  # the innermost marked element counts
                kind = kind & (CHROME | ARTICLE) | marks << NUMBER
            if not block and kind != stack[-1][1]:
                flush()
            stack.append((name, kind))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return lines


# --- the difference -------------------------------------------------------------

#: Bits of the rows of the common-subsequence table that are kept at a time.
KEPT_BITS = 1 << 28


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Rows of the bit-parallel table of longest common subsequences: in the last
    row's bits, a zero at i says that a[:i + 1] has one more than a[:i]."""
    places = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, out = full, [full]
    for y in b:
        m = places.get(y, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
        if keep:
            out.append(v)
    return out if keep else [v]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the common subsequences of each beginning of a with b."""
    v = _rows(a, b, False)[0]
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b: the one that
    keeps the latest positions of a that it can."""
    kept = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in kept]
    a, b = [a[i] for i in at], [x for x in b if x in kept]
    return [at[i] for i in _align(a, b)]


def _align(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > KEPT_BITS and len(b) > 1:
        half = len(b) // 2          # split where the halves' lengths add up to most
        head, tail = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])[::-1]
        cut = int((head + tail).argmax())
        return _align(a[:cut], b[:half]) + [cut + i for i in _align(a[cut:], b[half:])]
    rows, out, i = _rows(a, b, True), [], len(a) - 1
    for j in range(len(b), 0, -1):
        now, before = rows[j], rows[j - 1]
        # the last step up of this row; it is this line's, if the row before has none there
        while i >= 0 and now >> i & 1:
            i -= 1
        if i < 0:
            break
        if before >> i & 1:
            out.append(i)
            i -= 1
    return out[::-1]


def article(lines: list[tuple[str, int]], hashes: list[int], neighbours: list[list[int]]) -> str:
    """The text of a page's lines after the difference with its neighbours'
    hashes, and the check of what its markup says: of a page without marks what
    the difference left, else the marked elements that it left a line of, whole.
    If it left none of the marked lines, it does not tell the elements apart."""
    size = sum(len(t) for t, f in lines if not f & CHROME)
    gone = set()
    for other in neighbours:
        shared = common(hashes, other)
        # of a page that is mostly this page's text too, the difference says nothing
        if 2 * sum(len(lines[i][0]) for i in shared if not lines[i][1] & CHROME) <= size:
            gone.update(shared)
    left = [i for i, (_, f) in enumerate(lines) if i not in gone and not f & CHROME]
    inside = [i for i, (_, f) in enumerate(lines) if f & ARTICLE and not f & CHROME]
    if inside:
        own = {lines[i][1] for i in left if lines[i][1] & ARTICLE}
        left = [i for i in inside if not own or lines[i][1] in own]
    return "\n".join(lines[i][0] for i in left)


# --- on Spark ---------------------------------------------------------------------

def _line_hash(text: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _line_hashes(page: Column) -> Column:
    @arrow_udf("array<long>")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([[_line_hash(t) for t, _ in page_lines(p.as_py() or "")] for p in pages], pa.list_(pa.int64()))
    return run(page)


def _articles(page: Column, before: Column, after: Column) -> Column:
    @arrow_udf("string")
    def run(pages: pa.Array, befores: pa.Array, afters: pa.Array) -> pa.Array:
        out = []
        for page, *near in zip(pages, befores, afters):
            lines = page_lines(page.as_py() or "")
            near = [n.as_py() for n in near if n.is_valid]
            out.append(article(lines, [_line_hash(t) for t, _ in lines], near))
        return pa.array(out, pa.string())
    return run(page, before, after)


def url_host(url: Column) -> Column:
    """The host of a URL in lower case; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """The path of a URL, without query, fragment, last slash and .html."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r"(?i)(?:/index)?(?:\.html?|\.php)?/*$", "")


def neighbours(pages: DataFrame) -> DataFrame:
    """host, path, before, after: for each path of a host the line hashes of the
    page at the path before and after it in order (null at the ends), of pages
    (host, path, hashes).  Of pages that share a path one stands for them."""
    paths = pages.groupBy("host", "path").agg(F.min("hashes").alias("hashes"))
    placed = positions(paths, ["host"], [F.col("path")])

    def moved(by: int, name: str) -> DataFrame:
        return placed.select(F.col("host").alias("__host"), (F.col("position") + by).alias("__at"),
                             F.col("hashes").alias(name))
    out = placed.select("host", "path", "position")
    for by, name in ((1, "before"), (-1, "after")):
        out = out.join(moved(by, name), (F.col("host") == F.col("__host")) & (F.col("position") == F.col("__at")),
                       "left").drop("__host", "__at")
    return out.drop("position")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add ``text`` (the article, blocks joined by newlines) and ``n_chars``.

    A null or empty page has an empty text.  Pages whose URL is null or has no
    host have no neighbours, nor has the only path of a host: only the check of
    the markup cleans them.  Pages are read whole, however long.  Pages that
    repeat a path (copies, other queries of it) have the same neighbours and are
    not compared with each other; null and repeated ids come out as they come
    in.  Of several common subsequences as long the one with the last lines
    counts.  An empty table gives an empty result.  Columns named text and
    n_chars are replaced, all others stay (names that begin with ``__`` are used
    in between).
    """
    columns = others(pages, ["text", "n_chars"])
    host, path, source = url_host(F.col(url_col)), url_path(F.col(url_col)), F.col(html_col)
    near = neighbours(pages.filter(host != "").select(host.alias("host"), path.alias("path"),
                                                      _line_hashes(source).alias("hashes")))
    near = near.select(F.col("host").alias("__host"), F.col("path").alias("__path"),
                       F.col("before").alias("__before"), F.col("after").alias("__after"))
    paired = pages.withColumn("__h", host).withColumn("__p", path).join(
        near, (F.col("__h") == F.col("__host")) & (F.col("__p") == F.col("__path")), "left")
    text = _articles(source, F.col("__before"), F.col("__after"))
    return paired.withColumn("__text", text).select(
        *columns, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
