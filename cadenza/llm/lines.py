"""Line-first cleaning with DataFrame functions only (operator 5).

Rules judge each line that has a word; failing lines go, and a document goes
if it loses too much text.  A line fails if it

- does not end in terminal punctuation, or is dense in symbols or exclamation
  marks (punctuation);
- is cut into columns, or is a short line of a menu (navigation);
- has a phrase of a notice, or equals an earlier line of its text (boilerplate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others

WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[ \t-\r]+"
WINDOW = 5

# Fixed values of the rules, stated as they are used.
SYMBOLS = "[#*$%&|<>]"
TERMINAL = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "。", "！", "？")
MENU = (r"(?i)^\W*(home|menu|login|log in|sign in|sign up|register|search|contact( us)?|about( us)?|sitemap|next|"
        r"previous|back|top|more|read more|share|print|help|faq|accueil|connexion|startseite|anmelden|inicio|"
        r"buscar)\W*$")
NOTICE = (r"(?i)(licensed under|all rights reserved|copyright|terms of (use|service)|privacy policy|cookies? policy|"
          r"uses? cookies|creative commons|general public license|subscribe to our|powered by|"
          r"tous droits réservés|alle rechte vorbehalten|todos los derechos)")
#: Marks or column bars beyond one in so many characters make a line fail.
DENSITY = 20
#: Share of a text's words (in percent) and count of words that must stay.
KEEP_PERCENT = 50
MIN_WORDS = 10
REPEAT_PERCENT = 20


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """Whether the punctuation, navigation or boilerplate rules fail a line
    (its being a repeat is judged for the whole text)."""
    bare = F.btrim(line, F.lit(WHITE))
    size = F.length(bare)
    exclaims = size - F.length(F.replace(bare, F.lit("!")))
    return (~F.right(bare, F.lit(1)).isin(*TERMINAL)
            | (_count(bare, SYMBOLS) * DENSITY > size)
            | ((exclaims >= 3) & (exclaims * DENSITY > size))
            | (_count(bare, r"[|»›•]") >= 2)
            | ((size <= 24) & bare.rlike(MENU))
            | bare.rlike(NOTICE))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))


def _covered(starts: Column) -> Column:
    """Words in the windows that begin at these sorted places."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).alias("n"),
                                (s + WINDOW).alias("end")),
        lambda acc: acc["n"])


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add clean_text, base counts and verdicts to each row.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words
    (long); base_failed, kept (boolean).  A null text counts as empty: no
    words, base_failed, clean_text ''.  Each row is judged alone, so repeated
    rows and an empty table need no care.  Columns of the names added are
    replaced, all others stay (names that begin with ``__`` are used in between).
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words"]
    columns = others(docs, ["clean_text", *added, "base_failed", "kept"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumns({
        "__words": _words(text),
        "__lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""),
    }).withColumns({
        "__once": F.array_distinct("__lines"),
        "__n": F.size("__words"),
        "__windows": F.when(F.size("__words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("__words") - WINDOW),
            lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")),
    })
    # only a text with a repeated window sorts its windows
    repeated = F.size("__windows") > F.size(F.array_distinct("__windows"))
    ordered = split.withColumns({
        "__sorted": F.when(repeated, F.sort_array(F.transform(
            "__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "__good": F.filter("__once", lambda x: ~line_fails(x)),
    })

    def same(i, j):
        return F.get("__sorted", i)["h"] == F.get("__sorted", j)["h"]
    marked = ordered.withColumns({
        "__starts": F.when(F.col("__sorted").isNotNull(), F.sort_array(F.transform(F.filter(
            F.transform("__sorted", lambda s, k: F.struct(s["i"].alias("i"), (
                F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))).alias("twice"))),
            lambda s: s["twice"]), lambda s: s["i"]))),
        "clean_text": F.array_join("__good", "\n"),
    })
    counted = marked.withColumns({
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size("__once")).cast("long"),
        "n_repeat_words": F.when(F.col("__starts").isNotNull(), _covered(F.col("__starts")))
        .otherwise(F.lit(0)).cast("long"),
        "n_kept_words": F.size(_words(F.col("clean_text"))).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_kept_words") >= MIN_WORDS)
        & (100 * F.col("n_kept_words") >= KEEP_PERCENT * F.col("n_words"))).select(
        *columns, "clean_text", *added, "base_failed", "kept")
