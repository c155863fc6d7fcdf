"""Language of a text by cross-parsing entropy (operator 6).

For each language a suffix automaton holds some labelled text.  A text is
parsed against it greedily: the longest match of what is left with a stretch of
the labelled text is a phrase, and the next phrase begins behind it.  Phrases
times the logarithm of the labelled text's length estimate the bits needed to
describe the text by that language; the language that needs fewest wins, and
the score is its share of the likelihood.

The parse is a walk through a table: a state and a character give the next
state, and a mark where a phrase ends.  numpy walks many blocks of texts at
once, each block from the root at first.  Then every block that began in another
state than the one before it ended in is walked again from there, until its
states are those of the walk before; this is repeated until nothing changes, so
that the phrases are those of the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bpe import groups
from .common import keep_caches, others, worker_cache
from .pretokens import _LETTER, _classes

UNKNOWN = "und"
#: Characters of labelled text per language, the documents they are from, and
#: the longest of these in bytes: the bounds of what is learned from.
LEARN_CHARS = 24_000
LEARN_DOCS = 64
LEARN_BYTES = 20_000
#: Characters of a block: a unit of the walk, not of the parse.
BLOCK = 512
#: Characters of a group of texts: what a walk keeps, in words of 64 bits.
KEPT = 1 << 21
#: Letters of a language up to which its table is an array over them.
WIDE = 256
#: Bits beyond the winner's that make a language e times less likely.
SOFTNESS = 8.0
PHRASE = 1 << 30
_BREAK, _OTHER = 0, 1


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return edges


def _letters(text: str) -> np.ndarray:
    """Code points in lower case with white space for all that is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(_classes()[code] == _LETTER, code, 32)


class Table:
    """The walk through one language's automaton.  Its alphabet is the letters of
    its text; any other letter is in no phrase but one of its own."""

    def __init__(self, code: np.ndarray, wide: int = WIDE):
        letters = np.unique(code[code != 32]).astype(np.int64)
        self.symbol = np.where(_classes() == _LETTER, _OTHER, _BREAK).astype(np.uint16)
        self.symbol[letters] = np.arange(2, len(letters) + 2)
        self.width = len(letters) + 2
        edges = _automaton(self.symbol[code].tolist())
        # a phrase ends where there is no way on: its successor begins here
        fresh = np.zeros(self.width, np.int64)
        for c, to in edges[0].items():
            fresh[c] = to * self.width
        self.fresh = fresh | PHRASE
        rows = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        keys = rows * self.width + np.array([c for e in edges for c in e], np.int64)
        to = np.array([t for e in edges for t in e.values()], np.int64) * self.width
        if self.width <= wide:
            self.table = np.tile(self.fresh, len(edges))
            self.table[keys] = to
            self.keys = None
        else:
            order = np.argsort(keys)
            self.keys, self.table = np.append(keys[order], np.iinfo(np.int64).max), to[order]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return self.table[state + symbol]
        key = state + symbol
        at = np.searchsorted(self.keys, key)
        known = self.keys[at] == key
        return np.where(known, self.table[np.where(known, at, 0)], self.fresh[symbol])

    def phrases(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each of the rows, of ``size`` characters, that code joins."""
        symbol = self.symbol[code]
        blocks = -(-size // BLOCK)
        of = np.repeat(np.arange(len(size)), blocks)
        step = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(size) - size)[of] + step * BLOCK
        length = np.minimum(size[of] - step * BLOCK, BLOCK)
        walked = np.empty(len(code), np.int64)
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(BLOCK), "left")       # blocks longer than t
        at, state = begin[order], np.zeros(len(order), np.int64)
        for t in range(BLOCK):
            k = live[t]
            if not k:
                break
            to = self.step(state[:k], symbol[at[:k] + t])
            walked[at[:k] + t] = to
            state[:k] = to & (PHRASE - 1)
        entry = np.zeros(len(of), np.int64)
        inner = np.flatnonzero(step)            # blocks with one before them
        while len(inner):
            ended = walked[begin[inner] - 1] & (PHRASE - 1)
            inner, ended = inner[(moved := ended != entry[inner])], ended[moved]
            if not len(inner):
                break
            entry[inner] = ended
            lanes, state = inner, ended
            for t in range(BLOCK):
                open_ = length[lanes] > t
                lanes, state = lanes[open_], state[open_]
                if not len(lanes):
                    break
                to = self.step(state, symbol[begin[lanes] + t])
                old = walked[begin[lanes] + t]
                walked[begin[lanes] + t] = to
                state = to & (PHRASE - 1)
                other = state != old & (PHRASE - 1)
                lanes, state = lanes[other], state[other]
            inner = np.flatnonzero(step)
        out = np.zeros(len(size), np.int64)
        some = np.flatnonzero(size)
        if len(some):
            out[some] = 1 + np.add.reduceat(walked >> 30, (np.cumsum(size) - size)[some])
        return out


class Parser:
    """Tables of all languages."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        codes = [joined(_letters(texts[lang])) for lang in self.langs]
        self.tables = [Table(code) for code in codes]
        self.bits = np.log2([max(2, len(code)) for code in codes])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        # letters a part of a text at a time; the parse takes the text whole
        rows = [joined(np.concatenate([_letters(text[at:at + (1 << 20)]) for at in range(0, len(text), 1 << 20)]))
                if text else np.zeros(0, np.uint32) for text in texts]
        lettered = np.flatnonzero([bool((row != 32).any()) for row in rows])
        if not self.langs or not len(lettered):
            return lang, score
        code = np.concatenate([rows[i] for i in lettered])
        size = np.array([len(rows[i]) for i in lettered], np.int64)
        bits = np.stack([t.phrases(code, size) for t in self.tables], 1) * self.bits
        bits -= bits.min(1, keepdims=True)
        best = bits.argmin(1)                       # ties: the first by name
        share = 1 / np.exp(-bits / SOFTNESS).sum(1)
        for i, b, s in zip(lettered.tolist(), best.tolist(), share.tolist()):
            lang[i], score[i] = self.langs[b], s
        return lang, score


def joined(code: np.ndarray) -> np.ndarray:
    """Code points with one white space for several in a row."""
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    return code[keep]


def learned_texts(docs: DataFrame) -> dict[str, str]:
    """Some labelled text per language, from whole documents, the first by a
    hash of doc_id; bounded by LEARN_DOCS documents a language.  Only documents
    that can be learned from count: with a letter and of LEARN_BYTES at most."""
    known = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang", "text") \
        .filter((F.octet_length("text") <= LEARN_BYTES) & F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64(F.col("doc_id"))
    counts = known.groupBy("lang").count()
    # about 4 * LEARN_DOCS of each language by the hash's size, then the first of them
    share = F.least(F.lit(1.0), F.lit(4.0 * LEARN_DOCS) / F.col("count"))
    few = (known.select("doc_id", "lang", h.alias("h")).join(F.broadcast(counts), "lang")
           .filter(F.abs(F.col("h") / F.lit(float(1 << 63))) <= share))
    first = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))) \
        .filter(F.col("n") <= LEARN_DOCS).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "n")
    rows = (known.join(F.broadcast(first), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")))
            .groupBy("of", "n").agg(F.min("text").alias("text")).collect())
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["of"], r["n"])):
        if len(out.get(r["of"], "")) < LEARN_CHARS:
            out[r["of"]] = out.get(r["of"], "") + r["text"] + "\n"
    return out


def language(text: Column, texts: dict[str, str]) -> Column:
    """Column of struct<lang_pred, score>."""
    @arrow_udf("struct<lang_pred: string, score: double>")
    def run(values: pa.Array) -> pa.Array:
        keep_caches("parser", "classes")
        cache = worker_cache("parser")
        key = tuple(sorted(texts.items()))
        if key not in cache:
            cache.clear()
            cache[key] = Parser(texts)
        langs, scores = [], []
        for group in groups(values.to_pylist(), KEPT):
            lang, score = cache[key].predict(group)
            langs += lang
            scores.append(score)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["lang_pred", "score"])
    return run(text)


def identify(docs: DataFrame, learn: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each row (columns of these names are
    replaced).

    ``learn`` (doc_id, text, lang) are the rows to learn from.  A text that is
    null or has no letter, and every text if nothing was learned, is ``und``
    with score 0.  Rows are judged one by one, so repeats and null ids come out
    as they come in; an empty table gives an empty result.  Texts are parsed
    whole, however long.  Names that begin with ``__`` are used in between.
    """
    texts = learned_texts(learn)
    return docs.withColumn("__lang", language(F.col(text_col), texts)).select(
        *others(docs, ["lang_pred", "score"]), F.col("__lang.lang_pred").alias("lang_pred"), F.col("__lang.score").alias("score"))
