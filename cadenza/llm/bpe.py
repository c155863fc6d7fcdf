"""Byte-level BPE as a monoid (operator 9).

A piece of bytes is encoded by halves: each half by itself, then the two
token lists are joined.  The join tests the pair of tokens at the seam; if
these two merge differently together, a window of k tokens on either side is
encoded again and k doubles until the window's outer tokens form valid pairs
with their neighbours outside.

Why that proves the result: a list of tokens is the encoding of its bytes if
and only if each two neighbours are the encoding of their joined bytes.
Merges inside disjoint stretches don't disturb each other's order, so the
first merge over a token boundary would also happen in that pair alone.  All
pairs inside the halves and inside the window are valid as parts of encodings;
the join checks the two that are left.

Texts are split into pieces by ``pretokens`` (whose long texts are a tree of
the same kind); decoding joins bytes up a tree.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import keep_caches, worker_cache
from .pretokens import split_many

#: Bytes of a leaf, of the longest stretch kept, entries a worker keeps, tokens
#: decoded at a leaf.
DIRECT = 8
KEPT = 16
CACHE_ENTRIES = 200_000
DECODE_LEAF = 4096
REPLACEMENT = "�".encode()


class Codec:
    """Encoder and decoder over merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merges(self, data: bytes) -> tuple[int, ...]:
        """Encoding by merging the pair of lowest rank, leftmost first."""
        if len(data) > 48:
            return self._merges_by_heap(data)
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        found = [ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = -1, -1
            for i, rank in enumerate(found):
                if rank >= 0 and (best < 0 or rank < best):
                    best, at = rank, i
            if at < 0:
                return tuple([ranks[p] for p in parts])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at < len(found):
                found[at] = ranks.get(parts[at] + parts[at + 1], -1)
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + parts[at], -1)

    def _merges_by_heap(self, data: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(data)
        size = [1] * n          # of the part that begins here; 0: none does
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if j >= n or ranks.get(data[i:j + size[j]]) != rank:
                continue
            size[i] += size[j]
            size[j], after[i] = 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (i, before[i]):
                if a >= 0 and after[a] < n:
                    b = after[a]
                    if (r := ranks.get(data[a:b + size[b]])) is not None:
                        heapq.heappush(heap, (r, a))
        return tuple([ranks[data[i:i + size[i]]] for i in range(n) if size[i]])

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their joined bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merges(self.tokens[a] + self.tokens[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the joined bytes from the encodings of two parts."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            lo, hi = max(0, len(left) - k), min(len(right), k)
            window = self.short(b"".join([self.tokens[t] for t in left[lo:] + right[:hi]]))
            if (lo == 0 or self.fits(left[lo - 1], window[0])) and \
                    (hi == len(right) or self.fits(window[-1], right[hi])):
                return left[:lo] + window + right[hi:]
            k *= 2

    def short(self, data: bytes) -> tuple[int, ...]:
        """``merges``, kept for short stretches of bytes."""
        if len(data) > KEPT:
            return self.merges(data)
        out = self.parts.get(data)
        if out is None:
            if len(self.parts) >= CACHE_ENTRIES:
                self.parts.clear()
            out = self.parts[data] = self.merges(data)
        return out

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Encoding of one piece by halves."""
        if len(data) <= DIRECT:
            return self.short(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece as packed 32-bit integers; a piece that is a
        token is that token."""
        data = piece.encode()
        rank = self.ranks.get(data)
        return array("i", (rank,) if rank is not None else self.tree(data)).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        pieces, out = self.pieces, []
        for split in split_many(texts):
            new = set(split).difference(pieces)
            if len(pieces) + len(new) > CACHE_ENTRIES:
                pieces.clear()
                new = set(split)
            for piece in new:
                pieces[piece] = self.encode_piece(piece)
            out.append(b"".join([pieces[p] for p in split]))
        return out

    def decode(self, ids) -> bytes:
        """Bytes of a list of ids, joined up a tree; an id that is not in the
        vocabulary gives U+FFFD."""
        if len(ids) > DECODE_LEAF:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        tokens, n = self.tokens, len(self.tokens)
        try:
            return b"".join([tokens[i] for i in ids])
        except IndexError:
            return b"".join([tokens[i] if 0 <= i < n and tokens[i] else REPLACEMENT for i in ids])


def load_codec(path: str) -> Codec:
    """The codec of a rank file, one for each worker."""
    keep_caches("codec", "classes")
    cache = worker_cache("codec")
    if path not in cache:
        with open(path, "rb") as f:
            cache[path] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    return cache[path]


def _default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def groups(texts: list, limit: int):
    """Slices of a list of texts with about ``limit`` characters each."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= limit:
            yield texts[first:i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def encode(text: F.Column, path: str | None = None) -> F.Column:
    """Column of token ids (array<int>) of a text column; a null text gives an
    empty list.  ``path``: a rank file (base64 token, rank) at that place on
    every executor."""
    path = path or _default_path()

    @arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        codec = load_codec(path)
        rows, values = [0], []
        for group in groups(texts.to_pylist(), 1 << 20):
            packed = codec.encode_many([t or "" for t in group])
            rows += [len(p) // 4 for p in packed]
            values.append(b"".join(packed))
        ids = np.frombuffer(b"".join(values), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(rows), pa.int32()), pa.array(ids, pa.int32()))
    return run(text)


def decode(ids: F.Column, path: str | None = None) -> F.Column:
    """Column of the bytes of a column of token ids; null ids give null."""
    path = path or _default_path()

    @arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        codec = load_codec(path)
        return pa.array([None if r is None or not r.is_valid else
                         codec.decode(r.values.to_numpy(zero_copy_only=False).tolist())
                         for r in rows], pa.binary())
    return run(ids)


def round_trip(text: F.Column, path: str | None = None) -> F.Column:
    """Struct of the ids of a text column and the bytes decoded from them, in one
    pass of Python over each text; a null text gives an empty list and no bytes."""
    path = path or _default_path()

    @arrow_udf("struct<ids: array<int>, decoded: binary>")
    def run(texts: pa.Array) -> pa.Array:
        codec = load_codec(path)
        sizes, packed, decoded = [0], [], []
        for first in range(0, len(texts), 64):
            for group in groups(texts[first:first + 64].to_pylist(), 1 << 20):
                coded = codec.encode_many([t or "" for t in group])
                sizes += [len(p) // 4 for p in coded]
                decoded += [codec.decode(np.frombuffer(p, np.int32).tolist()) for p in coded]
                packed.append(b"".join(coded))
        values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(packed))])
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values)
        return pa.StructArray.from_arrays([ids, pa.array(decoded, pa.binary())], ["ids", "decoded"])
    return run(text)


def encode_decode(docs: DataFrame, path: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) for each row.

    Null and empty texts have no ids and decode to no bytes.  Repeated rows and
    null ids come out as they come in; an empty table gives an empty result;
    other columns are not read.
    """
    coded = docs.select(F.col(id_col).alias("id"), round_trip(F.col(text_col), path).alias("both"))
    return coded.select("id", "both.ids", "both.decoded")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(F.col("id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
