"""Helpers shared by the operators: written intermediates, worker caches,
and splitting of batches of texts into runs of bytes with numpy."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cadenza.session import checkpoint_dir

#: Bytes of one piece of a text, and of one pack of pieces, that the numpy code
#: works on at a time; longer texts are cut into pieces at white space.
PIECE_BYTES = 1 << 20
PACK_BYTES = 2 << 20

#: ASCII white space (\x20 \x09-\x0D).
SPACE = b" \t\n\r\x0b\x0c"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/cadenza-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs start
    from the files, so a lost executor costs only the tasks it ran."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def others(df: DataFrame, added: list[str]) -> list[str]:
    """Columns of a table but those that an operator adds: these it replaces."""
    return [c for c in df.columns if c not in added]


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    store = sys.modules.setdefault("_cadenza_worker", types.ModuleType("_cadenza_worker"))
    return store.__dict__.setdefault(name, {})


def keep_caches(*names: str) -> None:
    """Empty the worker's caches but those named: what an earlier operator's
    tasks left in a worker that is used again.  The memory goes back to the system."""
    worker_cache("powers")
    store = sys.modules["_cadenza_worker"].__dict__
    stale = [n for n, v in store.items() if isinstance(v, dict) and v and n not in names and not n.startswith("__")]
    for name in stale:
        store[name].clear()
    if stale:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):       # no such call in this C library
            pass


def packs(texts: list[bytes], overlap: int = 0):
    """Yield (buffer, starts, owners): pieces of texts joined with newlines,
    about PACK_BYTES at a time.  starts[i] is where piece i begins and owners[i]
    the text it is from.  A text over PIECE_BYTES is cut at white space
    (anywhere, if it has none there); each next piece begins ``overlap`` bytes
    earlier, at white space."""
    parts, starts, owners, size = [], [], [], 0
    for owner, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE_BYTES)
            if end < len(text):
                cut = max(text.rfind(c, at + PIECE_BYTES // 2, end) for c in (b" ", b"\n"))
                end = cut if cut > 0 else end
            parts.append(text[at:end])
            starts.append(size)
            owners.append(owner)
            size += end - at + 1
            if size >= PACK_BYTES:
                yield b"\n".join(parts) + b"\n", np.array(starts), np.array(owners)
                parts, starts, owners, size = [], [], [], 0
            if end < len(text) and overlap:
                back = text.find(b" ", end - overlap, end)
                end = back if back > at else end
            at = end
    if parts:
        yield b"\n".join(parts) + b"\n", np.array(starts), np.array(owners)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache("powers")
    if "p" not in cache or len(cache["p"][0]) < n:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        cache["p"] = tuple(out)
    return cache["p"]


def runs(buf: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of one class; class 0 is left out."""
    kind = classes[buf]
    cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(buf)]])
    keep = kind[starts] > 0
    return starts[keep], ends[keep]


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run's bytes (a polynomial, then mixed)."""
    forward, back = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * forward[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * back[starts]
    return mix(h ^ np.uint64(seed * 0x9E3779B9))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t.encode() if t is not None else b"" for t in texts]
