"""SimHash near-duplicates by multi-index hashing (operator 10).

A fingerprint has 64 bits in SEGMENTS segments.  If two differ in at most k bits,
one of their segments differs in at most k // SEGMENTS: so every segment has a
table of the fingerprints by its value, a fingerprint looks up all values in the
small Hamming ball around its own in each table, and what it fetches is verified
by the whole distance.

Near copies of one text share a segment's value, and a value that many
fingerprints share would be fetched by each of them.  A bucket of more than HOT
fingerprints is not fetched: those that look it up, its own members among them,
are linked by another rule that is linear in them (``dense_links``): each enters
a table under all its values with at most ceil(k / 2) bits flipped, and under
each value is linked to the smallest one there.  No link is lost: two
fingerprints that only a hot bucket brings together both look it up.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import keep_caches, materialize
from .components import components

BITS = 64
SEGMENTS = 2
SEGMENT = BITS // SEGMENTS
#: Fingerprints of a segment's value that are fetched one by one.
HOT = 32
HASH_SEED = 42
#: Shingles hashed before their bits are counted.
SLAB = 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: str | None, shingle: int) -> int:
    """Fingerprint of one text as a signed 64-bit integer; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    lo, hi = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, SLAB):
        h = np.array([digest(line[s:e], HASH_SEED) for s, e in zip(lo[at:at + SLAB], hi[at:at + SLAB])],
                     np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: F.Column, shingle: int = 3) -> F.Column:
    """Column of fingerprints (long; null text: 0)."""
    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        keep_caches()
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")
    return run(text)


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits, fewest first."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _segments(fp: F.Column) -> F.Column:
    """(segment, value) of each segment of a fingerprint."""
    low = F.lit((1 << SEGMENT) - 1).cast("long")
    return F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftright(fp, i * SEGMENT).bitwiseAND(low).alias("value"))
                     for i in range(SEGMENTS)])


def links(prints: DataFrame, max_bits: int, hot: int = HOT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that keep every
    chain of links of at most ``max_bits`` bits."""
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = materialize(prints.repartition(spread, "fp").select("fp", F.inline(_segments(F.col("fp")))), "segments")
    counts = table.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
    crowded = materialize(counts.filter(F.col("n") > hot).select("seg", "value"), "crowded")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(SEGMENT, max_bits // SEGMENTS)])
    probes = table.select("fp", "seg", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    small = table.join(crowded, ["seg", "value"], "left_anti").withColumnRenamed("fp", "other")
    fetched = probes.join(small, ["seg", "value"]).filter(
        (F.col("other") < F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits))
    # hot buckets, or none: their lookups
    dense = materialize(probes.join(crowded, ["seg", "value"], "left_semi").select("fp").distinct(), "dense")
    return fetched.select(F.col("fp").alias("u"), F.col("other").alias("v")).unionByName(
        dense_links(dense, max_bits)).distinct()


def dense_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """``links`` among fingerprints that are near each other in great numbers.

    Those within k bits meet under a value that both reach by at most ceil(k/2)
    flips; all that meet where some member needs floor(k/2) flips at most are
    within k bits of that member: each is linked to the smallest such."""
    near, far = max_bits // 2, (max_bits + 1) // 2
    flips = ball(BITS, far)
    own = len(ball(BITS, near))      # the first masks are those of at most ``near`` flips
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in flips])
    table = prints.select("fp", F.posexplode(masks).alias("pos", "mask")).select(
        "fp", (F.col("pos") < own).alias("near"), F.col("fp").bitwiseXOR(F.col("mask")).alias("z"))
    centers = table.filter("near").groupBy("z").agg(F.min("fp").alias("center"))
    return table.join(centers, "z").filter(
        (F.col("center") != F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))) <= max_bits)) \
        .select(F.col("fp").alias("u"), F.col("center").alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the fingerprint of every row and the smallest id
    reachable over links of at most ``max_bits`` differing bits.

    Null, empty and white-space texts have fingerprint 0 and are linked like
    any other.  A row with a null id gets the smallest id of its component,
    null if no row of it has one.  Repeated rows come out as often as they come
    in.  An empty table gives an empty result; other columns are not read.
    """
    prints = materialize(docs.select(F.col(id_col).cast("long").alias("id"),
                                     fingerprint(F.col(text_col), shingle).alias("fp")), "fp")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    comp = components(links(distinct.select("fp"), max_bits))
    joined = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(joined.join(lowest, "component").select("fp", "component_id"), "fpcomp")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component: of its rows the smallest by doc_id,
    fingerprint and text digest.

    A doc_id that repeats with other texts is another document for each of them,
    so no text goes with another's component.  Rows that repeat doc_id and text
    are copies: the first by their other columns stays.  Rows with a null doc_id
    cannot be told apart by id and all stay.  Null, empty and very long texts are
    documents like any other; an empty table gives an empty result; all columns
    stay (names that begin with ``__`` are used in between).
    """
    from pyspark.sql import Window
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    prints = materialize(docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("id"), digest.alias("digest"),
        fingerprint(F.col("text"), shingle).alias("fp")), "fp")
    least = prints.groupBy("fp").agg(F.min(F.struct("id", "fp", "digest")).alias("least"))
    comp = components(links(least.select("fp"), max_bits))
    chosen = least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").groupBy(
        F.coalesce("component", "fp").alias("component")).agg(F.min("least").alias("least")).select(
        F.col("least.id").alias("__id"), F.col("least.digest").alias("__kept"))
    columns = docs.columns
    rest = F.to_json(F.struct(F.col("text").isNull().alias("n"), *[c for c in columns if c != "text"]))
    kept = (docs.withColumn("__digest", digest)
            .join(chosen, (F.col("doc_id") == F.col("__id")) & (F.col("__digest") == F.col("__kept")))
            .withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__kept").orderBy(rest)))
            .filter("__n = 1").select(*columns))
    return kept.unionByName(docs.filter("doc_id is null"))
