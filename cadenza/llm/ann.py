"""Nearest neighbours by a forest of hash prefixes (operator 4).

Rows are dealt into blocks.  A block's forest has TREES sorted arrays of hash
strings of BITS signs of random projections, each with its rows in that order.
A query descends every tree to its longest matching prefix; from the longest
of these levels all trees ascend together, one bit at a time, and rows that
share the shorter prefix become candidates, scored exactly.  The ascent ends
when a row as near as the k-th found would have been missed in all trees with
a probability of at most MISS: near rows end it early, and rows that are far
from everything lead it up to the root, where it is exact.  No count of
candidates is capped.

Largest inner product becomes smallest angle by one more coordinate, which
gives every row the largest row's norm.  The queries, a stated set of rows,
meet all rows block by block: a task holds one block of rows and one of
queries, and gives each query's k nearest of the block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 32
BITS = 32
MISS = 0.1
SEED = 4
#: Rows and queries of a block: what a task holds.
ROWS = 8192
QUERIES = 1024


class Forest:
    """Sorted hash strings of a block of vectors."""

    def __init__(self, vectors: np.ndarray, norm: float):
        self.vectors, self.norm = vectors, norm
        rng = np.random.default_rng(SEED)       # the same planes in every block
        self.planes = rng.normal(size=(TREES * BITS, vectors.shape[1] + 1))
        unit = vectors / norm
        rest = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))
        codes = self._codes(np.column_stack([unit, rest]))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, 1)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """Hash strings (trees, rows) as integers of BITS bits."""
        bits = (x @ self.planes.T > 0).reshape(len(x), TREES, BITS)
        return (bits << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(2, dtype=np.int64).T

    def _ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 place of each prefix: (queries, levels, trees)."""
        shape = (codes.shape[1], BITS + 1, TREES)
        lo, hi = np.empty(shape, np.int64), np.empty(shape, np.int64)
        for t in range(TREES):
            for level in range(BITS + 1):
                prefix = codes[t] >> (BITS - level)
                lo[:, level, t] = np.searchsorted(self.codes[t], prefix << (BITS - level))
                hi[:, level, t] = np.searchsorted(self.codes[t], (prefix + 1) << (BITS - level))
        return lo, hi

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
        """For each query the rows and scores of its k nearest found; ``own``
        are the queries' ids, which are no candidates of theirs."""
        scale = np.linalg.norm(queries, axis=1)
        codes = self._codes(np.column_stack([queries / scale[:, None], np.zeros(len(queries))]))
        lo, hi = self._ranges(codes)
        for i, query in enumerate(queries):
            yield self._climb(query, scale[i] * self.norm, lo[i], hi[i], ids != own[i], ids, k)

    def _climb(self, query, largest, lo, hi, allowed, ids, k):
        order, seen = self.order, np.zeros(len(ids), bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        size = (hi - lo).sum(1)
        below = None
        for level in range(BITS, -1, -1):
            if not size[level] or (below is not None and size[level] == size[below] and level):
                continue        # no tree has more rows here
            fresh = np.zeros(len(ids), bool)
            for t in np.flatnonzero(hi[level] > lo[level]):
                if below is None:
                    fresh[order[t, lo[level, t]:hi[level, t]]] = True
                else:
                    fresh[order[t, lo[level, t]:lo[below, t]]] = True
                    fresh[order[t, hi[below, t]:hi[level, t]]] = True
            below = level
            fresh &= allowed & ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            rows = np.concatenate([rows, new])
            scores = np.concatenate([scores, self.vectors[new] @ query])
            if len(rows) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= kth - 1e-9 * largest
                rows, scores = rows[keep], scores[keep]
                same = 1 - np.arccos(np.clip(kth / largest, -1, 1)) / np.pi
                if (1 - same ** level) ** TREES <= MISS:
                    break
        exact = (self.vectors[rows] * query).sum(1)     # the same sum for equal vectors
        best = np.lexsort((ids[rows], -exact))[:k]
        return rows[best], exact[best]


def nearest(table: DataFrame, is_query: F.Column, k: int, id_col: str = "vec_id",
            vector_col: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, id and score of the k rows of largest inner product with
    each query, nearest first, ties to the smaller id.

    ``is_query`` tells the query rows by their id.  Rows with a null id or a
    vector that is null, empty, zero or holds nulls or values that are not
    finite take no part, nor do vectors of another length than the commonest.
    Of rows that repeat an id, that with the smallest vector (in array order)
    counts.  An empty table gives an empty result; other columns are not read.
    """
    vector = F.col(vector_col).cast("array<double>")
    big = F.lit(float("inf"))
    sound = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0))
    sizes = sound.groupBy(F.size("v").alias("dims")).agg(
        F.count_distinct("id").alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
        F.count_distinct(F.when(is_query, F.col("id"))).alias("q")).orderBy(F.desc("n"), "dims").first()
    schema = "query_id long, id long, score double"
    if sizes is None:
        return table.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    norm = float(np.sqrt(sizes["square"])) or 1.0
    row_blocks, query_blocks = -(-sizes["n"] // rows), max(1, -(-sizes["q"] // queries))
    one = sound.filter(F.size("v") == sizes["dims"]).groupBy("id").agg(F.min("v").alias("v"))
    # a block of rows meets each block of queries
    left = one.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).alias("block"),
                      F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    right = one.filter(is_query).select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")
                                        .alias("part")).select(
        "id", "v", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("block"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a, b = a.sort_values("id"), b.sort_values("id")
            ids, own = a["id"].to_numpy(), b["id"].to_numpy()
            forest = Forest(np.stack(a["v"].to_numpy()).astype(np.float64), norm)
            found = forest.search(np.stack(b["v"].to_numpy()).astype(np.float64), own, ids, k)
            out = [(q, ids[r], s) for q, (r, s) in zip(own, found)]
        n = [len(r) for _, r, _ in out]
        return pd.DataFrame({"query_id": np.repeat(np.array([q for q, _, _ in out], np.int64), n),
                             "id": np.concatenate([r for _, r, _ in out] + [np.zeros(0, np.int64)]),
                             "score": np.concatenate([s for _, _, s in out] + [np.zeros(0)])})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, schema)
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
