"""Hard negatives by a cover tree (operator 12).

Candidates get one more coordinate, which brings all of them to the largest
norm; an anchor gets a zero there.  The inner product of an anchor with a
candidate then is the cosine of their angle times two lengths, and a node whose
rows are within some angle of its centre bounds the inner products of them all
from both sides.

The tree is in two parts.  Its top are cells around pivots, a bounded sample;
every row belongs to the nearest pivot.  The cells' bounds tell which anchors
they can matter to, and only those are sent there.  Below, every block of a cell
(a large cell is dealt into several) has a cover tree: centres in farthest-first
order, a level for each halving of the covering radius, so that every row is
within a level's radius of a centre and centres of a level are further than it
from each other; the last level ends when there is a centre for every LEAF rows,
as vectors that are all far from each other would be a centre each.  A search
goes down level by level for a tile of anchors at once, leaves out nodes whose
bounds are outside of all windows or below what was found, and scores the rows of
leaves exactly, those of the best bounds first.

Where vectors are spread evenly every anchor meets every row.  What travels then
is kept far below that product: blocks are gathered in parts, anchors in chunks,
a row goes once to each chunk that its part meets, an anchor once to each part,
and a part returns the first rows of its windows alone.  Both are as large as a
task holds, so that the copies stay few; a task holds no more at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import is_sound, matrix, whole

#: Rows of a block; pivots (that many at most, fewer if there are fewer blocks of
#: rows); rows of a leaf that is not split.
ROWS = 4096
PIVOTS = 256
LEAF = 32

#: Parts that the blocks are gathered in, so that all executors get some; more
#: when the rows of one would be over PART_ROWS or their components over
#: PART_BYTES as 4-byte numbers.  Anchors that meet a part in one task, within the
#: bounds and by the bytes of their components.
PARTS = 64
PART_ROWS, PART_BYTES = 1 << 18, 64 << 20
CHUNK, CHUNK_BYTES = (1024, 1 << 16), 16 << 20

#: Anchors of a tile, rows that it is scored with at once, and rows of the first
#: such step while nothing is known of what a tile will find.
TILE, STEP, FIRST = 512, 4096, 128

#: Partitions for each part and chunk of a search, so that few have two, and at
#: most: tasks cost time rather than bytes, by which Spark would gather them.
SPREAD, TASKS = 4, 2000

#: Anchors that are handed on at a time on their way to the parts.
SENT_ROWS = 8192

_NONE = np.iinfo(np.int64).max


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with one more coordinate, which gives each the length ``norm``."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(1)))])


def angle(dot: np.ndarray, size) -> np.ndarray:
    """Angle of a dot product of vectors whose lengths multiply to ``size``."""
    return np.arccos(np.clip(np.divide(dot, size, out=np.zeros_like(dot), where=np.asarray(size) > 0), -1, 1))


def bounds(dot: np.ndarray, spread: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product with rows within ``spread`` of centres:
    of the angle that ``dot`` stands for, more and less by the spread."""
    at = np.divide(dot, size, out=np.zeros(np.shape(dot)), where=np.asarray(size) > 0)
    np.clip(at, -1, 1, out=at)
    edge, slack = np.cos(spread), 1 + 1e-6 * size
    along, across = at * edge, np.sqrt(1 - at * at) * np.sin(spread)
    return (size * np.where(at > -edge, along - across, -1.0) - slack,
            size * np.where(at < edge, along + across, 1.0) + slack)


def exact_type(norm: float) -> type:
    """Floats that hold every sum of a score exactly: none is over the norm's square."""
    return np.float32 if norm * norm <= 1 << 24 else np.float64


def true_at(flags: np.ndarray) -> np.ndarray:
    """Positions of what is true in a flat array with little of it, eight at a time."""
    words = len(flags) // 8
    some = np.flatnonzero(flags[:words * 8].view(np.uint64))
    at = (some[:, None] * 8 + np.arange(8)).ravel()
    return np.append(at[flags[at]], words * 8 + np.flatnonzero(flags[words * 8:]))


class Found:
    """The first k rows (score, id) of each window of each query, by falling
    score, then id; where there are fewer, -inf and the largest id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        """low, high: a row for each query; a window that is none has inf and -inf."""
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), -np.inf)
        self.ids = np.full((*low.shape, k), _NONE)
        self.room = np.empty(0), np.empty(0, bool)

    def scored(self, queries: np.ndarray, rows: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each query and row, and where they are as high as the
        query needs, both flat and good until the next call."""
        n = len(queries) * len(rows)
        if len(self.room[0]) < n or self.room[0].dtype != queries.dtype:
            self.room = np.empty(n, queries.dtype), np.empty(n, bool)
        scores, high = (v[:n].reshape(len(queries), len(rows)) for v in self.room)
        np.matmul(queries, rows.T, out=scores)
        np.greater_equal(scores, need.astype(scores.dtype)[:, None], out=high)
        return scores.ravel(), high.ravel()

    def open(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the queries ``at``: the least and the largest score that some window
        still takes, and the largest id."""
        worst, low, high = self.scores[at, :, -1], self.low[at], self.high[at]
        # a window full of its largest score takes smaller ids alone
        upto = np.where(low > high, -_NONE, np.where(worst >= high, self.ids[at, :, -1] - 1, _NONE))
        return np.maximum(low, worst).min(1), high.max(1), upto.max(1)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows for the queries ``at``, which may repeat."""
        n = self.low.shape[1]
        keys, rows = [], []
        for j in range(n):
            worst, last = self.scores[at, j, -1], self.ids[at, j, -1]
            some = np.flatnonzero((scores >= self.low[at, j]) & (scores <= self.high[at, j]) & (
                (scores > worst) | ((scores == worst) & (ids < last))))
            keys.append(at[some] * n + j)
            rows.append(some)
        key, row = np.concatenate(keys), np.concatenate(rows)
        if not len(key):
            return
        order = np.lexsort((ids[row], -scores[row], key))
        key, row = key[order], row[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
        first = rank < self.k
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))[first]
        new_scores = np.full((len(starts), self.k), -np.inf)
        new_ids = np.full((len(starts), self.k), _NONE)
        new_scores[group, rank[first]], new_ids[group, rank[first]] = scores[row[first]], ids[row[first]]
        own = key[starts]
        all_scores, all_ids = self.scores.reshape(-1, self.k), self.ids.reshape(-1, self.k)     # views
        both = np.hstack([all_scores[own], new_scores])
        both_ids = np.hstack([all_ids[own], new_ids])
        best = np.lexsort((both_ids, -both))[:, :self.k]
        all_scores[own], all_ids[own] = np.take_along_axis(both, best, 1), np.take_along_axis(both_ids, best, 1)


class CoverTree:
    """A cover tree over the rows of a block."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm: float, leaf: int = LEAF):
        self.norm, n = norm, len(x)
        y = augmented(x.astype(np.float64), norm)
        square = (y * y).sum(1)

        def distance(j):
            return np.maximum(0.0, square + square[j] - 2 * (y @ y[j]))
        # farthest-first centres; a level ends when its radius covers all rows
        centres, level_of, owners = [0], [0], []
        owner, gap = np.zeros(n, np.int64), distance(0)
        radius = 2 * norm
        while True:
            while gap.max() > radius * radius and len(centres) * leaf < n:
                j = int(gap.argmax())
                d = distance(j)
                d[j] = 0.0
                near = d < gap
                owner[near], gap = j, np.minimum(gap, d)
                centres.append(j)
                level_of.append(len(owners))
            owners.append(owner.copy())
            sizes = np.bincount(owner, minlength=n)
            # done when each cell is small or holds copies alone; what is no
            # wider than rounding can not be told apart
            wide = np.zeros(n)
            np.maximum.at(wide, owner, gap)
            if not ((sizes > leaf) & (wide > 1e-9 * norm * norm)).any() or len(centres) * leaf >= n:
                break
            radius /= 2
        entered = dict(zip(centres, level_of))
        # nodes (level, centre), each with the rows below it
        above, top = owners[-1], len(owners) - 1
        ancestors = [above]
        for level in range(top - 1, -1, -1):
            up = {c: c if entered[c] <= level else int(owners[level][c]) for c in set(ancestors[0].tolist())}
            ancestors.insert(0, np.array([up[c] for c in ancestors[0].tolist()], np.int64))
        self.order = order = np.lexsort(ancestors[::-1])
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        y, ancestors = y[order], [a[order] for a in ancestors]
        position = np.empty(n, np.int64)
        position[order] = np.arange(n)
        first, last, centre, spread, least, label, children = [], [], [], [], [], [], []
        previous = []                       # nodes of the level above
        for level, a in enumerate(ancestors):
            cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            if level:                       # a node ends where its parent does
                cuts = np.union1d(cuts, [first[p] for p in previous])
            stops, nodes = np.append(cuts[1:], n), []
            for i, j in zip(cuts.tolist(), stops.tolist()):
                c = int(position[a[i]])
                rho = angle(y[i:j] @ y[c], norm * norm).max() if norm else 0.0
                own = self.labels[i:j]
                nodes.append(len(first))
                first.append(i)
                last.append(j)
                centre.append(self.x[c])
                spread.append(rho)
                least.append(self.ids[i:j].min())
                label.append(int(own[0]) if (own == own[0]).all() else None)
                children.append([])
            for p in previous:
                children[p] = [q for q in nodes if first[p] <= first[q] and last[q] <= last[p]]
            previous = nodes
        self.first, self.last = np.array(first), np.array(last)
        self.centre, self.spread, self.least = np.array(centre), np.array(spread), np.array(least)
        self.mixed = np.array([v is None for v in label])
        self.label = np.array([0 if v is None else v for v in label])
        self.children = [np.array(c, np.int64) for c in children]

    def search_all(self, queries: np.ndarray, own: np.ndarray, itself: np.ndarray, alike: bool, found: Found,
                   at: np.ndarray) -> None:
        """Add to the queries ``at`` of ``found`` the rows of each query's label
        ``own`` if ``alike``, else of others; ``itself`` is the position of each
        query among the rows, or -1."""
        size = np.sqrt((queries.astype(np.float64) ** 2).sum(1))[:, None] * self.norm
        need, limit, upto = found.open(at)

        def wanted(nodes):
            """Nodes that some window of each query can take a row of, and their bounds."""
            least, most = bounds(queries @ self.centre[nodes].T, self.spread[nodes], size)
            return ((most >= need[:, None]) & (least <= limit[:, None]) & (self.least[nodes] <= upto[:, None])
                    & (self.mixed[nodes] | ((self.label[nodes] == own[:, None]) == alike))), most

        ok = wanted(np.zeros(1, np.int64))[0][:, 0]
        if not ok.all():
            queries, own, itself, at, size, need, limit, upto = (
                v[ok] for v in (queries, own, itself, at, size, need, limit, upto))
        if not len(at):
            return
        nodes, ok, most = np.zeros(1, np.int64), np.ones((len(at), 1), bool), None
        while len(self.children[nodes[0]]):             # leaves are all on the last level
            below = [self.children[i] for i in nodes]
            parent = np.repeat(np.arange(len(nodes)), [len(c) for c in below])
            nodes = np.concatenate(below)
            some, most = wanted(nodes)
            ok = some & ok[:, parent]
            there = ok.any(0)
            nodes, ok, most = nodes[there], ok[:, there], most[:, there]
            if not len(nodes):
                return
        if most is None:
            most = np.full(ok.shape, np.inf)
        labels = np.unique(own)
        order = np.argsort(-np.where(ok, most, -np.inf).max(0), kind="stable")
        step, i = (STEP if (need > -np.inf).all() else FIRST), 0
        while i < len(order):
            ends = np.cumsum(self.last[nodes[order[i:]]] - self.first[nodes[order[i:]]])
            n = max(1, int(np.searchsorted(ends, step, "right")))
            taken, i, step = order[i:i + n], i + n, min(2 * step, STEP)
            live = ok[:, taken] & (most[:, taken] >= need[:, None])
            who, leaves = np.flatnonzero(live.any(1)), nodes[taken[live.any(0)]]
            if not len(who):
                continue
            rows = np.concatenate([np.arange(self.first[j], self.last[j]) for j in leaves])
            if alike or len(labels) == 1:               # of few labels the others' rows need no score
                same = (self.labels[rows][:, None] == labels).any(1) if len(labels) < 8 else np.isin(self.labels[rows], labels)
                rows = rows[same == alike]
                if not len(rows):
                    continue
            scores, high = found.scored(queries if len(who) == len(at) else queries[who], self.x[rows], need[who])
            hit = true_at(high)
            who, row = who[hit // len(rows)], rows[hit % len(rows)]
            scores, ids = scores[hit].astype(np.float64), self.ids[row]
            keep = ((self.labels[row] == own[who]) == alike) & (row != itself[who]) & (scores <= limit[who]) & (
                ids <= upto[who])
            if keep.any():
                found.add(at[who[keep]], scores[keep], ids[keep])
                need, limit, upto = found.open(at)

    def search(self, query: np.ndarray, own: int, windows: np.ndarray, alike: bool, itself: int | None, k: int):
        """For each window (lo, hi) the first k rows (score, id) with lo <= score
        <= hi, of the query's label ``own`` if ``alike``, else of another;
        ``itself`` is the position of the query among the rows."""
        found = Found(windows[None, :, 0].astype(float), windows[None, :, 1].astype(float), k)
        self.search_all(query[None], np.array([own]), np.array([-1 if itself is None else itself]), alike, found,
                        np.zeros(1, np.int64))
        return [(s[s > -np.inf], i[s > -np.inf]) for s, i in zip(found.scores[0], found.ids[0])]


_FOUND = "arow long, pos int, id long, score double"


def windows_of(column: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pos, lo and hi of each row's windows; inf and -inf where a row has fewer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    sizes, wins = np.diff(ends), column.values.slice(ends[0], ends[-1] - ends[0])
    shape = len(sizes), int(sizes.max()) if len(sizes) else 0
    out = np.zeros(shape, np.int32), np.full(shape, np.inf), np.full(shape, -np.inf)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], sizes)
    for values, name in zip(out, ("pos", "lo", "hi")):
        values[at] = wins.field(name).to_numpy(zero_copy_only=False)
    return out


def _search(rows: DataFrame, sent: DataFrame, norm: float, dims: int, alike: bool, k: int, leaf: int, rows_per_block: int,
            chunk: int, tasks: int, at_home: bool = False) -> DataFrame:
    """The first k rows of each window in each part that an anchor was sent to.
    rows: row, id, label, x, cell, part; sent: arow, label, x, home, part, wins
    (array of pos, lo, hi).  An anchor meets the rows of the cell ``home`` if
    ``at_home``, else those of all other cells."""
    chunks = F.broadcast(materialize(sent.groupBy("part").agg(
        F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "chunks"))           # a row for each part
    blocks = rows.join(chunks, "part").select(
        "row", "id", "label", "x", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    there = sent.join(chunks, "part").select(
        "arow", F.col("label").alias("own"), F.col("x").alias("q"), F.coalesce("home", F.lit(-1)).alias("home"), "wins",
        F.col("part").alias("to_part"), F.pmod(F.xxhash64("arow"), F.col("chunks")).cast("int").alias("to_chunk"))
    kind = exact_type(norm)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"arow": pa.array([], pa.int64()), "pos": pa.array([], pa.int32()),
                             "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        right = right.sort_by([("own", "ascending"), ("home", "ascending")])
        arow, own, home = (right[c].to_numpy() for c in ("arow", "own", "home"))
        queries, (pos, low, high) = matrix(right["q"], dims).astype(kind), windows_of(right["wins"])
        found = Found(low, high, k)
        row, ids, labels, cell = (left[c].to_numpy() for c in ("row", "id", "label", "cell"))
        x, order = matrix(left["x"], dims), np.lexsort((labels, cell))
        edges = np.append(np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)), len(order))
        for a, b in zip(edges[:-1], edges[1:]):
            here = cell[order[a]]
            meets = (home == here) == at_home
            if not meets.any():
                continue
            for block in np.array_split(order[a:b], -(-(b - a) // rows_per_block)):
                tree = CoverTree(x[block].astype(kind), ids[block], labels[block], norm, leaf)
                rows = row[block][tree.order]
                sorter = np.argsort(rows)
                for i in range(0, len(arow), TILE):
                    at = i + np.flatnonzero(meets[i:i + TILE])
                    if len(at):
                        itself = sorter[np.searchsorted(rows, arow[at], sorter=sorter).clip(max=len(rows) - 1)]
                        tree.search_all(queries[at], own[at], np.where(rows[itself] == arow[at], itself, -1), alike,
                                        found, at)
        query, window, rank = np.nonzero(found.scores > -np.inf)
        return pa.table({"arow": arow[query], "pos": pos[query, window], "id": found.ids[query, window, rank],
                         "score": found.scores[query, window, rank]})
    key, to = ["part", "chunk"], ["to_part", "to_chunk"]
    return blocks.repartition(tasks, *key).groupBy(*key).cogroup(
        there.repartition(tasks, *to).groupBy(*to)).applyInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window."""
    order = Window.partitionBy("arow", "pos").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5,
                   share: int = 80, id_col: str = "vec_id", vector_col: str = "embedding",
                   rows_per_block: int = ROWS, pivots: int = PIVOTS, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for each anchor and each of its ``positives`` nearest rows of its label, the
    first ``negatives`` rows of other labels that score at most as high as the
    positive, and at least ``share`` per cent of it.

    A score is the inner product of the vectors' components floor(256 x), whole
    numbers, exact while it is below 2^53.  ``is_anchor`` and ``label`` are
    columns of ``table`` (label a whole number).  Rows with a null id, a null
    label or a vector that is null or holds nulls or values that are not finite
    take no part; of vectors of several lengths the shorter end in zeros.  Ties
    go to the smaller id.  Rows that repeat an id are rows of their own, an
    anchor each.  Where a positive's score is negative no row fits.  An empty
    table, or one without anchors, gives an empty result; other columns are not
    read.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                         F.coalesce(is_anchor, F.lit(False)).alias("anchor"), vector.alias("v")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & is_sound(F.col("v")))
    base = materialize(sound.select("id", "label", "anchor", whole(F.col("v")).alias("x"))
                       .withColumn("row", F.monotonically_increasing_id()), "vectors")
    head = base.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("x")).alias("d"),
                    F.max(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long")
    if not head["n"]:
        return table.sparkSession.createDataFrame([], schema)
    dims, norm = max(head["d"], 1), float(np.sqrt(head["square"]))
    n_pivots = min(pivots, -(-head["n"] // rows_per_block))
    points = matrix(pa.array([r["x"] for r in base.orderBy(F.xxhash64("row"), "row").limit(n_pivots)
                             .select("x").collect()], pa.list_(pa.float64())), dims)
    tops = augmented(points, norm)

    # components as short numbers where they are: these are what is shuffled
    short = norm < 1 << 15
    stored = pa.int16() if short else pa.float64()

    def deal(batches):
        for batch in batches:
            x = matrix(batch["x"], dims)
            dot = augmented(x, norm) @ tops.T
            cell = dot.argmax(1)
            spread = angle(dot[np.arange(len(cell)), cell], norm * norm)
            columns = dict(zip(batch.schema.names, batch.columns)) | {
                "x": batch["x"].cast(pa.list_(stored)), "cell": pa.array(cell, pa.int32()), "spread": pa.array(spread)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    numbers = "array<short>" if short else "array<double>"
    dealt = materialize(base.mapInArrow(deal, f"id long, label long, anchor boolean, x {numbers}, row long, "
                                              "cell int, spread double"), "cells")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("spread").alias("spread")).orderBy("cell").collect()
    known = np.array([r["cell"] for r in cells])
    centres, spreads = points[known], np.array([r["spread"] for r in cells])
    # blocks of all cells in a row, and so many of them to a part
    n_blocks = np.array([-(-r["n"] // rows_per_block) for r in cells])
    offsets = np.cumsum(n_blocks) - n_blocks
    most = max(1, min(PART_ROWS, PART_BYTES // (4 * dims)) // rows_per_block)
    per = min(most, -(-int(n_blocks.sum()) // PARTS))
    first_part, last_part = offsets // per, (offsets + n_blocks - 1) // per
    holds = np.zeros((len(known), int(last_part.max()) + 1), np.float32)
    for i, (a, b) in enumerate(zip(first_part, last_part)):
        holds[i, a:b + 1] = 1
    chunk = min(max(CHUNK[0], CHUNK_BYTES // (4 * dims)), CHUNK[1])
    tasks = max(1, min(TASKS, SPREAD * holds.shape[1] * -(-head["anchors"] // chunk)))

    def of_cell(values) -> Column:
        return F.create_map(*[F.lit(int(v)) for pair in zip(known, values) for v in pair])[F.col("cell")]
    sub = F.pmod(F.xxhash64("row"), of_cell(n_blocks))
    rows = dealt.select("row", "id", "label", "x", "cell", F.floor((of_cell(offsets) + sub) / per).cast("int").alias("part"))

    def reach(batches):
        """Send each anchor to the parts with cells that can hold a row of one of its windows."""
        for batch in batches:
            x, (_, low, high) = matrix(batch["x"], dims).astype(np.float64), windows_of(batch["wins"])
            home = batch["home"].fill_null(-1).to_numpy()
            least, most = bounds(x @ centres.T, spreads, np.sqrt((x * x).sum(1))[:, None] * norm)
            can = np.zeros(least.shape, bool)
            for j in range(low.shape[1]):
                can |= (most >= low[:, j:j + 1]) & (least <= high[:, j:j + 1])
            can &= known != home[:, None]
            take, to = np.nonzero(can.astype(np.float32) @ holds)
            for i in range(0, len(take), SENT_ROWS):
                some = pa.array(take[i:i + SENT_ROWS])
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].take(some) for c in ("arow", "label", "x", "home", "wins")),
                     pa.array(to[i:i + SENT_ROWS], pa.int32())], ["arow", "label", "x", "home", "wins", "part"])
    sent_schema = (f"arow long, label long, x {numbers}, home int, "
                   "wins array<struct<pos: int, lo: double, hi: double>>, part int")

    def send(anchors: DataFrame) -> DataFrame:
        return materialize(anchors.mapInArrow(reach, sent_schema), "sent")

    def search(sent: DataFrame, alike: bool, k: int, at_home: bool = False) -> DataFrame:
        return _search(rows, sent, norm, dims, alike, k, leaf, rows_per_block, chunk, tasks, at_home)

    def window(pos, lo, hi) -> Column:
        return F.struct(pos.cast("int").alias("pos"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    inf = float("inf")
    anchors = dealt.filter("anchor").select(F.col("row").alias("arow"), "label", "x", "cell", F.col("id").alias("aid"))

    # positives: first in the anchor's own cell, then where a better one can be
    everything = F.array(window(F.lit(0), F.lit(-inf), F.lit(inf)))
    home = anchors.select("arow", "label", "x", F.col("cell").alias("home"), everything.alias("wins"), F.explode(
        F.sequence(of_cell(first_part), of_cell(last_part))).alias("part"))
    near = materialize(_first(search(home, True, positives, at_home=True), positives), "near")
    floor = near.filter(F.col("rank") == positives).select("arow", F.col("score").alias("floor"))
    further = anchors.join(floor, "arow", "left").select(
        "arow", "label", "x", F.col("cell").alias("home"),
        F.array(window(F.lit(0), F.coalesce("floor", F.lit(-inf)), F.lit(inf))).alias("wins"))
    better = search(send(further), True, positives)
    best = materialize(_first(near.drop("rank").unionByName(better), positives).select(
        "arow", F.col("rank").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("top")), "positives")

    # negatives: a window below each positive, at most ``positives`` of them
    wins = best.filter("top >= 0").groupBy("arow").agg(F.collect_list(window(
        F.col("pos"), F.ceil(F.col("top") * share / 100), F.col("top"))).alias("wins"))
    looking = anchors.join(wins, "arow").select("arow", "label", "x", F.lit(None).cast("int").alias("home"), "wins")
    found = _first(search(send(looking), False, negatives), negatives)
    return (found.join(best, ["arow", "pos"]).join(anchors.select("arow", "aid"), "arow").select(
        F.col("aid").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
        F.col("top").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score")))
