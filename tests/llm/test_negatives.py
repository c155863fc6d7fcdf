import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import negatives
from cadenza.llm.oracles import ORACLES
from cadenza.llm.queries import QUERIES

from .test_sql_queries import run_spark, run_sql


def brute(ids, labels, x, is_anchor, k=5, share=80):
    out = []
    for a in np.flatnonzero(is_anchor):
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if j != a and labels[j] == labels[a]][:k]:
            fit = [j for j in order if labels[j] != labels[a] and share * s[p] <= 100 * s[j] <= 100 * s[p]][:k]
            out += [(int(ids[a]), int(ids[p]), r + 1, int(ids[j]), int(s[p]), int(s[j])) for r, j in enumerate(fit)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                              "negative_score").collect())


def table(spark, ids, labels, x):
    return spark.createDataFrame([(int(i), int(c), (v / 256).tolist()) for i, c, v in zip(ids, labels, x)],
                                 "vec_id long, label int, embedding array<double>")


@pytest.mark.parametrize("kind", ["even", "clusters", "copies", "lengths"])
def test_tree(kind):
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (500, 6)).astype(float)
    if kind == "clusters":
        x = x[rng.integers(0, 9, 500)] + rng.integers(-2, 3, (500, 6))
    if kind == "copies":
        x[:300] = x[0]
    if kind == "lengths":
        x *= rng.integers(0, 9, (500, 1))
    ids, labels = rng.permutation(500), rng.integers(0, 3, 500)
    norm = float(np.sqrt((x * x).sum(1).max()))
    tree = negatives.CoverTree(x, ids, labels, norm, leaf=4)
    # every node covers its rows; children share out their parent's
    y = negatives.augmented(tree.x, norm)
    for i, kids in enumerate(tree.children):
        c = negatives.augmented(tree.centre[i:i + 1], norm)[0]
        at = negatives.angle(y[tree.first[i]:tree.last[i]] @ c, norm * norm)
        assert at.max() <= tree.spread[i] + 1e-6
        if len(kids):
            assert sorted(r for k in kids for r in range(tree.first[k], tree.last[k])) == \
                list(range(tree.first[i], tree.last[i]))
    for q in range(0, 500, 25):
        s = tree.x @ tree.x[q]
        windows = np.array([(-np.inf, np.inf), (0.0, float(np.median(s))), (np.median(s), s.max() * 0.8)])
        for alike in (True, False):
            got = tree.search(tree.x[q], int(tree.labels[q]), windows, alike, q, 5)
            for (lo, hi), (scores, found) in zip(windows, got):
                ok = ((tree.labels == tree.labels[q]) == alike) & (s >= lo) & (s <= hi) & (np.arange(500) != q)
                want = [j for j in np.lexsort((tree.ids, -s)) if ok[j]][:5]
                assert list(zip(scores, found)) == [(s[j], tree.ids[j]) for j in want]


def test_descent_skips_nodes():
    rng = np.random.default_rng(4)
    # one centre far out in each of 30 directions
    x = np.kron(np.eye(30) * 200, np.ones((40, 1))) + rng.integers(-3, 4, (1200, 30))
    tree = negatives.CoverTree(x, np.arange(1200), np.arange(1200) % 2, float(np.sqrt((x * x).sum(1).max())))
    seen = []
    inner = tree.x
    class Watched:
        def __getitem__(self, i):
            seen.append(len(i))
            return inner[i]
    tree.x = Watched()
    tree.search(inner[0], 0, np.array([(-np.inf, np.inf)]), True, 0, 5)
    assert sum(seen) < 300


@pytest.mark.parametrize("clusters", [False, True])
def test_several_blocks_and_cells(spark, clusters):
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 51, (700, 5)).astype(float)
    if clusters:
        x = x[rng.integers(0, 12, 700)] + rng.integers(-1, 2, (700, 5))
    ids, labels = rng.permutation(700) * 2, rng.integers(0, 4, 700)
    got = negatives.hard_negatives(table(spark, ids, labels, x), F.col("vec_id") % 50 == 0, F.col("label"),
                                   rows_per_block=64, pivots=7, leaf=4)
    want = brute(ids, labels, x, ids % 50 == 0)
    assert want and rows(got) == want


def test_ties_copies_and_repeated_ids(spark):
    x = np.array([[10, 0]] * 40 + [[8, 3]] * 30 + [[9, 9]] * 3, float)
    ids = np.array([0, 0] + list(range(1, 72)))
    labels = np.array([1, 1] + [i % 3 for i in range(71)])
    got = negatives.hard_negatives(table(spark, ids, labels, x), F.col("vec_id") % 50 == 0, F.col("label"),
                                   rows_per_block=16)
    assert rows(got) == brute(ids, labels, x, ids % 50 == 0)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert run_spark(spark, sf, "op12_negatives") == run_sql(sf, ORACLES["op12_negatives"])


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 1.0], 1), (0, [3.0, 1.0], 1), (1, None, 1), (2, [1.0, 0.5], 2), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1),
            (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (None, [1.0, 1.0], 2), (7, [1.0, 2.0], 1), (8, [-1.0, 0.5], None),
            (9, [2.0, 0.5], 2), (100, [-1.0, -1.0], 2), (200, [0.0, -0.0], 2), (201, [0.9, 0.9], 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = run_spark(spark, str(tmp_path), "op12_negatives")
    assert got[0] and got == run_sql(str(tmp_path), ORACLES["op12_negatives"])
    odd = df.selectExpr("*", "1 AS row", "2 AS x", "3 AS cell", "4 AS anchor", "5 AS id")
    assert negatives.hard_negatives(odd, F.col("vec_id") == 0, F.col("label")).count() > 0
    none = negatives.hard_negatives(odd.limit(0), F.lit(True), F.col("label"))
    assert none.count() == 0 and none.columns == QUERIES["op12_negatives"](spark, str(tmp_path)).columns
    assert negatives.hard_negatives(odd, F.lit(False), F.col("label")).count() == 0
    short = df.unionByName(spark.createDataFrame([(300, [2.0], 2), (301, [], 3)], df.schema))
    assert negatives.hard_negatives(short, F.col("vec_id") == 0, F.col("label")).count() > 0


def test_a_search_of_many_at_once():
    rng = np.random.default_rng(8)
    x = rng.integers(-60, 60, (900, 6)).astype(np.float32)
    x[300:500], x[500:600] = x[0], x[600:700]
    ids, labels = rng.permutation(900) - 450, rng.integers(0, 3, 900)
    ids[7], ids[8] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    tree = negatives.CoverTree(x, ids, labels, float(np.sqrt((x * x).sum(1).max())), leaf=4)
    at = np.arange(900)
    scores = tree.x @ tree.x.T
    top = np.sort(scores, 1)[:, -3:].astype(float)
    low, high = np.ceil(top * 0.8), top
    low[::7, 1], high[::7, 1] = np.inf, -np.inf         # no window
    for alike in (True, False):
        found = negatives.Found(low, high, 5)
        tree.search_all(tree.x, tree.labels, at, alike, found, at)
        for q in at:
            for j in range(3):
                ok = ((tree.labels == tree.labels[q]) == alike) & (at != q) & (scores[q] >= low[q, j]) & (scores[q] <= high[q, j])
                want = [(scores[q, r], tree.ids[r]) for r in np.lexsort((tree.ids, -scores[q])) if ok[r]][:5]
                assert [(s, i) for s, i in zip(found.scores[q, j], found.ids[q, j]) if s > -np.inf] == want


def test_bounds_cover_what_is_within_the_spread():
    at, spread = np.meshgrid(np.linspace(0, np.pi, 60), np.linspace(0, np.pi, 60))
    least, most = negatives.bounds(9.0 * np.cos(at), spread, np.full_like(at, 9.0))
    for turn in np.linspace(-1, 1, 21):
        score = 9.0 * np.cos(np.clip(at + turn * spread, 0, np.pi))
        assert (least <= score).all() and (score <= most).all()


@pytest.mark.parametrize("scale", [1, 50, 5000])
def test_copies_of_anchors_and_rows_stay_few(spark, monkeypatch, scale):
    """An anchor goes once to each of 64 parts at most, however many blocks and
    cells there are, and the rows are as before, also in floats of 8 bytes."""
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 51, (700, 6)).astype(float) * scale
    ids, labels = rng.permutation(700), rng.integers(0, 4, 700)
    sent, write = [], negatives.materialize
    monkeypatch.setattr(negatives, "materialize", lambda df, tag: sent.append(df.count()) or write(df, tag)
                        if tag == "sent" else write(df, tag))
    got = negatives.hard_negatives(table(spark, ids, labels, x), F.col("vec_id") % 10 == 0, F.col("label"),
                                   rows_per_block=4, leaf=4)
    assert rows(got) == brute(ids, labels, x, ids % 10 == 0)
    assert len(sent) == 2 and max(sent) <= 70 * 64
