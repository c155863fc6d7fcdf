import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import ann
from cadenza.llm.queries import op4_neighbours


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = (x * x[i]).sum(1)
        best = [int(j) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    pairs = [(q, i) for q, rows in want.items() for i, _ in rows]
    return np.mean([i in {j for j, _ in got.get(q, [])} for q, i in pairs])


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, ids[ids % 20 == 0], 20)
    got = found(op4_neighbours(spark, sf).withColumnRenamed("vec_id", "id"))
    assert recall(got, want) >= 0.9 and set(got) == set(want)
    score = {q: dict(rows) for q, rows in want.items()}
    assert all(s == score[q][i] for q, rows in got.items() for i, s in rows if i in score[q])


def test_several_blocks_and_lengths(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)) * rng.uniform(0.2, 3, (900, 1))
    ids = np.arange(900) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = found(ann.nearest(df, F.col("id") % 9 == 0, 10, rows=200, queries=64))
    assert recall(got, brute(ids, x, ids[ids % 9 == 0], 10)) >= 0.9


def test_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.nearest(df, F.col("id") % 50 == 0, 5, rows=16))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    few = ann.nearest(df.filter("vec_id in (0, 7, 100)"), F.col("id") == 0, 5)
    assert found(few)[0] == [(7, 1.0), (100, 0.0)]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (0, [3.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.5]), (9, [2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS block")
    got = found(ann.nearest(df, F.lit(True), 4))
    assert got == {0: [(9, 2.5), (8, -0.5)], 8: [(0, -0.5), (9, -1.75)], 9: [(0, 2.5), (8, -1.75)]}
    assert ann.nearest(df.limit(0), F.lit(True), 4).count() == 0
    assert ann.nearest(df, F.lit(False), 4).count() == 0
