import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import mixing


def brute(children, budget):
    """Shares of [(cap, weight)]: fill whoever is full at the common level, again and again."""
    out, live = {}, {i for i, (c, w) in enumerate(children) if w > 0}
    while live:
        rest = budget - sum(out.values())
        total = sum(children[i][1] for i in live)
        full = {i for i in live if children[i][0] * total <= rest * children[i][1]}
        if not full:
            out.update({i: rest * children[i][1] // total for i in live})
            break
        out.update({i: children[i][0] for i in full})
        live -= full
    return [out.get(i, 0) for i in range(len(children))]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 5)), min_size=1, max_size=6), st.integers(0, 100))
def test_share_among_siblings(spark, children, portion):
    budget = sum(c for c, _ in children) * portion // 100
    df = spark.createDataFrame([(f"c{i}", c, w, budget) for i, (c, w) in enumerate(children)],
                               "name string, cap long, weight long, given long")
    got = [r.budget for r in mixing.share(df, [], "name").orderBy("name").collect()]
    assert got == brute(children, budget)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 1, 1, 10), ("a", "y", 1, 1, 500), ("b", "x", 1, 1, 500), ("b", "y", 1, 1, 500)],
        "l0 string, l1 string, __w0 long, __w1 long, cap long")
    got = {(r.l0, r.l1): r.budget for r in mixing.allocate(leaves, ["l0", "l1"], 400).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    got = {(r.l0, r.l1): r.budget for r in mixing.allocate(leaves, ["l0", "l1"], 1200).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 345, ("b", "y"): 345}


def mixed(docs, **kw):
    return mixing.mix(docs, {"domain": F.lit("d"), "lang": F.col("lang"), "source": F.col("source")},
                      [F.lit(1), F.lit(1), F.when(F.col("source") == "off", 0).otherwise(1)], **kw)


@pytest.mark.parametrize("portion,epochs", [((1, 2), 1), ((1, 1), 3), ((5, 2), 4), ((0, 1), 2)])
def test_prefix_of_seeded_epochs(spark, portion, epochs):
    docs = spark.createDataFrame([(i % 90, "w " * (i % 90 % 7), "en" if i % 3 else "de", f"s{i % 2}") for i in range(100)],
                                 "doc_id long, text string, lang string, source string")
    rows = mixed(docs, portion=portion, max_epochs=epochs, seed=5).collect()
    tokens = sum(i % 90 % 7 for i in range(100))
    budget = min(tokens * portion[0] // portion[1], tokens * epochs)
    assert budget - 6 <= sum(r.take_tokens for r in rows) <= budget
    leaves = {}
    for r in rows:
        leaves.setdefault((r.lang, r.source), []).append(r)
    for leaf in leaves.values():
        last = max(r.epoch for r in leaf)
        size = {e: sum(r.n_tokens for r in leaf if r.epoch == e) for e in range(last + 1)}
        assert len({size[e] for e in range(last)}) <= 1         # all but the last epoch are whole
        assert sum(r.take_tokens < r.n_tokens for r in leaf) <= 1
        assert all(r.take_tokens > 0 for r in leaf) and last < epochs


def test_edges(spark, edge_docs, no_docs):
    out = mixed(edge_docs, portion=(1, 2))
    assert len(set(out.columns)) == len(out.columns) and {"domain", "epoch", "kept"} <= set(out.columns)
    assert out.filter("text is null or trim(text) = ''").count() == 0
    assert mixed(no_docs).count() == 0
    off = edge_docs.withColumn("source", F.lit("off"))
    assert mixed(off).count() == 0
    whole = mixed(edge_docs, portion=(1, 1), max_epochs=1)
    assert whole.count() == edge_docs.filter(mixing.count_tokens(F.col("text")) > 0).count()


def test_copies_at_the_cut(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s")] * 5, "doc_id long, text string, lang string, source string")
    rows = mixed(docs, portion=(2, 3), max_epochs=1).collect()
    assert sorted(r.take_tokens for r in rows) == [1, 3, 3, 3]


def test_cut_text(spark):
    df = spark.createDataFrame([(" a  b\tc\n", 3, 2), ("a b", 2, 2)], "text string, n long, take long")
    got = [r.t for r in df.select(mixing.cut_text(F.col("text"), F.col("n"), F.col("take")).alias("t")).collect()]
    assert got == ["a b", "a b"]


def test_columns_with_the_names_used_inside(spark):
    df = spark.range(40).selectExpr("id AS doc_id", "concat('w ', repeat('x ', int(id % 5))) AS text", "'en' AS lang",
                                    "concat('src', id % 3) AS source", "1 AS whole", "2 AS rest", "3 AS budget",
                                    "4 AS tokens", "5 AS base", "6 AS n", "7 AS given", "8 AS cap", "9 AS weight")
    out = mixing.mix(df, {"source": F.col("source")}, [F.lit(1)], portion=(1, 2))
    rows = out.collect()
    assert rows and all((r.whole, r["rest"], r.budget, r.tokens, r.base, r.n, r.given, r.cap, r.weight) ==
                        (1, 2, 3, 4, 5, 6, 7, 8, 9) for r in rows)
    assert sum(r.take_tokens for r in rows) > 0
