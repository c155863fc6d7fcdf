"""G1 parts on the FIXTURES.md edge rows: P4, P5, W4, W5-then-P5, K1."""

from pyspark.sql import functions as F

from cadenza.functions.columns import year_in_range, year_of
from cadenza.operators import candidates as G1
from cadenza.schemas import SEARCH_HITS

CRIT = "request_id long, year_min int, year_max int, track_limit int"


def test_year_of_needs_four_characters(spark):
    df = spark.createDataFrame([("2010",), ("2010-05",), ("20",), ("",), (None,)], "d string")
    got = [r.y for r in df.select(year_of(F.col("d")).alias("y")).collect()]
    assert got == [2010, 2010, None, None, None]


def test_year_range_truthiness(spark):
    rows = [(None, 2000, 2010), (1999, 0, None), (2010, None, 2010), (1999, 2000, 2010), (2011, 2000, 2010),
            (0, 2000, 2010)]
    df = spark.createDataFrame(rows, "y int, lo int, hi int")
    got = [r.k for r in df.select(year_in_range(F.col("y"), F.col("lo"), F.col("hi")).alias("k")).collect()]
    assert got == [True, True, True, False, False, True]


def _hits(spark, rows):
    return spark.createDataFrame(rows, SEARCH_HITS)


def test_rejected_copy_does_not_block_later_copy(spark):
    hits = _hits(spark, [(1, 1, 1, "ok", 7, 50, "1990"), (1, 2, 1, "ok", 7, 50, "2005")])
    crit = spark.createDataFrame([(1, 2000, 2010, 30)], CRIT)
    out = G1.dedupe_hits(G1.filter_years(hits, crit)).collect()
    assert [(r.query_idx, r.release_date) for r in out] == [(2, "2005")]


def test_cap_applies_before_year_filter(spark):
    rows = [(1, 1, i, "ok", 100 + i, 10, "1990" if i <= 10 else "2005") for i in range(1, 13)]
    crit = spark.createDataFrame([(1, 2000, 2010, 30)], CRIT)
    kept = G1.filter_years(G1.cap_hits(_hits(spark, rows)), crit)
    assert kept.count() == 0


def test_failed_queries_and_null_items_are_skipped(spark):
    rows = [(1, 1, 1, "error", None, None, None), (1, 2, 1, "ok", None, 5, "2001"), (1, 3, 1, "ok", 9, 5, "2001")]
    assert [r.track_id for r in G1.usable_hits(_hits(spark, rows)).collect()] == [9]


def test_top_n_is_stable_by_popularity(spark):
    rows = [(1, 1, 1, "ok", 1, 50, "2001"), (1, 1, 2, "ok", 2, 70, "2001"),
            (1, 2, 1, "ok", 3, 50, "2001"), (1, 2, 2, "ok", 4, None, "2001")]
    crit = spark.createDataFrame([(1, None, None, 30)], CRIT)
    top = G1.top_n(G1.dedupe_hits(G1.filter_years(_hits(spark, rows), crit)))
    got = [(r.position, r.track_id) for r in top.orderBy("position").collect()]
    assert got == [(1, 2), (2, 1), (3, 3), (4, 4)]


def test_top_n_cuts_to_limit(spark):
    rows = [(1, 1, i, "ok", i, i, "2001") for i in range(1, 9)]
    crit = spark.createDataFrame([(1, None, None, 3)], CRIT)
    top = G1.top_n(G1.filter_years(_hits(spark, rows), crit))
    assert sorted(r.track_id for r in top.collect()) == [6, 7, 8]


def test_skipped_hits_are_counted(spark):
    rows = [(1, 1, 1, "ok", 5, "2010"), (1, 1, 2, "ok", None, "2010"), (1, 1, 3, "ok", 6, "abcd-01"),
            (1, 1, 4, "ok", 7, "20"), (1, 1, 5, "ok", 8, None), (1, 2, 1, "error", None, None),
            (1, 2, 2, "error", None, None), (1, 3, 1, None, None, None), (2, 1, 1, "ok", 5, "2010")]
    hits = spark.createDataFrame(rows, "request_id long, query_idx int, hit_rank int, status string, "
                                       "track_id long, release_date string")
    got = sorted(tuple(r) for r in G1.skipped_hits(G1.cap_hits(hits)).collect())
    assert got == [(1, 2, 1, 1), (2, 0, 0, 0)]
