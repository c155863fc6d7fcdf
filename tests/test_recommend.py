"""Bounds and catalogue fields joined before a query row becomes ten."""

from cadenza.operators import recommend, search
from cadenza.sources import standins


def test_fields_are_joined_to_the_distinct_hits(spark, tmp_path):
    spark.range(1, 41).selectExpr("id AS p_partkey", "concat('blue ring ', id) AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type",
                                  "CAST(id AS INT) AS p_size", "900D + id AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    catalogue = standins.catalogue(spark, str(tmp_path))
    rows = spark.range(60).selectExpr("id AS request_id", "1 AS query_idx", "if(id % 2 = 0, 'blue ring', 'genre:promo') AS query",
                                      "CAST(NULL AS STRING) AS market")
    crit = spark.range(0, 60, 3).selectExpr("id AS request_id", "IF(id % 4 = 0, NULL, 2009) AS year_min", "2011 AS year_max")
    plain = recommend.recommend_post(search.search(rows, catalogue), crit, catalogue)
    sizes = []

    def details(hits):
        sizes.append(hits.count())
        return recommend.with_details(hits, catalogue)
    recs = search.search(recommend.with_bounds(rows, crit), catalogue, recommend.BOUNDS, details)
    got = recommend.recommend_post(recs, crit, catalogue)
    assert sizes == [20]                # two texts, however many requests
    assert got.columns == plain.columns and plain.count() > 50
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
