"""S1 S2 in the catalog, S3 S7 on bucketed tables, S4 S9 through Bloom filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators import catalog, store
from cadenza.plans import inspect
from cadenza.session import checkpoint_dir

TEXT = T.StringType()
BASE = T.StructType().add("id", TEXT).add("user_id", T.LongType()).add("created_at", T.TimestampType()) \
    .add("year", T.IntegerType())
WIDER = T.StructType().add("id", TEXT).add("note", TEXT).add(
    "tracks", T.ArrayType(T.StructType().add("id", TEXT).add("name", TEXT)))


@pytest.fixture()
def database(spark):
    name = catalog.new_database(spark, "t")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_create_twice_and_evolve(spark, database):
    table = f"{database}.playlists"
    day = dt.datetime(2024, 1, 1)
    catalog.create_table(spark, table, BASE, "year")
    catalog.insert(spark.createDataFrame([("a", 1, day, 2024)], BASE), table)
    catalog.create_table(spark, table, BASE, "year")                    # nothing changes
    assert [r.id for r in spark.table(table).collect()] == ["a"]
    assert catalog.add_columns(spark, table, WIDER) == ["note", "tracks"]
    assert catalog.add_columns(spark, table, WIDER) == []
    new = spark.createDataFrame([("b", [("t", "n")], 2025), ("c", None, 2024)],
                                "id string, tracks array<struct<id:string,name:string>>, year int")
    catalog.insert(new, table)
    got = {r.id: (r.user_id, r.tracks and [t.id for t in r.tracks], r.note, r.year) for r in spark.table(table).collect()}
    assert got == {"a": (1, None, None, 2024), "b": (None, ["t"], None, 2025), "c": (None, None, None, 2024)}
    assert "PartitionFilters: [isnotnull(year" in inspect.plan_text(spark.table(table).where("year = 2025"))


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_upsert_leaves_the_store_where_it_is(spark, database, no_broadcast):
    existing = spark.range(1000).selectExpr("id AS user_id", "id * 2 AS n", "'old' AS v")
    stored = catalog.write_bucketed(existing, f"{database}.profiles", "user_id", 4)
    writes = spark.createDataFrame([(5, 1, "x", 1), (5, 2, "y", 2), (2000, 3, "z", 1), (7, None, None, 1), (None, 4, "q", 1)],
                                   "user_id long, n long, v string, load_seq int")
    new = catalog.upsert_bucketed(stored, writes, "user_id", 4)
    assert inspect.shuffle_exchanges(new) == 2          # both of the writes, none of the store
    assert "Bucketed: true" in inspect.plan_text(new)
    got = {r.user_id: (r.n, r.v) for r in new.collect()}
    assert len(got) == 1001 and got[5] == (2, "y") and got[2000] == (3, "z") and got[7] == (None, None) and got[6] == (12, "old")


def test_link_updates_leave_the_store_where_it_is(spark, database, no_broadcast):
    rows = spark.range(500).selectExpr("cast(id AS string) AS id", "id AS user_id", "cast(null AS string) AS external_id",
                                       "'' AS external_url")
    stored = catalog.write_bucketed(rows, f"{database}.playlists", "id", 4)
    updates = spark.createDataFrame([("3", "e1", "u1", 1), ("3", "e2", "u2", 2), ("none", "e", "u", 1)],
                                    "playlist_id string, external_id string, external_url string, update_seq int")
    new = catalog.update_links_bucketed(stored, updates, 4)
    assert inspect.shuffle_exchanges(new) == 2 and "Bucketed: true" in inspect.plan_text(new)
    assert inspect.shuffle_exchanges(store.apply_link_updates(rows, updates)) == 2      # one of the store
    got = {r.id: (r.external_id, r.external_url) for r in new.collect()}
    assert len(got) == 500 and got["3"] == ("e2", "u2") and got["4"] == (None, "")


def rows_read(df):
    """Rows that the scan gave, by its own counter."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_lookup_skips_row_groups(spark):
    rows = spark.range(40000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").alias("n"),
                                     F.repeat(F.lit("x"), 50).alias("pad")).repartition(8, "n")
    root = f"{checkpoint_dir(spark)}/lookup-{dt.datetime.now().timestamp()}"
    catalog.write_for_lookup(rows, f"{root}/bloom", "id", 5000)
    rows.write.parquet(f"{root}/plain")
    wanted = rows.where("n = 777").first().id
    for name, most in (("bloom", 10000), ("plain", 40000)):
        read = rows_read(spark.read.parquet(f"{root}/{name}").where(F.col("id") == wanted))
        assert (read <= most) and (name == "bloom" or read == 40000)
    found = catalog.point_lookup(spark.read.parquet(f"{root}/bloom"), "id", [wanted, "missing", wanted]).collect()
    assert sorted((r.asked, r.n) for r in found) == sorted([(wanted, 777), ("missing", None)])
    assert catalog.point_lookup(spark.read.parquet(f"{root}/bloom"), "id", []).count() == 0
