"""The store as catalog tables (S1, S2), bucketed tables (S3, S7) and tables
for point lookups (S4, S9).

Every table has its files in a folder below the shared one, so that the catalog
holds names and columns only.  Parquet tables take no MERGE: a changed table is
written anew under a new name.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.store import apply_link_updates
from cadenza.session import checkpoint_dir


def new_database(spark: SparkSession, name: str = "store") -> str:
    """A database of its own in the shared folder; returns its name."""
    database = f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{os.path.join(checkpoint_dir(spark), database)}'")
    return database


def _ddl(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


# -- S1 / S2: create and evolve -------------------------------------------------

def create_table(spark: SparkSession, table: str, schema: T.StructType, partition: str | None = None) -> None:
    """The table, if the catalog has none of that name; else nothing changes."""
    by = f" PARTITIONED BY (`{partition}`)" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({_ddl(schema)}) USING parquet{by}")


def add_columns(spark: SparkSession, table: str, schema: T.StructType) -> list[str]:
    """Add the columns of ``schema`` that the table lacks; returns their
    names.  Rows written before read as NULL in them; no file is touched."""
    have = {f.name.lower() for f in spark.table(table).schema}
    new = [f for f in schema if f.name.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({_ddl(new)})")
    return [f.name for f in new]


def insert(rows: DataFrame, table: str) -> None:
    """Append rows by column name; columns that they lack are NULL."""
    schema = rows.sparkSession.table(table).schema
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                  for f in schema]).write.insertInto(table)


# -- S3 / S7: bucketed tables ---------------------------------------------------

def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """A table dealt into ``buckets`` by the hash of ``key`` and sorted by it in
    each: a join or an aggregate on the key reads it without an exchange.  One
    repartition by the same hash leaves one file a bucket.  The number of buckets
    stays with the table; it is the store's size over what a task can sort."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def upsert_bucketed(existing: DataFrame, writes: DataFrame, key: str, buckets: int,
                    seq: str = "load_seq") -> DataFrame:
    """S3 on a bucketed table: the last write of each key wins over the stored
    row.  Writes are reduced to one row a key first (map-side) and dealt to the
    store's buckets; the store is not shuffled.  Of writes of equal ``seq`` the
    largest row wins.  A NULL key is no key: such writes are left out, such rows
    stay."""
    values = [c for c in existing.columns if c != key]
    last = writes.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.struct(F.col(seq), *values)).alias("_w")).repartition(buckets, key)
    j = existing.join(last.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "full_outer")
    return j.select(F.coalesce(key, "_key").alias(key), *[
        F.when(F.col("_w").isNotNull(), F.col(f"_w.{c}")).otherwise(F.col(c)).alias(c) for c in values])


def update_links_bucketed(playlists: DataFrame, updates: DataFrame, buckets: int) -> DataFrame:
    """S7 on a table bucketed by id: the last link of each id, dealt to the
    store's buckets; ids that the store lacks are ignored."""
    last = updates.groupBy("playlist_id").agg(
        F.max(F.struct("update_seq", "external_id", "external_url")).alias("_u")).repartition(buckets, "playlist_id")
    return apply_link_updates(playlists, last.select("playlist_id", "_u.external_id", "_u.external_url"), reduced=True)


# -- S4 / S9: point lookups -----------------------------------------------------

def write_for_lookup(rows: DataFrame, path: str, key: str, distinct: int, group_bytes: int = 128 << 20) -> None:
    """A table with a Bloom filter on ``key`` in every row group, sorted by it
    within each file: a lookup reads the footers, and the groups whose filter
    has the key.  ``distinct``: keys to expect in a group."""
    rows.sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true") \
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct)) \
        .option("parquet.block.size", str(group_bytes)).parquet(path)


def point_lookup(table: DataFrame, key: str, ids: list) -> DataFrame:
    """A row for each of a few ids, NULLs if there is none ("none").
    The ids are a filter on the scan, an equality each, which the filters of the
    row groups answer."""
    wanted = None
    for i in ids:
        one = F.col(key) == F.lit(i)
        wanted = one if wanted is None else wanted | one
    found = table.where(wanted if wanted is not None else F.lit(False))
    asked = table.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)],
                                               T.StructType([T.StructField("asked", table.schema[key].dataType)]))
    return asked.join(found, F.col("asked") == F.col(key), "left")
