"""X2 as an increment: what a profile is made of, kept per user so that two
states merge into the state of both inputs.

- ``tops``: the first 50 events of each of the three ranges (value descending,
  event id), at most 150 a user.  The first 50 of two lists are among the first
  50 of each, so merging cut lists is exact.  An event delivered twice has one
  id and stays one.
- ``sums``: an exact decimal sum and a count for each audio feature.

A delivery is turned into a state of its own rows, merged with the stored state
of the users in it, and written as a new version of those users' rows; nothing
else is read.  Versions lie in buckets of users, so a delivery that touches few
users opens few folders.  A batch that runs again writes the same version from
the versions before it, so nothing counts twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.columns import FEATURE_DEFAULTS, TIME_RANGES, TOP_ITEMS_PER_RANGE, round3
from cadenza.operators.profile import FEATURES

TOP = T.StructType().add("term_ord", T.IntegerType()).add("value", T.DoubleType()).add(
    "event_id", T.LongType()).add("item_key", T.LongType())
TOPS = T.StructType().add("user_id", T.LongType()).add("tops", T.ArrayType(TOP))
SUMS = T.StructType([T.StructField("user_id", T.LongType()), *[
    T.StructField(f"{name}_{c}", T.DecimalType(28, 4) if name == "sum" else T.LongType())
    for c in FEATURES for name in ("sum", "n")]])

#: Folders of users, chosen once for a store.
BUCKETS = 16


def _first_of_each_range(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id", "term_ord").orderBy(F.desc("value"), "event_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_ITEMS_PER_RANGE)


def tops_of(events: DataFrame) -> DataFrame:
    """The state of events (user_id, term_ord, value, event_id, item_key); at
    most 50 rows of a range leave a map task."""
    kept = _first_of_each_range(events.dropDuplicates(["user_id", "term_ord", "event_id"]))
    return kept.groupBy("user_id").agg(F.collect_list(F.struct(*TOP.names)).cast(TOPS["tops"].dataType).alias("tops"))


def merge_tops(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.unionByName(b).select("user_id", F.inline("tops"))
    return tops_of(rows)


def sums_of(features: DataFrame) -> DataFrame:
    """The state of feature rows (user_id and a column for each feature)."""
    return features.groupBy("user_id").agg(*[e for c in FEATURES for e in (
        F.sum(F.col(c).cast("decimal(18,4)")).cast("decimal(28,4)").alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))])


def merge_sums(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("user_id").agg(
        *[F.sum(f.name).cast(f.dataType).alias(f.name) for f in SUMS if f.name != "user_id"])


def ranked_lists(tops: DataFrame) -> DataFrame:
    """A state's lists as the ranked rows that a profile is built from."""
    rows = _first_of_each_range(tops.select("user_id", F.inline("tops")))
    names = F.array(*map(F.lit, TIME_RANGES))
    return rows.select("user_id", "term_ord", F.element_at(names, F.col("term_ord")).alias("time_range"), "rank", "item_key")


def means_of(sums: DataFrame, users: DataFrame) -> DataFrame:
    """A2 from the sums: one division a feature, defaults where there is nothing."""
    j = users.join(sums, "user_id", "left")
    return j.select("user_id", *[F.coalesce(round3(F.try_divide(F.col(f"sum_{c}").cast("double"), F.col(f"n_{c}"))),
                                            F.lit(float(v))).alias(c) for c, v in FEATURE_DEFAULTS.items()])


# --- versions -------------------------------------------------------------------

def _bucket(buckets: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def write_version(state: DataFrame, path: str, version: int, buckets: int = BUCKETS) -> None:
    """Store the users' rows as ``version``, a file for each bucket; one that is
    there is replaced."""
    state.withColumns({"bucket": _bucket(buckets), "version": F.lit(version)}).repartition("bucket").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)


def stored(spark: SparkSession, path: str, schema: T.StructType, users: DataFrame | None = None,
           before: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The newest row of each user, of the versions before ``before``.  With
    ``users`` theirs only: their buckets' folders are the ones that are read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType())])
    rows = spark.read.schema(full).parquet(path)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    if users is not None:
        touched = [r[0] for r in users.select(_bucket(buckets)).distinct().collect()]      # at most ``buckets``
        rows = rows.where(F.col("bucket").isin(touched)).join(users, "user_id", "left_semi")
    values = [n for n in schema.names if n != "user_id"]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*values), "version").alias("_s")).select("user_id", "_s.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def advance(batch_state: DataFrame, path: str, schema: T.StructType, merge, version: int,
            buckets: int = BUCKETS) -> DataFrame:
    """Merge a delivery's state into the stored one; returns its users."""
    spark = batch_state.sparkSession
    users = batch_state.select("user_id")
    old = stored(spark, path, schema, users, version, buckets)
    write_version(merge(old, batch_state.select(*schema.names)), path, version, buckets)
    return users


def state_path(root: str, name: str) -> str:
    return os.path.join(root, "state", name)
