"""Positions inside groups that may be arbitrarily large.

``row_number() over (partition by key order by ...)`` sends a whole group
to one task.  That is fine for groups bounded by the application (<= 60
hits per request, <= 150 ranked items per user, <= 100 tracks per
playlist), but not for a user's full history or a long track list, where
one key may hold a third of all rows.

``positions`` numbers such groups without putting a group in one task:

1. a range-partitioned sort on (key, order) -- Spark samples the sort key,
   so a hot key's rows are spread over several partitions by their order
   columns;
2. within each partition, the row index comes from the sorted iterator
   (``monotonically_increasing_id`` is consecutive inside a partition);
3. a small aggregate of (key, partition) -> (count, first index) gives,
   by a running sum over the partitions of each key, the number of rows of
   that key in earlier partitions; that table has at most
   ``#keys + #partitions`` rows;
4. position = rows in earlier partitions + index within this partition.

The order columns must make the order total (end with a unique column);
then positions do not depend on partitioning.

Both the row tags and the (key, partition) table must come from the *same*
range exchange: Spark seeds the range sample with the shuffle id, so two
separately planned exchanges may cut the data at different bounds.  The
tagged rows are therefore written once to the shared folder and both branches
read the files; no executor's memory or disk holds anything they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import written


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "position",
              num_partitions: int | None = None) -> DataFrame:
    sort_cols = [F.col(k) for k in keys] + order
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
    tagged = written(ranged.withColumn("_pid", F.spark_partition_id())
                     .withColumn("_idx", F.monotonically_increasing_id()), "positions")
    stats = tagged.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_idx").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    j = tagged.join(stats.select(*keys, "_pid", "_before", "_first"), [*keys, "_pid"])
    pos = (F.col("_before") + F.col("_idx") - F.col("_first") + 1).cast("long")
    return j.withColumn(name, pos).drop("_pid", "_idx", "_before", "_first")
