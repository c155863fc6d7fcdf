"""X4 in batch: listening sessions without putting one user in one task.

``session_window`` (and any window partitioned by user) sends all of a
user's events to one task.  Here the log is range-partitioned on
(user, ts, event_id), so a user holding a third of the log is spread over
many partitions, and sessions are stitched across partition boundaries
with tables that have one row per partition:

1. range-partition and sort; tag rows with partition id and a
   within-partition index; write them to the shared folder, so every
   branch reads the same cut;
2. per partition, its last row; each partition learns the last row of
   the nearest non-empty partition before it (one-row-per-partition
   table, broadcast: its size is the partition count);
3. within a partition (one window group per partition, so bounded by the
   partition size): the previous event is ``lag`` or, for the first row,
   the previous partition's last row; a row starts a session when the
   user changes or the gap is at least 30 minutes; a running count of
   starts numbers the sessions locally;
4. a per-partition count of starts gives each partition's offset, so
   ``offset + local count`` is a global session number;
5. sessions are a partial aggregate on that number.

Same rule as Structured Streaming's session window with a 30-minute gap:
a session ends 30 minutes after its last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import written

GAP = "INTERVAL 30 MINUTES"


def ranged(events: DataFrame, n: int) -> DataFrame:
    """Step 1: the log cut by (user, time) ranges and sorted, rows tagged."""
    order = [F.col("user_id"), F.col("ts"), F.col("event_id")]
    return (events.select("user_id", "ts", "event_id")
            .repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()))


def sessions(events: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """``events(user_id, ts, event_id)`` -> ``(user_id, session_start,
    session_end, n_events)``."""
    spark = events.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = written(ranged(events, n), "sessions")

    # 2. last row of the nearest earlier non-empty partition
    lasts = tagged.groupBy("_pid").agg(F.max_by(F.struct("user_id", "ts"), F.col("_mid")).alias("_last"))
    over_parts = Window.orderBy("_pid")   # one row per partition
    edge = lasts.select("_pid", F.lag("_last").over(over_parts).alias("_edge"))

    # 3. previous event and session starts inside each partition
    w = Window.partitionBy("_pid").orderBy("_mid")
    j = tagged.join(F.broadcast(edge), "_pid", "left")
    first_in_part = F.lag("_mid").over(w).isNull()
    prev_user = F.when(first_in_part, F.col("_edge.user_id")).otherwise(F.lag("user_id").over(w))
    prev_ts = F.when(first_in_part, F.col("_edge.ts")).otherwise(F.lag("ts").over(w))
    flagged = j.withColumn("_start", (prev_user.isNull() | (prev_user != F.col("user_id"))
                                      | (F.col("ts") >= prev_ts + F.expr(GAP))).cast("int"))
    local = flagged.withColumn("_local", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    # 4. offsets: starts in earlier partitions
    per_part = flagged.groupBy("_pid").agg(F.sum("_start").alias("_n"))
    offsets = per_part.select("_pid", F.coalesce(F.sum("_n").over(
        over_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    keyed = local.join(F.broadcast(offsets), "_pid").withColumn("_session", F.col("_off") + F.col("_local"))

    # 5. one row per session
    return keyed.groupBy("_session").agg(
        F.first("user_id").alias("user_id"), F.min("ts").alias("session_start"),
        (F.max("ts") + F.expr(GAP)).alias("session_end"), F.count(F.lit(1)).alias("n_events")) \
        .drop("_session")
