"""S11 as an incremental read: a cursor for each user, kept as a table.

A poll gives a user's plays after the cursor, newest first, in two pages of 50
at most; the second page is only read if the first is full.  The newest play
taken becomes the cursor.  Cursors are stored by poll: a poll that runs again
starts from the cursors before it and writes the same rows, and the next poll
reads nothing that an earlier one has taken.  Plays beyond the two pages are
counted as passed over, as the remote list shows no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.columns import RECENT_PLAYS
from cadenza.operators import profile_state as PS
from cadenza.session import written

PAGE = 50
CURSOR = T.StructType().add("user_id", T.LongType()).add("last_at", T.TimestampType()).add("last_event", T.LongType())


def read_pages(plays: DataFrame, cursors: DataFrame) -> DataFrame:
    """Of ``plays(user_id, track_id, played_at, event_id)`` those after the
    user's cursor, at most two pages: with ``page`` (1, 2) and ``position``.

    What is after the cursor is the newest there is, so the newest 100 are taken
    first, a map-side cut that makes of a user with a third of the plays 100 rows
    a task, and only those meet the cursors.  Plays with a NULL time have no place in the order and are left
    out; equal times go by event id."""
    c = cursors.withColumnRenamed("user_id", "_user")
    after = F.col("last_at").isNull() | (F.col("played_at") > F.col("last_at")) | (
        (F.col("played_at") == F.col("last_at")) & (F.col("event_id") > F.col("last_event")))
    w = Window.partitionBy("user_id").orderBy(F.desc("played_at"), F.desc("event_id"))
    newest = plays.where(F.col("played_at").isNotNull()).withColumn("position", F.row_number().over(w)) \
        .where(F.col("position") <= RECENT_PLAYS)
    new = newest.join(c, F.col("user_id") == F.col("_user"), "left").where(after).select(*plays.columns, "position")
    return new.withColumn("page", F.floor((F.col("position") - 1) / PAGE).cast("int") + 1)


def poll(plays: DataFrame, path: str, number: int) -> DataFrame:
    """Poll ``number`` (from 0): the pages of every user's new plays; the cursors
    that they leave are stored below ``path``.  ``plays`` may be all plays or
    only those that came in since."""
    spark: SparkSession = plays.sparkSession
    cursors = PS.stored(spark, path, CURSOR, before=number)
    pages = written(read_pages(plays, cursors), "pages")
    newest = pages.where(F.col("position") == 1).select(
        "user_id", F.col("played_at").alias("last_at"), F.col("event_id").alias("last_event"))
    PS.write_version(newest, path, number)
    return pages
