"""Playlist and profile store jobs.

Parquet tables have no UPDATE/DELETE/MERGE (T5), so every change is a
DataFrame computing the *new* table from the old one plus a change set;
``write_snapshot`` writes it into a fresh folder under the shared
checkpoint directory and returns the path, and readers move to the new
path.  A path being read is never overwritten, and a failed job leaves
the previous snapshot untouched.

Change sets (updates, deletions, profile writes) can be as large as the
table, so they are joined, never broadcast by hand; Spark broadcasts them
only when their measured size is under the broadcast threshold.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.columns import BATCH_SIZE
from cadenza.operators.ordering import positions
from cadenza.schemas import PLAYLISTS, USER_PROFILE
from cadenza.session import checkpoint_dir


# -- S1 ----------------------------------------------------------------------

def ensure_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Create the two tables if absent (idempotent): an empty parquet
    snapshot with the fixed schema is written once per table."""
    paths = {}
    for name, schema in (("user_profile", USER_PROFILE), ("playlists", PLAYLISTS)):
        path = os.path.join(root, name, "v0")
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        paths[name] = path
    return paths


def write_snapshot(df: DataFrame, table: str, root: str | None = None) -> str:
    """Write a new immutable snapshot folder and return its path."""
    base = root or checkpoint_dir(df.sparkSession)
    path = os.path.join(base, table, f"v-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return path


# -- S2 ----------------------------------------------------------------------

def evolve_tracks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows written before ``tracks`` existed read as an empty list."""
    both = old.unionByName(new, allowMissingColumns=True)
    empty = F.array().cast(new.schema["tracks"].dataType)
    return both.withColumn("tracks", F.coalesce(F.col("tracks"), empty))


# -- S3 ----------------------------------------------------------------------

def upsert_latest(existing: DataFrame, writes: DataFrame, key: str, seq: str = "load_seq") -> DataFrame:
    """S3: last write wins per key, by write order (``seq``), not by any
    timestamp in the row.  ``existing`` rows have the lowest order.

    Implemented as a partial aggregate (``max_by``), so a key written many
    times costs one row per map task instead of one task for the key.
    """
    lowest = F.lit(-1).cast(writes.schema[seq].dataType) if seq in writes.columns else F.lit(-1)
    old = existing.withColumn(seq, lowest) if seq not in existing.columns else existing
    both = old.unionByName(writes)
    value_cols = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*value_cols), F.col(seq)).alias("_row"))
    return latest.select(key, "_row.*")


def latest(versions: DataFrame, key: str, seq: str = "load_seq") -> DataFrame:
    """The last version of each key's row, by ``seq`` (as in S3)."""
    values = [c for c in versions.columns if c not in (key, seq)]
    return versions.groupBy(key).agg(F.max_by(F.struct(*values), F.col(seq)).alias("_row"), F.max(seq).alias(seq)) \
        .select(key, "_row.*", seq)


# -- S5 ----------------------------------------------------------------------

def new_playlist_rows(built: DataFrame, created_at=None) -> DataFrame:
    """Stored rows for new playlists.  The id is a name-based UUID of
    the request id, so re-running a batch writes the same ids (idempotent
    append); ``created_at`` is the rows' own, or the batch time if they have none."""
    h = F.sha2(F.concat(F.lit("playlist:"), F.col("request_id").cast("string")), 256)
    pid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                      F.substring(h, 17, 4), F.substring(h, 21, 12))
    ts = created_at if created_at is not None else \
        F.col("created_at") if "created_at" in built.columns else F.current_timestamp()
    return built.withColumn("id", pid).withColumn("created_at", ts)


def append_batches(rows: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Append batches of rows to the table at ``path``, a partition folder
    for each value of ``batch``.  A batch that is there already is replaced
    (dynamic partition overwrite), so a batch delivered or retried again is
    stored once and all other batches stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def read_appended(spark: SparkSession, path: str, schema: T.StructType, batch: str = "batch_id") -> DataFrame:
    """The table that ``append_batches`` wrote; a filter on ``batch`` reads the
    folders of its values only.  Columns that older batches lack are NULL."""
    fields = [f for f in schema.fields if f.name != batch]
    return spark.read.schema(T.StructType([*fields, schema[batch]])).parquet(path)


# -- S6 / K2 -----------------------------------------------------------------

def history(playlists: DataFrame) -> DataFrame:
    """S6 + K2: each user's playlists, newest first (ties by id), with a
    1-based position.  A user's history is unbounded, so positions come
    from the range-sorted numbering, not from a per-user window."""
    return positions(playlists, ["user_id"], [F.desc("created_at"), F.col("id")])


# -- S7 ----------------------------------------------------------------------

def apply_link_updates(playlists: DataFrame, updates: DataFrame, seq: str = "update_seq",
                       reduced: bool = False) -> DataFrame:
    """Set external id and URL of the playlists named in ``updates``;
    ids not in the table are ignored.  Several updates of one id: the last
    (highest ``seq``) wins.  ``reduced``: there is one update of an id at most."""
    link = F.struct("external_id", "external_url")
    last = updates.select("playlist_id", link.alias("_u")) if reduced else updates.groupBy("playlist_id").agg(
        F.max_by(link, F.col(seq)).alias("_u"))
    j = playlists.join(last, playlists["id"] == last["playlist_id"], "left")
    hit = F.col("playlist_id").isNotNull()
    return j.select(
        *[c for c in playlists.columns if c not in ("external_id", "external_url")],
        F.when(hit, F.col("_u.external_id")).otherwise(F.col("external_id")).alias("external_id"),
        F.when(hit, F.col("_u.external_url")).otherwise(F.col("external_url")).alias("external_url"))


# -- S8 / J3 / G6 ------------------------------------------------------------

def delete_playlists(playlists: DataFrame, deletions: DataFrame) -> DataFrame:
    """S8 + J3: the table without the listed ids (anti join)."""
    ids = deletions.select(F.col("playlist_id").alias("id"))
    return playlists.join(ids, "id", "left_anti")


def deletion_counts(playlists: DataFrame, deletions: DataFrame) -> DataFrame:
    """Per requester, ``requested`` = length of the id list with
    repeats and unknown ids (the value the application reports) and
    ``deleted`` = distinct ids that existed (what really goes)."""
    existing = playlists.select(F.col("id").alias("playlist_id"))
    found = deletions.select("requester_id", "playlist_id").distinct() \
        .join(existing, "playlist_id", "left_semi")
    requested = deletions.groupBy("requester_id").agg(F.count(F.lit(1)).alias("requested"))
    deleted = found.groupBy("requester_id").agg(F.count(F.lit(1)).alias("deleted"))
    return requested.join(deleted, "requester_id", "left") \
        .select("requester_id", "requested", F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted"))


# -- S9 / J2 -----------------------------------------------------------------

def lookup(playlists: DataFrame, ids: DataFrame) -> DataFrame:
    """S9 in batch: ``ids(playlist_id)`` left-joined to the table; an
    unknown id yields a row of NULLs (the application's "none").  Rows that
    name no playlist take no part in the join, so that however many they are,
    they are not hashed to one partition."""
    named = ids.where(F.col("playlist_id").isNotNull())
    found = named.join(playlists, named["playlist_id"] == playlists["id"], "left").drop("id")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in playlists.schema if f.name != "id"]
    return found.unionByName(ids.where(F.col("playlist_id").isNull()).select("*", *rest))


# -- S14 ---------------------------------------------------------------------

def track_batches(tracks: DataFrame, key: str, order: list, uri: str = "uri") -> DataFrame:
    """Cut each key's ordered track list into batches of 100 (the
    last one shorter).  Positions come from the skew-safe numbering, then
    each batch (<= 100 rows) is collected in order."""
    numbered = positions(tracks, [key], order, name="pos")
    b = numbered.withColumn("batch_no", F.floor((F.col("pos") - 1) / BATCH_SIZE).cast("long"))
    packed = b.groupBy(key, "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(uri).alias("uri")))).alias("_b"))
    return packed.select(key, "batch_no", F.size("_b").alias("batch_size"),
                         F.col("_b")[0]["pos"].alias("first_pos"),
                         F.element_at("_b", -1)["pos"].alias("last_pos"),
                         F.transform("_b", lambda s: s["uri"]).alias("uris"))

