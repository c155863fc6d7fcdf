"""G3 playlist build and the report columns.

G3 joins the per-request tables built from the model replies (criteria,
queries, titles) to the search hits and runs G1 on them.  Every join is
keyed by ``request_id``; after the hit cap each request holds at most 60
rows, so the plan clusters once on ``request_id`` and reuses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import duration_text, is_saved, join_artists, long_date_of, strip_ws, track_link
from cadenza.operators import candidates as G1
from cadenza.operators.profile import collect_ordered
from cadenza.operators.store import history, lookup
from cadenza.schemas import CRITERIA, PLAYLISTS


def build_playlists(hits: DataFrame, crit_table: DataFrame, query_rows: DataFrame,
                    title_rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per request: status (``ok`` / ``no_tracks`` /
    ``failed``), title, description, ordered tracks and their count.
    Hits count only for queries the request really ran (L5)."""
    ran = query_rows.select("request_id", "query_idx")
    capped = G1.usable_hits(G1.cap_hits(hits)).join(ran, ["request_id", "query_idx"], "left_semi")
    ok_crit = crit_table.where(F.col("status") == "ok")
    kept = G1.filter_years(G1.by_request(capped), ok_crit)
    selected = G1.project_tracks(G1.top_n(G1.dedupe_hits(kept)), catalogue)
    lists = collect_ordered(selected, "request_id", ["position"],
                            F.struct("id", "uri", "name", "artists", "album", "release_date", "duration_ms",
                                     "popularity", "preview_url", "external_url", "image_url")) \
        .withColumnRenamed("items", "tracks")
    out = crit_table.select("request_id", F.col("status").alias("criteria_status"), "error") \
        .join(lists, "request_id", "left").join(title_rows, "request_id", "left")
    tracks = F.coalesce("tracks", F.array().cast(lists.schema["tracks"].dataType))
    status = (F.when(F.col("criteria_status") != "ok", F.lit("failed"))
              .when(F.size(tracks) == 0, F.lit("no_tracks"))
              .otherwise(F.lit("ok")))
    return out.select("request_id", status.alias("status"), "error", "title", "description",
                      tracks.alias("tracks"), F.size(tracks).alias("track_count"))


def playlist_records(built: DataFrame, crit_table: DataFrame, requests: DataFrame, times: DataFrame) -> DataFrame:
    """The record to store for each built playlist: user, trimmed prompt,
    criteria, title, tracks and their count; no external id yet.  ``times``
    (request_id, requested_at) dates it, so that a batch built again gives the
    same record.  Rows stay keyed by ``request_id``."""
    crit = crit_table.select("request_id", F.struct(*CRITERIA.names).alias("llm_params"))
    asked = requests.select("request_id", "user_id", strip_ws(F.col("prompt")).alias("user_prompt"))
    j = built.where(F.col("status") == "ok").join(crit, "request_id").join(asked, "request_id").join(times, "request_id")
    none = F.lit(None).cast("string")
    named = j.withColumns({"created_at": F.col("requested_at"), "external_id": none, "external_url": none})
    return named.select("request_id", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PLAYLISTS
                                        if f.name != "id"])


def relaunch_report(playlists: DataFrame, requests: DataFrame) -> DataFrame:
    """G5 for a relaunch: the tracks of the stored playlist that a request names
    (J2), reported like freshly selected ones.  A request that names none, an
    unknown one or one stored without tracks has no rows."""
    found = lookup(playlists.select("id", "tracks"), requests)
    rows = found.select("request_id", F.posexplode("tracks").alias("pos", "t"))
    return track_report(rows.select("request_id", (F.col("pos") + 1).alias("position"), "t.*"))


def history_report(playlists: DataFrame) -> DataFrame:
    """Per user, newest first: position, long date (English as the
    server printed it, French as the browser did; a text that is no date as it
    is), prompt, title, track count, saved flag (P11) and the id to relaunch."""
    h = history(playlists)
    return h.select("user_id", "position", long_date_of(F.col("created_text")).alias("date_text"),
                    long_date_of(F.col("created_text"), french=True).alias("date_fr"),
                    "user_prompt", "title", "track_count",
                    is_saved(F.col("external_url")).alias("saved"), F.col("id").alias("relaunch_id"))


def saved_split(playlists: DataFrame) -> DataFrame:
    """Saved and unsaved playlists per user."""
    s = is_saved(F.col("external_url"))
    return playlists.groupBy("user_id").agg(
        F.count(F.when(s, 1)).alias("saved"), F.count(F.when(~s, 1)).alias("unsaved"))


#: The fields of a track that ``track_report`` reads.
REPORTED = ("id", "name", "artists", "duration_ms", "external_url", "image_url")


def track_report(selected: DataFrame) -> DataFrame:
    """Position, name, artists joined with " · ", m:ss duration, link
    (external URL or one built from the id), cover image."""
    return selected.select("request_id", "position", "name",
                           join_artists(F.col("artists"), " · ").alias("artists"),
                           duration_text(F.col("duration_ms")).alias("duration"),
                           track_link(F.col("external_url"), F.col("id")).alias("link"),
                           "image_url")
