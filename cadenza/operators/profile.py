"""G2 profile build: W1 W2 W3 A1 K3 A2 A4.

Skew: a user may own a large share of the event log.  Every per-user step
first cuts the user's rows to a bounded list -- 50 per time range (S10),
100 recent plays (S11) -- with a ``row_number() <= k`` filter, which Spark
plans as a partial WindowGroupLimit before the shuffle.  Everything after
that works on at most 150 items per user.  Feature means are partial
aggregates (map-side combine), so a hot user costs one small row per map
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import (FEATURE_DEFAULTS, RECENT_PLAYS, TOP_ITEMS_PER_RANGE,
                                       artist_names, round3)

FEATURES = list(FEATURE_DEFAULTS)


def read_ranked(raw: DataFrame, items: DataFrame) -> DataFrame:
    """S10 + U1: the first 50 items of each (user, range) list with their
    payload.  ``raw`` holds ``(user_id, term_ord, time_range, rank, item_key)``."""
    capped = raw.where(F.col("rank") <= TOP_ITEMS_PER_RANGE)
    return capped.join(items, "item_key").drop("item_key")


def first_occurrence(ranked: DataFrame) -> DataFrame:
    """One row per (user, item id); the earliest range wins and
    sets ``time_range``, then the best rank within it."""
    w = Window.partitionBy("user_id", "id").orderBy("term_ord", "rank")
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_tracks(raw: DataFrame, tracks: DataFrame) -> DataFrame:
    """De-duplicated top tracks; artists as a list of names."""
    out = first_occurrence(read_ranked(raw, tracks))
    return out.withColumn("artists", artist_names(F.col("artists")))


def top_artists(raw: DataFrame, artists: DataFrame) -> DataFrame:
    """De-duplicated top artists, keeping their genres."""
    return first_occurrence(read_ranked(raw, artists))


def recent_plays(plays: DataFrame) -> DataFrame:
    """W3 + S11 + U2: of the user's newest 100 plays, the newest play of
    each track."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("played_at"), F.desc("event_id"))
    pages = plays.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= RECENT_PLAYS)
    per_track = Window.partitionBy("user_id", "track_id").orderBy(F.desc("played_at"), F.desc("event_id"))
    return pages.withColumn("_n", F.row_number().over(per_track)).where("_n = 1").drop("_n", "_r")


def genre_ranking(artists: DataFrame) -> DataFrame:
    """A1 + K3: genre frequency over the de-duplicated artists (a genre
    repeated inside one artist counts each time), ordered by count
    descending, ties by first appearance in (range, rank, position)."""
    exploded = artists.select("user_id", "term_ord", "rank",
                              F.posexplode("genres").alias("pos", "genre"))
    counts = exploded.groupBy("user_id", "genre").agg(
        F.count(F.lit(1)).alias("n_artists"),
        F.min(F.struct("term_ord", "rank", "pos")).alias("_first"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n_artists"), "_first")
    return counts.withColumn("genre_rank", F.row_number().over(w)).drop("_first")


def _mean3(c: str):
    """Mean of the non-null values of one feature, rounded as in T1."""
    total = F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    return round3(F.try_divide(total, F.count(c)))


def feature_means(features: DataFrame, users: DataFrame) -> DataFrame:
    """A2: per-feature mean over the values present (each feature has its
    own count), three decimals; no values -> 0.5 (tempo 120).  Users with
    no feature rows at all get the defaults through the left join."""
    agg = features.groupBy("user_id").agg(*[_mean3(c).alias(c) for c in FEATURES])
    j = users.join(agg, "user_id", "left")
    return j.select("user_id", *[F.coalesce(F.col(c), F.lit(float(v))).alias(c)
                                 for c, v in FEATURE_DEFAULTS.items()])


def collect_ordered(df: DataFrame, key: str, order_cols: list[str], value) -> DataFrame:
    """A4: one ordered list per key.  Only used on bounded groups (at most
    150 ranked items per user, at most 100 tracks per playlist)."""
    packed = F.struct(*[F.col(c) for c in order_cols], value.alias("v"))
    lst = F.array_sort(F.collect_list(packed))
    return df.groupBy(key).agg(F.transform(lst, lambda s: s["v"]).alias("items"))


def build_profiles(raw: DataFrame, tracks: DataFrame, artists: DataFrame,
                   features: DataFrame, users: DataFrame, synced_at) -> DataFrame:
    """One profile row per user."""
    return assemble_profiles(raw, tracks, artists, feature_means(features, users), synced_at)


def assemble_profiles(raw: DataFrame, tracks: DataFrame, artists: DataFrame, means: DataFrame, synced_at) -> DataFrame:
    """G2 from ranked lists and feature means (one row for each user)."""
    t = top_tracks(raw, tracks)
    a = top_artists(raw, artists)
    g = genre_ranking(a)
    track_lists = collect_ordered(
        t, "user_id", ["term_ord", "rank"],
        F.struct("id", "name", "artists", "uri", "time_range")).withColumnRenamed("items", "top_tracks")
    artist_lists = collect_ordered(
        a, "user_id", ["term_ord", "rank"],
        F.struct("id", "name", "genres", "uri", "time_range")).withColumnRenamed("items", "top_artists")
    genre_lists = collect_ordered(g, "user_id", ["genre_rank"], F.col("genre")) \
        .withColumnRenamed("items", "top_genres")
    empty = lambda t: F.array().cast(t)
    prof = (means.join(genre_lists, "user_id", "left")
            .join(artist_lists, "user_id", "left")
            .join(track_lists, "user_id", "left"))
    return prof.select(
        "user_id", synced_at.alias("synced_at"),
        F.coalesce("top_genres", empty("array<string>")).alias("top_genres"),
        F.coalesce("top_artists", empty(artist_lists.schema["top_artists"].dataType)).alias("top_artists"),
        F.coalesce("top_tracks", empty(track_lists.schema["top_tracks"].dataType)).alias("top_tracks"),
        F.struct(*FEATURES).alias("audio_features_avg"),
    )


def profile_summary(profiles: DataFrame) -> DataFrame:
    """P10: first 10 genres, artist and track counts, the averages."""
    return profiles.select(
        "user_id",
        F.slice("top_genres", 1, 10).alias("genres"),
        F.size("top_artists").alias("artists_count"),
        F.size("top_tracks").alias("tracks_count"),
        "audio_features_avg")
