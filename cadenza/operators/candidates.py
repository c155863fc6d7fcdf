"""G1 candidate selection and its parts.

Per request: keep the first 10 hits of each of at most 6 queries, drop
failed queries and null items, drop hits outside the year range, keep the
first copy of each track in (query, hit) order, rank by popularity
(descending, stable in query/hit order) and cut to the request's limit.

Plan shape (checked in tests/test_plans.py):
  1. the hit-rank cap is a ``row_number() <= 10`` filter, planned as a
     partial WindowGroupLimit *before* the first exchange, so a hot
     (request, query) group is cut map-side;
  2. one exchange on ``request_id`` after the cap; the criteria join (when
     not broadcast) and the dedupe and top-N windows reuse that
     partitioning, since their keys start with ``request_id``;
  3. the catalogue lookup joins only the selected rows (<= limit per
     request).  Its strategy is left to Spark: broadcast while the
     measured catalogue side is under the broadcast threshold, a
     sort-merge join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import (HITS_PER_QUERY, MAX_QUERIES, artist_names,
                                       first_image_url, year_in_range, year_of)


def cap_hits(hits: DataFrame) -> DataFrame:
    """10 hits per query, 6 queries per request; applied before any
    other filter (a rejected hit still uses up one of the ten)."""
    return hits.where((F.col("hit_rank") <= HITS_PER_QUERY) & (F.col("query_idx") <= MAX_QUERIES))


def usable_hits(hits: DataFrame) -> DataFrame:
    """S12 + P6: hits of failed queries and null items are skipped."""
    return hits.where((F.col("status") == "ok") & F.col("track_id").isNotNull())


def skipped_hits(hits: DataFrame) -> DataFrame:
    """S12, P6 and P4's quarantine: per request, of the capped hits, the failed
    queries, the null items and the usable hits whose year is no number."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    bad_year = (F.length("release_date") >= 4) & year_of(F.col("release_date")).isNull()
    per_query = hits.groupBy("request_id", "query_idx").agg(
        F.max((~ok).cast("int")).alias("failed"),
        F.count_if(ok & F.col("track_id").isNull()).alias("null_items"),
        F.count_if(ok & F.col("track_id").isNotNull() & bad_year).alias("bad_years"))
    return per_query.groupBy("request_id").agg(
        F.sum("failed").alias("failed_queries"), F.sum("null_items").alias("null_items"),
        F.sum("bad_years").alias("bad_years"))


def filter_years(hits: DataFrame, crit: DataFrame) -> DataFrame:
    """J4 + P4 + P5: equi-join on the request, year range as the residual."""
    c = crit.select("request_id", "year_min", "year_max", "track_limit")
    j = hits.join(c, "request_id")
    return j.where(year_in_range(year_of(F.col("release_date")), F.col("year_min"), F.col("year_max")))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """First copy of a track per request in (query, hit) order.  Runs
    after the year filter, so a rejected copy does not block a later one."""
    w = Window.partitionBy("request_id", "track_id").orderBy("query_idx", "hit_rank")
    return hits.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").drop("_copy")


def top_n(hits: DataFrame, limit_col: str = "track_limit") -> DataFrame:
    """K1 + W6: stable top-N by popularity (missing popularity = 0) with a
    1-based position."""
    w = Window.partitionBy("request_id").orderBy(
        F.desc(F.coalesce(F.col("popularity"), F.lit(0))), "query_idx", "hit_rank")
    ranked = hits.withColumn("position", F.row_number().over(w))
    return ranked.where(F.col("position") <= F.col(limit_col))


def project_tracks(selected: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The 11 stored track fields, plus request and position."""
    cat = catalogue.select("track_id", "uri", "name", "artists", F.col("album.name").alias("album"),
                           F.col("album.images").alias("images"), "duration_ms",
                           "preview_url", "external_url")
    j = selected.join(cat, "track_id")
    return j.select(
        "request_id", "position",
        F.col("track_id").cast("string").alias("id"), "uri", "name",
        artist_names(F.col("artists")).alias("artists"),
        "album", "release_date", "duration_ms",
        F.coalesce(F.col("popularity"), F.lit(0)).alias("popularity"),
        "preview_url", "external_url",
        first_image_url(F.col("images")).alias("image_url"),
    )


def by_request(hits: DataFrame) -> DataFrame:
    """Cluster capped hits on ``request_id`` once; every later window and
    the criteria join are keyed by it.  After the cap a request holds at
    most 60 rows, so this exchange cannot concentrate a hot key."""
    return hits.repartition("request_id")


def select_candidates(hits: DataFrame, crit: DataFrame, catalogue: DataFrame) -> DataFrame:
    """G1 end to end."""
    kept = filter_years(by_request(usable_hits(cap_hits(hits))), crit)
    return project_tracks(top_n(dedupe_hits(kept)), catalogue)
