"""Post-processing of recommendation results (P1 with 10 fields, P5,
F3b, P8).  The recommendation model itself is remote and not rebuilt;
its returned tracks are an input table.  No de-duplication, no sort: the
rows keep the order they came in (``query_idx``, ``hit_rank``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import artist_names, clamp_seeds, first_image_url, year_in_range, year_of


BOUNDS = ("year_min", "year_max")


def with_bounds(rows: DataFrame, crit: DataFrame) -> DataFrame:
    """The year bounds of each row's request; rows of requests without criteria go."""
    return rows.join(crit.select("request_id", *BOUNDS), "request_id")


def with_details(hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The catalogue's fields of each hit; hits that it does not hold go."""
    cat = catalogue.select("track_id", "uri", "name", "artists", F.col("album.name").alias("album"),
                           F.col("album.release_date").alias("release_date"),
                           F.col("album.images").alias("images"), "duration_ms", "preview_url", "external_url")
    return hits.join(cat, "track_id")


def recommend_post(recs: DataFrame, crit: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Year filter (unknown year passes, zero/NULL bound = no bound)
    and the 10-field projection (no popularity).  Bounds and catalogue fields
    that the rows have already (``with_bounds`` of the queries, ``with_details``
    of the hits before they are joined to these) are not joined again."""
    j = recs if set(BOUNDS) <= set(recs.columns) else with_bounds(recs, crit)
    j = j if "images" in j.columns else with_details(j, catalogue)
    kept = j.where(year_in_range(year_of(F.col("release_date")), F.col("year_min"), F.col("year_max")))
    return kept.select("request_id", "query_idx", "hit_rank", F.col("track_id").cast("string").alias("id"),
                       "uri", "name", artist_names(F.col("artists")).alias("artists"), "album", "release_date",
                       "duration_ms", "preview_url", "external_url",
                       first_image_url(F.col("images")).alias("image_url"))


def call_params(crit: DataFrame) -> DataFrame:
    """F3b + P8: the parameters a recommendation call would carry: seeds
    clamped with artists trimmed only, empty seed lists and NULL targets
    left out, as ``key=value`` pairs in a fixed order."""
    genres, artists = clamp_seeds(F.col("seed_genres"), F.col("seed_artists"), trim_genres=False)

    def opt(key, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value.cast("string")))

    def seeds(key, arr):
        return F.when(F.size(arr) > 0, F.concat(F.lit(f"{key}="), F.array_join(arr, ",")))
    pairs = [seeds("seed_genres", genres), seeds("seed_artists", artists),
             opt("limit", F.col("track_limit")), opt("country", F.col("market"))]
    pairs += [opt(c, F.col(c)) for c in ("target_energy", "target_valence", "target_tempo",
                                         "target_danceability", "target_acousticness")]
    return crit.select("request_id", F.concat_ws("&", *pairs).alias("params"))
