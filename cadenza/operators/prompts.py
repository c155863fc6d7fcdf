"""Request checks and the text context of each model call.

The wording is ours (application copy is not reproduced); what is kept is
the data that goes in: which lists, how many items, in which order, how
they are joined and what replaces an empty list.  Per-user lists are
bounded (<= 150 ranked items), so the ``collect_list`` steps here never
gather an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import strip_ws

MIN_PROMPT, MAX_PROMPT = 5, 500
NOT_AVAILABLE = "not available"
TARGETS = ("energy", "valence", "tempo", "danceability", "acousticness")


def check_requests(requests: DataFrame) -> DataFrame:
    """Trim (Python whitespace, not Spark's space-only trim); empty ->
    ``empty``; shorter than 5 -> ``too_short`` (browser rule); longer than
    500 -> ``too_long`` (the browser field's cap, here a quarantine
    reason instead of a silent cut); else ``accepted`` with the trimmed
    text."""
    t = strip_ws(F.col("prompt"))
    n = F.length(t)
    status = (F.when(F.col("prompt").isNull() | (n == 0), F.lit("empty"))
              .when(n < MIN_PROMPT, F.lit("too_short"))
              .when(n > MAX_PROMPT, F.lit("too_long"))
              .otherwise(F.lit("accepted")))
    return requests.withColumn("prompt_clean", t).withColumn("check", status)


def accepted(requests: DataFrame) -> DataFrame:
    """The requests that pass P9, with the trimmed text as their prompt: only
    these get a profile and a context."""
    return check_requests(requests).where(F.col("check") == "accepted") \
        .withColumn("prompt", F.col("prompt_clean")).drop("check", "prompt_clean")


def with_profile(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Request left-joined to the user's stored profile."""
    p = profiles.select("user_id", "top_artists", "top_tracks", F.lit(True).alias("has_profile"))
    j = requests.join(p, "user_id", "left")
    return j.withColumn("has_profile", F.coalesce("has_profile", F.lit(False)))


def _or_na(text):
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NOT_AVAILABLE))


def criteria_context(req_profiles: DataFrame) -> DataFrame:
    """L1: first 20 artist names and first 20 "track — first artist" (the
    track name alone when it has no artists), comma-joined, "not
    available" for an empty list; a generic line without a profile; the
    user's text last."""
    artists = F.array_join(F.slice(F.transform("top_artists", lambda a: a["name"]), 1, 20), ", ")
    tracks = F.array_join(F.slice(F.transform(
        "top_tracks",
        lambda t: F.when(F.size(t["artists"]) > 0,
                         F.concat(t["name"], F.lit(" — "), F.get(t["artists"], 0)))
                   .otherwise(t["name"])), 1, 20), ", ")
    with_p = F.concat(F.lit("Top artists: "), _or_na(artists), F.lit("\nTop tracks: "), _or_na(tracks))
    ctx = F.when(F.col("has_profile"), with_p).otherwise(F.lit("No listening profile."))
    return req_profiles.select("request_id", F.concat(ctx, F.lit("\nRequest: "), F.col("prompt")).alias("context"))


def criteria_text(c) -> F.Column:
    """Criteria as ``key=value`` text for the query context (L2)."""
    def num(x):
        return F.coalesce(x.cast("string"), F.lit(""))
    return F.concat_ws(
        "; ",
        F.concat(F.lit("genres="), F.array_join(c["seed_genres"], ",")),
        F.concat(F.lit("artists="), F.array_join(c["seed_artists"], ",")),
        F.concat(F.lit("years="), num(c["year_min"]), F.lit("-"), num(c["year_max"])),
        *[F.concat(F.lit(f"{x}="), num(c[f"target_{x}"])) for x in TARGETS],
        F.concat(F.lit("market="), c["market"]),
        F.concat(F.lit("limit="), num(c["track_limit"])))


def query_context(crit: DataFrame, req_profiles: DataFrame) -> DataFrame:
    """L2: first 15 artist names (the section is left out when there are
    none), then the criteria."""
    names = F.array_join(F.slice(F.transform("top_artists", lambda a: a["name"]), 1, 15), ", ")
    section = F.when(F.col("has_profile") & (F.size("top_artists") > 0),
                     F.concat(F.lit("Similar to: "), names, F.lit("\n"))).otherwise(F.lit(""))
    j = crit.join(req_profiles.select("request_id", "has_profile", "top_artists"), "request_id")
    return j.select("request_id", F.concat(section, F.lit("Criteria: "), criteria_text(F.struct(*[
        F.col(c) for c in ("seed_genres", "seed_artists", "year_min", "year_max", *[f"target_{x}" for x in TARGETS],
                           "market", "track_limit")]))).alias("context"))


def title_context(track_lists: DataFrame, requests: DataFrame) -> DataFrame:
    """L3: the first 10 selected tracks, one line each ("- name — artists"),
    then the user's text.  ``track_lists(request_id, tracks)``."""
    lines = F.transform(F.slice("tracks", 1, 10),
                        lambda t: F.concat(F.lit("- "), F.coalesce(t["name"], F.lit("Unknown")), F.lit(" — "),
                                           F.array_join(F.coalesce(t["artists"], F.array(F.lit("Unknown"))), ", ")))
    j = track_lists.join(requests.select("request_id", "prompt"), "request_id")
    return j.select("request_id", F.concat(F.array_join(lines, "\n"), F.lit("\nRequest: "), F.col("prompt"))
                    .alias("context"))
