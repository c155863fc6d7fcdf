"""Record shapes D1-D11 as Spark types.

JSON columns of the original tables are native arrays and structs here;
``to_json``/``from_json`` are only used at the edge (S13).
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# D3: audio-feature averages; four in [0, 1], tempo >= 0.
AUDIO_FEATURES = _struct(("energy", D), ("valence", D), ("danceability", D),
                         ("acousticness", D), ("tempo", D))
# Profile track; D6: profile artist.
PROFILE_TRACK = _struct(("id", S), ("name", S), ("artists", T.ArrayType(S)), ("uri", S), ("time_range", S))
PROFILE_ARTIST = _struct(("id", S), ("name", S), ("genres", T.ArrayType(S)), ("uri", S), ("time_range", S))
# Recently played row.
RECENT_PLAY = _struct(("id", S), ("name", S), ("artists", T.ArrayType(S)), ("uri", S), ("played_at", TS))
# Selected track (11 fields).
SELECTED_TRACK = _struct(("id", S), ("uri", S), ("name", S), ("artists", T.ArrayType(S)), ("album", S),
                         ("release_date", S), ("duration_ms", L), ("popularity", I),
                         ("preview_url", S), ("external_url", S), ("image_url", S))
# Criteria.
CRITERIA = _struct(("seed_genres", T.ArrayType(S)), ("seed_artists", T.ArrayType(S)),
                   ("year_min", L), ("year_max", L), ("target_energy", D), ("target_valence", D),
                   ("target_tempo", D), ("target_danceability", D), ("target_acousticness", D),
                   ("market", S), ("track_limit", I))

# Profile table, one row per user.
USER_PROFILE = _struct(("user_id", L), ("synced_at", TS), ("top_genres", T.ArrayType(S)),
                       ("top_artists", T.ArrayType(PROFILE_ARTIST)),
                       ("top_tracks", T.ArrayType(PROFILE_TRACK)),
                       ("audio_features_avg", AUDIO_FEATURES))
# Playlist table, with the user key the original lacked and the
# description it generated but never stored (V6, V9).
PLAYLISTS = _struct(("id", S), ("user_id", L), ("created_at", TS), ("user_prompt", S),
                    ("llm_params", CRITERIA), ("title", S), ("description", S), ("track_count", I),
                    ("tracks", T.ArrayType(SELECTED_TRACK)), ("external_id", S), ("external_url", S))

# Bronze inputs (FIXTURES.md §1).
SEARCH_HITS = _struct(("request_id", L), ("query_idx", I), ("hit_rank", I), ("status", S),
                      ("track_id", L), ("popularity", I), ("release_date", S))
LLM_ATTEMPTS = _struct(("request_id", L), ("kind", S), ("attempt", I), ("raw_text", S))
REQUESTS = _struct(("request_id", L), ("user_id", L), ("prompt", S), ("playlist_id", S))
