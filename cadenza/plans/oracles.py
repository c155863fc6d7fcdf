"""DuckDB SQL oracles, one per registered query.

Each oracle re-derives the stand-in tables from the driver's views
(``lineitem``, ``orders``, ``part``, ``events``, ``customer``) and states
the operator's semantics directly in SQL, written independently of the
DataFrame code.  Column names and types are aligned with the Spark side:
DuckDB's BIGINT ``row_number``/``count`` are cast where Spark gives INT,
and nested values are returned as joined text (T6, T10).
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


# --------------------------------------------------------------------------
# Stand-in tables (same derivations as cadenza.sources.standins)
# --------------------------------------------------------------------------

HITS = """
hits AS (
  SELECT l_orderkey AS request_id, l_linenumber AS query_idx,
         CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate, l_quantity,
                       l_discount, l_tax, l_returnflag, l_linestatus) AS INTEGER) AS hit_rank,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 23 = 0 THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN l_suppkey % 29 <> 0 THEN l_partkey END AS track_id,
         CAST(trunc(l_quantity) AS INTEGER) AS popularity,
         CASE WHEN l_suppkey % 31 = 0 THEN '19xx-' || strftime(l_shipdate, '%m')
              WHEN l_suppkey % 3 = 0 THEN strftime(l_shipdate, '%Y')
              WHEN l_suppkey % 3 = 1 THEN strftime(l_shipdate, '%Y-%m')
              ELSE strftime(l_shipdate, '%Y-%m-%d') END AS release_date
  FROM lineitem)"""

CRITERIA = """
criteria AS (
  SELECT o_orderkey AS request_id, o_custkey AS user_id,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0
              ELSE CAST(year(o_orderdate) AS INTEGER) - 1 END AS year_min,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL
              ELSE CAST(year(o_orderdate) AS INTEGER) + 1 END AS year_max,
         CAST(o_orderkey % 6 + 1 AS INTEGER) AS track_limit,
         list_extract(['FR', 'US', 'DE', 'GB', 'JP'], CAST(o_orderkey % 7 + 1 AS INTEGER)) AS market
  FROM orders)"""

CATALOGUE = """
catalogue AS (
  SELECT p_partkey AS track_id, 'track:' || p_partkey AS uri, CASE WHEN p_size % 25 <> 0 THEN p_name END AS name,
         CASE WHEN p_size % 5 = 0 THEN [p_brand, 'Guest ' || p_size] ELSE [p_brand] END AS artist_names,
         p_type AS album, CAST(p_size + 1975 AS VARCHAR) || '-01-01' AS album_release_date,
         CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'img:' || p_partkey || ':640' END AS image_url,
         [lower(p_type), split_part(p_name, ' ', 1)] AS genres,
         CAST(floor(p_retailprice * 200) AS BIGINT) AS duration_ms,
         CASE WHEN p_size % 4 <> 0 THEN 'preview:' || p_partkey END AS preview_url,
         CASE WHEN p_size % 7 <> 0 THEN 'https://tracks.example/t/' || p_partkey END AS external_url
  FROM part)"""

# Hits after the per-query cap, failed-query and null-item filters,
# joined to the request's criteria with the parsed year.
CAPPED = """
capped AS (
  SELECT h.*, c.year_min, c.year_max, c.track_limit,
         CASE WHEN length(h.release_date) >= 4
              THEN TRY_CAST(substr(h.release_date, 1, 4) AS INTEGER) END AS year
  FROM hits h JOIN criteria c USING (request_id)
  WHERE h.hit_rank <= 10 AND h.query_idx <= 6 AND h.status = 'ok' AND h.track_id IS NOT NULL)"""

YEAR_OK = """(year IS NULL OR year = 0 OR year_min IS NULL OR year_min = 0 OR year >= year_min)
         AND (year IS NULL OR year = 0 OR year_max IS NULL OR year_max = 0 OR year <= year_max)"""

TOPN = f"""
kept AS (SELECT * FROM capped WHERE {YEAR_OK}),
dedup AS (
  SELECT * FROM kept
  QUALIFY row_number() OVER (PARTITION BY request_id, track_id ORDER BY query_idx, hit_rank) = 1),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id
              ORDER BY coalesce(popularity, 0) DESC, query_idx, hit_rank) AS INTEGER) AS position
  FROM dedup),
topn AS (SELECT * FROM ranked WHERE position <= track_limit)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# --------------------------------------------------------------------------
# G1 and its parts
# --------------------------------------------------------------------------

oracle("g1_candidates", with_(HITS, CRITERIA, CATALOGUE, CAPPED, TOPN) + """
SELECT t.request_id, t.position, CAST(t.track_id AS VARCHAR) AS id, c.uri, c.name,
       array_to_string(c.artist_names, ', ') AS artists, c.album, t.release_date,
       c.duration_ms, coalesce(t.popularity, 0) AS popularity,
       c.preview_url, c.external_url, c.image_url
FROM topn t JOIN catalogue c USING (track_id)""")

oracle("w5_query_cap", with_(HITS) + """
SELECT request_id, query_idx, hit_rank, track_id
FROM hits WHERE hit_rank <= 10 AND query_idx <= 6""")

oracle("p4_p5_year_filter", with_(HITS, CRITERIA, CAPPED) + f"""
SELECT request_id, query_idx, hit_rank, track_id, release_date, year,
       ({YEAR_OK}) AS kept
FROM capped""")

oracle("s12_skipped", with_(HITS) + """,
per_query AS (
  SELECT request_id, query_idx, max(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) AS failed,
         count(*) FILTER (WHERE status = 'ok' AND track_id IS NULL) AS null_items,
         count(*) FILTER (WHERE status = 'ok' AND track_id IS NOT NULL
                          AND TRY_CAST(substr(release_date, 1, 4) AS INTEGER) IS NULL) AS bad_years
  FROM hits WHERE hit_rank <= 10 AND query_idx <= 6 GROUP BY request_id, query_idx)
SELECT request_id, CAST(sum(failed) AS BIGINT) AS failed_queries, CAST(sum(null_items) AS BIGINT) AS null_items,
       CAST(sum(bad_years) AS BIGINT) AS bad_years
FROM per_query GROUP BY request_id""")

oracle("w4_dedupe_hits", with_(HITS, CRITERIA, CAPPED, TOPN) + """
SELECT request_id, query_idx, hit_rank, track_id FROM dedup""")

oracle("k1_top_n", with_(HITS, CRITERIA, CAPPED, TOPN) + """
SELECT request_id, position, track_id, popularity, query_idx, hit_rank FROM topn""")


# --------------------------------------------------------------------------
# G2 profile build and its parts
# --------------------------------------------------------------------------

TOP_RAW = """
top_ev AS (
  SELECT *, CASE WHEN event_type IN ('view', 'signup') THEN 1 WHEN event_type IN ('click', 'error') THEN 2
                 ELSE 3 END AS term_ord,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_key
  FROM events),
top_raw AS (
  SELECT user_id, term_ord, ['short_term', 'medium_term', 'long_term'][term_ord] AS time_range,
         CAST(row_number() OVER (PARTITION BY user_id, term_ord ORDER BY value DESC, event_id) AS INTEGER) AS rank,
         item_key
  FROM top_ev)"""

ARTIST_ITEMS = """
artist_items AS (
  SELECT p_partkey AS item_key, p_brand AS id, p_brand AS name,
         CASE WHEN p_size % 10 = 0 THEN [lower(p_type), split_part(p_name, ' ', 1), lower(p_type)]
              ELSE [lower(p_type), split_part(p_name, ' ', 1)] END AS genres,
         'artist:' || p_brand AS uri
  FROM part)"""

W1 = """
w1 AS (
  SELECT r.user_id, CAST(c.track_id AS VARCHAR) AS id, c.name,
         array_to_string(c.artist_names, ', ') AS artists, c.uri, r.time_range, r.term_ord, r.rank
  FROM top_raw r JOIN catalogue c ON c.track_id = r.item_key
  WHERE r.rank <= 50
  QUALIFY row_number() OVER (PARTITION BY r.user_id, c.track_id ORDER BY r.term_ord, r.rank) = 1)"""

W2 = """
w2 AS (
  SELECT r.user_id, a.id, a.name, a.genres, a.uri, r.time_range, r.term_ord, r.rank
  FROM top_raw r JOIN artist_items a ON a.item_key = r.item_key
  WHERE r.rank <= 50
  QUALIFY row_number() OVER (PARTITION BY r.user_id, a.id ORDER BY r.term_ord, r.rank) = 1)"""

GENRES = """
g_exp AS (
  SELECT user_id, term_ord, rank, unnest(genres) AS genre, generate_subscripts(genres, 1) AS pos FROM w2),
g_cnt AS (
  SELECT user_id, genre, count(*) AS n_artists, min(term_ord * 100000 + rank * 100 + pos) AS first_seen
  FROM g_exp GROUP BY user_id, genre),
genres AS (
  SELECT user_id, genre, n_artists,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY n_artists DESC, first_seen) AS INTEGER) AS genre_rank
  FROM g_cnt)"""


def _mean3(x: str) -> str:
    return (f"CAST(round(CAST(CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / count({x}) "
            f"AS DECIMAL(18,9)), 3) AS DOUBLE)")


FEATURES = f"""
lf AS (
  SELECT o_custkey AS user_id, NULLIF(l_discount, 0) * 10 AS energy, NULLIF(l_tax, 0) * 12.5 AS valence,
         NULLIF(l_partkey % 11, 0) / 10.0::DOUBLE AS danceability, NULLIF(l_suppkey % 6, 0) / 5.0::DOUBLE AS acousticness,
         NULLIF(l_quantity, 1) AS tempo
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lf_agg AS (
  SELECT user_id, {_mean3('energy')} AS energy, {_mean3('valence')} AS valence,
         {_mean3('danceability')} AS danceability, {_mean3('acousticness')} AS acousticness,
         {_mean3('tempo')} AS tempo
  FROM lf GROUP BY user_id),
feat AS (
  SELECT c_custkey AS user_id, coalesce(a.energy, 0.5) AS energy, coalesce(a.valence, 0.5) AS valence,
         coalesce(a.danceability, 0.5) AS danceability, coalesce(a.acousticness, 0.5) AS acousticness,
         coalesce(a.tempo, 120.0) AS tempo
  FROM customer LEFT JOIN lf_agg a ON a.user_id = c_custkey)"""

PROFILE = """
gl AS (SELECT user_id, string_agg(genre, ',' ORDER BY genre_rank) AS top_genres FROM genres GROUP BY user_id),
al AS (SELECT user_id, string_agg(name, ',' ORDER BY term_ord, rank) AS top_artists, count(*) AS n_a
       FROM w2 GROUP BY user_id),
tl AS (SELECT user_id, string_agg(id, ',' ORDER BY term_ord, rank) AS top_tracks, count(*) AS n_t
       FROM w1 GROUP BY user_id),
prof AS (
  SELECT f.user_id, coalesce(gl.top_genres, '') AS top_genres, coalesce(al.top_artists, '') AS top_artists,
         coalesce(tl.top_tracks, '') AS top_tracks, CAST(coalesce(al.n_a, 0) AS INTEGER) AS artists_count,
         CAST(coalesce(tl.n_t, 0) AS INTEGER) AS tracks_count,
         f.energy, f.valence, f.danceability, f.acousticness, f.tempo
  FROM feat f LEFT JOIN gl USING (user_id) LEFT JOIN al USING (user_id) LEFT JOIN tl USING (user_id))"""

oracle("w1_top_tracks", with_(CATALOGUE, TOP_RAW, W1) + """
SELECT * FROM w1""")

oracle("w2_top_artists", with_(ARTIST_ITEMS, TOP_RAW, W2) + """
SELECT user_id, id, name, array_to_string(genres, ',') AS genres, uri, time_range, term_ord, rank FROM w2""")

oracle("w3_recent_plays", """
WITH pl AS (
  SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id, ts AS played_at, event_id
  FROM events),
top100 AS (
  SELECT * FROM pl
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY played_at DESC, event_id DESC) <= 100)
SELECT * FROM top100
QUALIFY row_number() OVER (PARTITION BY user_id, track_id ORDER BY played_at DESC, event_id DESC) = 1""")

oracle("s11_cursor", """
WITH pl AS (
  SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id, ts AS played_at, event_id,
         CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS poll
  FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY poll, user_id ORDER BY played_at DESC, event_id DESC) AS rn FROM pl)
SELECT CAST(poll AS INTEGER) AS poll, user_id, CAST((rn - 1) // 50 + 1 AS INTEGER) AS page,
       CAST(rn AS INTEGER) AS position, track_id, played_at, event_id
FROM r WHERE rn <= 100""")

oracle("a1_k3_genres", with_(ARTIST_ITEMS, TOP_RAW, W2, GENRES) + """
SELECT user_id, genre, n_artists, genre_rank FROM genres""")

oracle("a2_feature_avg", with_(FEATURES) + """
SELECT * FROM feat""")

oracle("a4_collect_tracks", with_(CATALOGUE, TOP_RAW, W1) + """
SELECT user_id, CAST(count(*) AS INTEGER) AS n_tracks, string_agg(id, ',' ORDER BY term_ord, rank) AS track_ids
FROM w1 GROUP BY user_id""")

oracle("g2_profile", with_(CATALOGUE, ARTIST_ITEMS, TOP_RAW, W1, W2, GENRES, FEATURES, PROFILE) + """
SELECT user_id, top_genres, top_artists, top_tracks, energy, valence, danceability, acousticness, tempo
FROM prof""")

oracle("p10_profile_summary", with_(CATALOGUE, ARTIST_ITEMS, TOP_RAW, W1, W2, GENRES, FEATURES, PROFILE) + """
SELECT user_id, array_to_string(list_slice(string_split(top_genres, ','), 1, 10), ',') AS genres,
       artists_count, tracks_count, energy, valence, danceability, acousticness, tempo
FROM prof""")


# --------------------------------------------------------------------------
# Model replies
# --------------------------------------------------------------------------

from cadenza.sources.replies import llm_attempts_sql  # noqa: E402

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _unfence(x: str) -> str:
    t = f"trim({x}, {_WS})"
    return (f"trim(CASE WHEN starts_with({t}, '```') THEN regexp_replace(regexp_replace({t}, "
            f"'^```[a-z]*\\n?', ''), '\\n?```$', '') ELSE {t} END, {_WS})")


# The criteria record as the check sees it, apart from the code under check:
# (key, kind, whether null is allowed, bounds).
_RECORD = [
    ("seed_genres", "list", False, None, None), ("seed_artists", "list", False, None, None),
    ("year_min", "int", True, None, None), ("year_max", "int", True, None, None),
    ("target_energy", "float", True, 0, 1), ("target_valence", "float", True, 0, 1),
    ("target_tempo", "float", True, 0, None), ("target_danceability", "float", True, 0, 1),
    ("target_acousticness", "float", True, 0, 1), ("market", "str", False, None, None),
    ("limit", "int", False, 1, 100)]


def _field_sql(name, kind, nullable, lo, hi):
    p = f"'$.{name}'"
    t = f"json_type(j, {p})"
    s = f"json_extract_string(j, {p})"
    if kind == "list":
        ok = (f"({t} IS NULL OR ({t} = 'ARRAY' AND coalesce(list_bool_and(list_transform("
              f"json_extract(j, '$.{name}[*]'), lambda x: json_type(x) = 'VARCHAR')), true)))")
        val = f"CASE WHEN {t} IS NULL THEN []::VARCHAR[] ELSE json_extract_string(j, '$.{name}[*]') END"
    elif kind == "str":
        ok = f"({t} IS NULL OR {t} = 'VARCHAR')"
        val = f"CASE WHEN {t} IS NULL THEN 'FR' ELSE {s} END"
    else:
        num = f"{t} IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
        if kind == "int":
            good = (f"(({num} AND TRY_CAST({s} AS DOUBLE) = floor(TRY_CAST({s} AS DOUBLE))) OR {t} = 'BOOLEAN' "
                    f"OR ({t} = 'VARCHAR' AND regexp_full_match({s}, '\\s*[-+]?\\d+(\\.0+)?\\s*')))")
            raw = (f"CASE WHEN {t} = 'BOOLEAN' THEN CAST({s} = 'true' AS BIGINT) "
                   f"WHEN {t} = 'VARCHAR' THEN TRY_CAST(split_part(trim({s}), '.', 1) AS BIGINT) "
                   f"WHEN {t} = 'DOUBLE' THEN TRY_CAST(trunc(TRY_CAST({s} AS DOUBLE)) AS BIGINT) "
                   f"ELSE TRY_CAST({s} AS BIGINT) END")
            good = f"({good} AND {raw} IS NOT NULL)"
        else:
            good = (f"({num} OR {t} = 'BOOLEAN' OR ({t} = 'VARCHAR' AND regexp_full_match({s}, "
                    f"'\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?\\s*')))")
            raw = (f"CASE WHEN {t} = 'BOOLEAN' THEN CAST(CAST({s} = 'true' AS INTEGER) AS DOUBLE) "
                   f"ELSE TRY_CAST(trim({s}) AS DOUBLE) END")
        rng = []
        if lo is not None:
            rng.append(f"{raw} >= {lo}")
        if hi is not None:
            rng.append(f"{raw} <= {hi}")
        rng_sql = " AND ".join(rng) if rng else "true"
        null_ok = f" OR {t} = 'NULL'" if nullable else ""
        ok = f"({t} IS NULL{null_ok} OR ({good} AND coalesce({rng_sql}, false)))"
        default = "30" if name == "limit" else "NULL"
        val = f"CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN {default} ELSE {raw} END"
    return ok, val


def _typed_sql() -> str:
    cols, oks, errs = [], [], []
    for name, kind, nullable, lo, hi in _RECORD:
        ok, val = _field_sql(name, kind, nullable, lo, hi)
        out = "track_limit" if name == "limit" else name
        kept = f"CASE WHEN {ok} THEN {val} END"
        cols.append(f"CAST({kept} AS INTEGER) AS {out}" if name == "limit" else f"{kept} AS {out}")
        oks.append(ok)
        errs.append(f"WHEN NOT {ok} THEN 'invalid:{name}'")
    all_ok = " AND ".join(["is_obj"] + oks)
    return f"""
ca AS (
  SELECT request_id, attempt, TRY_CAST(CASE WHEN json_valid(body) THEN body END AS JSON) AS j
  FROM (SELECT request_id, attempt, {_unfence('raw_text')} AS body FROM attempts WHERE kind = 'criteria')),
cb AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS is_obj FROM ca),
typed0 AS MATERIALIZED (
  SELECT request_id, attempt, {", ".join(cols)}, ({all_ok}) AS ok,
         CASE WHEN j IS NULL THEN 'not_json' WHEN NOT is_obj THEN 'not_object' {" ".join(errs)} END AS err0
  FROM cb),
typed AS (
  SELECT request_id, attempt,
         list_slice(seed_genres, 1, 5) AS seed_genres,
         list_slice(seed_artists, 1, greatest(0, 5 - len(list_slice(seed_genres, 1, 5)))) AS seed_artists,
         year_min, year_max, target_energy, target_valence, target_tempo, target_danceability,
         target_acousticness, market, track_limit, ok, CASE WHEN NOT ok THEN err0 END AS error
  FROM typed0)"""


TYPED = _typed_sql()
ATTEMPTS = llm_attempts_sql()
CRIT_COLS = ("array_to_string(seed_genres, ',') AS seed_genres, array_to_string(seed_artists, ',') AS seed_artists, "
             "year_min, year_max, target_energy, target_valence, target_tempo, target_danceability, "
             "target_acousticness, market, track_limit")
FIRST_VALID = """
w7 AS (
  SELECT request_id,
         min(attempt) FILTER (WHERE ok AND attempt <= 3) AS chosen,
         arg_max(error, attempt) FILTER (WHERE attempt <= 3) AS last_error
  FROM typed GROUP BY request_id),
crit_table AS MATERIALIZED (
  SELECT w.request_id, CASE WHEN w.chosen IS NULL THEN 'failed' ELSE 'ok' END AS status,
         CAST(w.chosen AS INTEGER) AS attempt, t.seed_genres, t.seed_artists, t.year_min, t.year_max,
         t.target_energy, t.target_valence, t.target_tempo, t.target_danceability, t.target_acousticness,
         t.market, t.track_limit, CASE WHEN w.chosen IS NULL THEN w.last_error END AS error
  FROM w7 w LEFT JOIN typed t ON t.request_id = w.request_id AND t.attempt = w.chosen)"""

QUERY_ROWS = f"""
qa AS (
  SELECT request_id, TRY_CAST(CASE WHEN json_valid(body) THEN body END AS JSON) AS j
  FROM (SELECT request_id, {_unfence('raw_text')} AS body FROM attempts WHERE kind = 'queries')),
ql AS (
  SELECT request_id,
         CASE WHEN coalesce(json_type(j) = 'ARRAY' AND coalesce(list_bool_and(list_transform(
                   json_extract(j, '$[*]'), lambda x: json_type(x) = 'VARCHAR')), true), false)
              THEN list_slice(json_extract_string(j, '$[*]'), 1, 6)
              ELSE ['genre:indie year:2010-2024'] END AS qs
  FROM qa),
query_rows AS MATERIALIZED (
  SELECT request_id, CAST(generate_subscripts(qs, 1) AS INTEGER) AS query_idx, unnest(qs) AS query FROM ql)"""

TITLES = f"""
ta AS (
  SELECT request_id, TRY_CAST(CASE WHEN json_valid(body) THEN body END AS JSON) AS j
  FROM (SELECT request_id, {_unfence('raw_text')} AS body FROM attempts WHERE kind = 'title')),
title_rows AS (
  SELECT request_id,
         CASE WHEN json_type(j, '$.title') = 'VARCHAR' THEN json_extract_string(j, '$.title')
              ELSE 'My Playlist' END AS title,
         CASE WHEN json_type(j, '$.description') = 'VARCHAR' THEN json_extract_string(j, '$.description')
              ELSE 'Generated playlist' END AS description
  FROM ta)"""

oracle("f1_f2_criteria", with_(ATTEMPTS, TYPED) + f"""
SELECT request_id, CAST(attempt AS INTEGER) AS attempt, {CRIT_COLS}, ok, error FROM typed""")

oracle("w7_first_valid", with_(ATTEMPTS, TYPED, FIRST_VALID) + """
SELECT request_id, status, attempt, error FROM crit_table""")

oracle("l4_criteria", with_(ATTEMPTS, TYPED, FIRST_VALID) + f"""
SELECT request_id, status, attempt, {CRIT_COLS}, error FROM crit_table""")

oracle("l4_quarantine", with_(ATTEMPTS, TYPED) + """
SELECT request_id, CAST(attempt AS INTEGER) AS attempt, error FROM typed WHERE NOT ok""")

oracle("f3_seed_clamp", with_(ATTEMPTS, TYPED, FIRST_VALID) + """
SELECT request_id, CAST(len(seed_genres) AS INTEGER) AS n_genres, CAST(len(seed_artists) AS INTEGER) AS n_artists,
       array_to_string(seed_genres, ',') AS seed_genres, array_to_string(seed_artists, ',') AS seed_artists
FROM crit_table WHERE status = 'ok'""")

oracle("f4_queries", with_(ATTEMPTS, QUERY_ROWS) + """
SELECT request_id, query_idx, query FROM query_rows""")

oracle("f5_titles", with_(ATTEMPTS, TITLES) + """
SELECT request_id, title, description FROM title_rows""")


# --------------------------------------------------------------------------
# Store jobs
# --------------------------------------------------------------------------

PLAYLISTS = """
playlists AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS user_id, o_orderdate AS created_at,
         'music for ' || lower(substr(o_orderpriority, 3, 20)) AS user_prompt,
         CASE WHEN o_orderkey % 13 = 0 THEN 'around ' || year(o_orderdate)
              ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS created_text,
         'Mix ' || o_orderkey AS title, CAST(o_orderkey % 60 + 1 AS INTEGER) AS track_count,
         CASE WHEN o_orderstatus = 'F' THEN 'ext' || o_orderkey END AS external_id,
         CASE WHEN o_orderstatus = 'F' THEN 'https://lists.example/p/' || o_orderkey
              WHEN o_orderstatus = 'P' THEN '' END AS external_url
  FROM orders)"""

DELETIONS = """
deletions AS (
  SELECT l_suppkey AS requester_id,
         CAST(CASE WHEN l_linenumber = 1 THEN l_orderkey ELSE l_orderkey + 1000000000 END AS VARCHAR) AS playlist_id
  FROM lineitem WHERE l_returnflag = 'R')"""

oracle("s2_schema_evolution", with_(HITS, CRITERIA, CATALOGUE, CAPPED, TOPN, PLAYLISTS) + """,
lists AS (SELECT request_id, count(*) AS n, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY position) AS ids
          FROM topn GROUP BY request_id)
SELECT p.id,
       CAST(CASE WHEN p.created_at < TIMESTAMP '1998-01-01' THEN 0 ELSE coalesce(l.n, 0) END AS INTEGER) AS n_tracks,
       CASE WHEN p.created_at < TIMESTAMP '1998-01-01' THEN '' ELSE coalesce(l.ids, '') END AS track_ids
FROM playlists p LEFT JOIN lists l ON p.id = CAST(l.request_id AS VARCHAR)""")

oracle("s3_upsert", """
WITH s0 AS (SELECT user_id, count(*) AS n_events, max(ts) AS synced_at, -1 AS seq
            FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
s1 AS (SELECT user_id, count(*), max(ts), 1 FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id),
s2 AS (SELECT user_id, count(*), max(ts), 2 FROM events WHERE event_type = 'error' GROUP BY user_id),
allw AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)
SELECT user_id, n_events, synced_at FROM allw
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""")

oracle("s6_history", with_(PLAYLISTS) + """
SELECT user_id, id, created_at,
       row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position
FROM playlists""")

oracle("s7_update", with_(PLAYLISTS) + """,
upd AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS playlist_id, 'ext2-' || o_orderkey AS external_id,
         'https://lists.example/p2/' || o_orderkey AS external_url, 1 AS seq
  FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), 'ext3-' || o_orderkey, 'https://lists.example/p3/' || o_orderkey, 2
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
  UNION ALL
  SELECT CAST(o_orderkey + 1000000000 AS VARCHAR), 'ext-x', 'https://lists.example/x', 1
  FROM orders WHERE o_orderpriority = '2-HIGH'),
last AS (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY seq DESC) = 1)
SELECT p.id, CASE WHEN l.playlist_id IS NULL THEN p.external_id ELSE l.external_id END AS external_id,
       CASE WHEN l.playlist_id IS NULL THEN p.external_url ELSE l.external_url END AS external_url
FROM playlists p LEFT JOIN last l ON l.playlist_id = p.id""")

oracle("s8_delete", with_(PLAYLISTS, DELETIONS) + """
SELECT id, user_id FROM playlists WHERE id NOT IN (SELECT playlist_id FROM deletions)""")

oracle("g6_delete_counts", with_(PLAYLISTS, DELETIONS) + """
SELECT requester_id, count(*) AS requested,
       count(DISTINCT CASE WHEN playlist_id IN (SELECT id FROM playlists) THEN playlist_id END) AS deleted
FROM deletions GROUP BY requester_id""")

oracle("j2_relaunch", with_(HITS, CRITERIA, CATALOGUE, CAPPED, TOPN, PLAYLISTS) + """,
lists AS (SELECT request_id, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY position) AS ids
          FROM topn GROUP BY request_id)
SELECT o_orderkey AS request_id, p.title AS prior_title, coalesce(p.track_count, 0) AS prior_track_count,
       CASE WHEN p.created_at >= TIMESTAMP '1998-01-01' THEN coalesce(l.ids, '') ELSE '' END AS prior_track_ids
FROM orders LEFT JOIN playlists p LEFT JOIN lists l ON p.id = CAST(l.request_id AS VARCHAR)
  ON p.id = CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderkey - 3 AS VARCHAR) END""")

oracle("s14_batches", """
WITH t AS (
  SELECT l_suppkey, 'track:' || l_partkey AS uri,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                            l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pos
  FROM lineitem)
SELECT l_suppkey, (pos - 1) // 100 AS batch_no, CAST(count(*) AS INTEGER) AS batch_size,
       min(pos) AS first_pos, max(pos) AS last_pos, string_agg(uri, ',' ORDER BY pos) AS uris
FROM t GROUP BY l_suppkey, (pos - 1) // 100""")


# --------------------------------------------------------------------------
# Requests, prompt contexts, playlist build and reports
# --------------------------------------------------------------------------

NL = "chr(10)"
REQUESTS = f"""
requests AS (
  SELECT o_orderkey AS request_id, o_custkey AS user_id,
         CASE o_orderkey % 5
           WHEN 0 THEN '  ' || chr(9) || {NL} || ' '
           WHEN 1 THEN ' ab' || (o_orderkey % 10) || ' '
           WHEN 2 THEN '  music for ' || lower(substr(o_orderpriority, 3, 20)) || {NL}
           WHEN 3 THEN 'songs like order ' || o_orderkey
           ELSE repeat('la ', 200) END AS prompt
  FROM orders)"""

SYNCED = f"""
al AS (SELECT user_id, list(name ORDER BY term_ord, rank) AS names FROM w2 GROUP BY user_id),
tl AS (SELECT user_id, list(name || ' — ' || split_part(artists, ', ', 1) ORDER BY term_ord, rank) AS lines,
              count(*) AS n FROM w1 GROUP BY user_id),
accepted AS (SELECT request_id, user_id, trim(prompt, {_WS}) AS prompt FROM requests
             WHERE length(trim(prompt, {_WS})) BETWEEN 5 AND 500),
synced AS (SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
reqp AS (
  SELECT r.request_id, r.user_id, r.prompt, s.user_id IS NOT NULL AS has_profile,
         CASE WHEN s.user_id IS NOT NULL THEN coalesce(al.names, []) END AS names,
         CASE WHEN s.user_id IS NOT NULL THEN coalesce(tl.lines, []) END AS lines
  FROM accepted r LEFT JOIN synced s ON s.user_id = r.user_id
  LEFT JOIN al ON al.user_id = r.user_id LEFT JOIN tl ON tl.user_id = r.user_id)"""

oracle("p9_request_check", with_(REQUESTS) + f""",
t AS (SELECT request_id, prompt, trim(prompt, {_WS}) AS p FROM requests)
SELECT request_id,
       CASE WHEN prompt IS NULL OR length(p) = 0 THEN 'empty' WHEN length(p) < 5 THEN 'too_short'
            WHEN length(p) > 500 THEN 'too_long' ELSE 'accepted' END AS "check",
       p AS prompt_clean
FROM t""")

oracle("j1_request_profile", with_(CATALOGUE, ARTIST_ITEMS, TOP_RAW, W1, W2, REQUESTS, SYNCED) + """
SELECT request_id, user_id, has_profile, CAST(coalesce(len(names), 0) AS INTEGER) AS n_artists,
       CAST(coalesce(len(lines), 0) AS INTEGER) AS n_tracks
FROM reqp""")

oracle("l1_context", with_(CATALOGUE, ARTIST_ITEMS, TOP_RAW, W1, W2, REQUESTS, SYNCED) + f"""
SELECT request_id,
       CASE WHEN has_profile
            THEN 'Top artists: ' || coalesce(nullif(array_to_string(list_slice(names, 1, 20), ', '), ''), 'not available')
                 || {NL} || 'Top tracks: ' || coalesce(nullif(array_to_string(list_slice(lines, 1, 20), ', '), ''), 'not available')
            ELSE 'No listening profile.' END || {NL} || 'Request: ' || prompt AS context
FROM reqp""")


def _num(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


oracle("l2_query_context", with_(CATALOGUE, ARTIST_ITEMS, TOP_RAW, W1, W2, REQUESTS, SYNCED, ATTEMPTS,
                                 TYPED, FIRST_VALID) + f"""
SELECT c.request_id,
       CASE WHEN p.has_profile AND len(p.names) > 0
            THEN 'Similar to: ' || array_to_string(list_slice(p.names, 1, 15), ', ') || {NL} ELSE '' END
       || 'Criteria: ' || concat_ws('; ',
            'genres=' || array_to_string(c.seed_genres, ','), 'artists=' || array_to_string(c.seed_artists, ','),
            'years=' || {_num('c.year_min')} || '-' || {_num('c.year_max')},
            'energy=' || {_num('c.target_energy')}, 'valence=' || {_num('c.target_valence')},
            'tempo=' || {_num('c.target_tempo')}, 'danceability=' || {_num('c.target_danceability')},
            'acousticness=' || {_num('c.target_acousticness')},
            'market=' || c.market, 'limit=' || {_num('c.track_limit')}) AS context
FROM crit_table c JOIN reqp p USING (request_id)
WHERE c.status = 'ok'""")

oracle("l3_title_context", with_(HITS, CRITERIA, CATALOGUE, CAPPED, TOPN, REQUESTS) + f""",
lines AS (
  SELECT t.request_id,
         list('- ' || coalesce(c.name, 'Unknown') || ' — ' || array_to_string(c.artist_names, ', ') ORDER BY t.position) AS ls
  FROM topn t JOIN catalogue c USING (track_id) GROUP BY t.request_id)
SELECT l.request_id,
       array_to_string(list_slice(l.ls, 1, 10), {NL}) || {NL} || 'Request: ' || trim(r.prompt, {_WS}) AS context
FROM lines l JOIN requests r USING (request_id) WHERE length(trim(r.prompt, {_WS})) BETWEEN 5 AND 500""")

# One row per request: criteria, number of queries that ran, title, user and
# prompt; then one pass over the hits.
G3 = f"""
g3_req AS MATERIALIZED (
  SELECT c.request_id, c.status, c.error, c.year_min, c.year_max, c.track_limit, c.seed_genres, c.seed_artists,
         c.target_energy, c.market, coalesce(len(q.qs), 0) AS n_queries, t.title, t.description,
         r.user_id, trim(r.prompt, {_WS}) AS user_prompt, o.o_orderdate AS created_at
  FROM crit_table c LEFT JOIN ql q ON q.request_id = c.request_id
  LEFT JOIN title_rows t ON t.request_id = c.request_id
  LEFT JOIN requests r ON r.request_id = c.request_id LEFT JOIN orders o ON o.o_orderkey = c.request_id),
g3_hits AS MATERIALIZED (
  SELECT h.request_id, h.query_idx, h.hit_rank, h.track_id, coalesce(h.popularity, 0) AS popularity, c.track_limit,
         c.year_min, c.year_max,
         CASE WHEN length(h.release_date) >= 4 THEN TRY_CAST(substr(h.release_date, 1, 4) AS INTEGER) END AS year
  FROM hits h JOIN g3_req c ON c.request_id = h.request_id
  WHERE c.status = 'ok' AND h.hit_rank <= 10 AND h.query_idx <= 6 AND h.query_idx <= c.n_queries
    AND h.status = 'ok' AND h.track_id IS NOT NULL),
g3_first AS MATERIALIZED (
  SELECT request_id, track_id, any_value(track_limit) AS track_limit, any_value(popularity ORDER BY query_idx, hit_rank) AS popularity,
         min(query_idx * 1000 + hit_rank) AS seen
  FROM g3_hits WHERE {YEAR_OK} GROUP BY request_id, track_id),
g3_rank AS (
  SELECT request_id, track_id, track_limit,
         row_number() OVER (PARTITION BY request_id ORDER BY popularity DESC, seen) AS pos FROM g3_first),
g3_lists AS MATERIALIZED (
  SELECT request_id, count(*) AS n, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY pos) AS ids
  FROM g3_rank WHERE pos <= track_limit GROUP BY request_id),
g3 AS (
  SELECT c.* EXCLUDE (status, n_queries),
         CASE WHEN c.status <> 'ok' THEN 'failed' WHEN coalesce(l.n, 0) = 0 THEN 'no_tracks' ELSE 'ok' END AS status,
         CAST(coalesce(l.n, 0) AS INTEGER) AS track_count, coalesce(l.ids, '') AS track_ids
  FROM g3_req c LEFT JOIN g3_lists l ON l.request_id = c.request_id)"""

G3_ALL = with_(HITS, ATTEMPTS, TYPED, FIRST_VALID, QUERY_ROWS, TITLES, REQUESTS, G3)

oracle("g3_playlists", G3_ALL + """
SELECT request_id, user_id, user_prompt, status, error, title, description, track_count, track_ids FROM g3""")

oracle("p12_status", G3_ALL + """
SELECT request_id, status FROM g3""")

oracle("p11_saved_split", with_(PLAYLISTS) + """
SELECT user_id, count(*) FILTER (WHERE external_url IS NOT NULL AND external_url <> '') AS saved,
       count(*) FILTER (WHERE NOT (external_url IS NOT NULL AND external_url <> '')) AS unsaved
FROM playlists GROUP BY user_id""")

_FR = "['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre']"

oracle("g4_history_report", with_(PLAYLISTS) + f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position,
       CASE WHEN starts_with(created_text, 'around') THEN created_text
            ELSE strftime(created_at, '%-d %B %Y') END AS date_text,
       CASE WHEN starts_with(created_text, 'around') THEN created_text
            ELSE day(created_at) || ' ' || {_FR}[month(created_at)] || ' ' || year(created_at) END AS date_fr,
       user_prompt, title, track_count,
       coalesce(external_url IS NOT NULL AND external_url <> '', false) AS saved, id AS relaunch_id
FROM playlists""")

oracle("g5_track_report", with_(HITS, CRITERIA, CATALOGUE, CAPPED, TOPN) + """
SELECT t.request_id, t.position, c.name, array_to_string(c.artist_names, ' · ') AS artists,
       CASE WHEN c.duration_ms > 0
            THEN CAST(floor(floor(c.duration_ms / 1000) / 60) AS BIGINT) || ':' ||
                 lpad(CAST(CAST(floor(c.duration_ms / 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0')
            ELSE '-' END AS duration,
       coalesce(nullif(c.external_url, ''), 'https://open.example.com/track/' || t.track_id) AS link,
       c.image_url
FROM topn t JOIN catalogue c USING (track_id)""")


oracle("g5_relaunch_report", with_(HITS, CRITERIA, CATALOGUE, CAPPED, TOPN, PLAYLISTS) + """
SELECT o_orderkey AS request_id, t.position, c.name, array_to_string(c.artist_names, ' · ') AS artists,
       CASE WHEN c.duration_ms > 0
            THEN CAST(floor(floor(c.duration_ms / 1000) / 60) AS BIGINT) || ':' ||
                 lpad(CAST(CAST(floor(c.duration_ms / 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0')
            ELSE '-' END AS duration,
       coalesce(nullif(c.external_url, ''), 'https://open.example.com/track/' || t.track_id) AS link,
       c.image_url
FROM orders JOIN topn t ON t.request_id = o_orderkey - 3
JOIN playlists p ON p.id = CAST(t.request_id AS VARCHAR) JOIN catalogue c USING (track_id)
WHERE o_orderpriority = '2-HIGH' AND p.created_at >= TIMESTAMP '1998-01-01'""")


# --------------------------------------------------------------------------
# C1 catalogue search, G7, P8
# --------------------------------------------------------------------------

_YR = "year:[0-9]{4}(-[0-9]{4})?"
C1_SQL = f"""
c1_q AS (
  SELECT q.request_id, query_idx, coalesce(k.market, 'FR') AS market,
         regexp_extract_all(lower(query), '(genre|artist):"[^"]*"|\\S+') AS toks
  FROM query_rows q LEFT JOIN criteria k ON k.request_id = q.request_id),
c1_qp AS (
  SELECT request_id, query_idx, market, len(toks) AS nt,
         list_transform(list_filter(toks, lambda t: starts_with(t, 'genre:')), lambda t: replace(substr(t, 7), '"', '')) AS qg,
         list_transform(list_filter(toks, lambda t: starts_with(t, 'artist:')), lambda t: replace(substr(t, 8), '"', '')) AS qa,
         list_filter(toks, lambda t: regexp_full_match(t, '{_YR}')) AS qy,
         list_filter(toks, lambda t: NOT (starts_with(t, 'genre:') OR starts_with(t, 'artist:')
                                          OR regexp_full_match(t, '{_YR}'))) AS qw
  FROM c1_q),
c1_cat AS (
  SELECT p_partkey AS track_id, CAST(floor(p_retailprice) % 100 AS INTEGER) AS popularity,
         [lower(p_type), split_part(p_name, ' ', 1)] AS tg,
         CASE WHEN p_size % 5 = 0 THEN [lower(p_brand), 'guest ' || p_size] ELSE [lower(p_brand)] END AS ta,
         string_split_regex(lower(CASE WHEN p_size % 25 <> 0 THEN p_name || ' ' ELSE '' END || p_type), '\\s+') AS tw,
         p_size + 1975 AS ty,
         list_filter(['FR', 'US', 'DE', 'GB', 'JP'], lambda m, i: i - 1 <> p_partkey % 6 AND i - 1 <> p_size % 9) AS tm
  FROM part),
c1_m AS (
  SELECT q.request_id, q.query_idx, c.track_id, c.popularity
  FROM c1_qp q, c1_cat c
  WHERE q.nt > 0 AND list_contains(c.tm, q.market) AND list_has_all(c.tg, q.qg) AND list_has_all(c.ta, q.qa) AND list_has_all(c.tw, q.qw)
    AND coalesce(list_bool_and(list_transform(q.qy, lambda y:
          c.ty BETWEEN CAST(substr(y, 6, 4) AS INTEGER)
                   AND CAST(coalesce(nullif(substr(y, 11, 4), ''), substr(y, 6, 4)) AS INTEGER))), true)),
c1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id, query_idx ORDER BY popularity DESC, track_id)
                 AS INTEGER) AS hit_rank
  FROM c1_m QUALIFY hit_rank <= 10)"""

oracle("c1_search", with_(ATTEMPTS, CRITERIA, QUERY_ROWS, C1_SQL) + """
SELECT request_id, query_idx, hit_rank, track_id, popularity FROM c1""")

oracle("g7_recommend_post", with_(ATTEMPTS, TYPED, FIRST_VALID, CRITERIA, QUERY_ROWS, CATALOGUE, C1_SQL) + f""",
g7 AS (
  SELECT h.request_id, h.query_idx, h.hit_rank, h.track_id, k.year_min, k.year_max,
         CAST(substr(c.album_release_date, 1, 4) AS INTEGER) AS year, c.*
  FROM c1 h JOIN crit_table k ON k.request_id = h.request_id AND k.status = 'ok'
  JOIN catalogue c ON c.track_id = h.track_id)
SELECT request_id, query_idx, hit_rank, CAST(track_id AS VARCHAR) AS id, uri, name,
       array_to_string(artist_names, ', ') AS artists, album, album_release_date AS release_date,
       duration_ms, preview_url, external_url, image_url
FROM g7 WHERE {YEAR_OK}""")


def _opt(key: str, col: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN '{key}=' || CAST({col} AS VARCHAR) END"


oracle("p8_f3b_params", with_(ATTEMPTS, TYPED, FIRST_VALID) + f"""
SELECT request_id, concat_ws('&',
         CASE WHEN len(seed_genres) > 0 THEN 'seed_genres=' || array_to_string(seed_genres, ',') END,
         CASE WHEN len(list_slice(seed_artists, 1, greatest(0, 5 - len(seed_genres)))) > 0
              THEN 'seed_artists=' || array_to_string(list_slice(seed_artists, 1, greatest(0, 5 - len(seed_genres))), ',') END,
         {_opt('limit', 'track_limit')}, {_opt('country', 'market')},
         {_opt('target_energy', 'target_energy')}, {_opt('target_valence', 'target_valence')},
         {_opt('target_tempo', 'target_tempo')}, {_opt('target_danceability', 'target_danceability')},
         {_opt('target_acousticness', 'target_acousticness')}) AS params
FROM crit_table WHERE status = 'ok'""")


# --------------------------------------------------------------------------
# R1-R7 analytics marts
# --------------------------------------------------------------------------

TRACK_FEATURES = """
tfeat AS (
  SELECT p_partkey AS track_id, lower(p_type) AS genre, CAST(p_size AS DOUBLE) / 50.0 AS energy,
         CAST(p_partkey % 100 AS DOUBLE) / 100.0 AS valence, p_retailprice / 10.0 AS tempo,
         CAST(p_partkey * 7 % 100 AS DOUBLE) / 100.0 AS danceability,
         CAST(p_partkey * 3 % 100 AS DOUBLE) / 100.0 AS acousticness
  FROM part)"""

oracle("r1_profile_by_month", f"""
WITH lf AS (
  SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month,
         NULLIF(l_discount, 0) * 10 AS energy, NULLIF(l_tax, 0) * 12.5 AS valence,
         NULLIF(l_partkey % 11, 0) / 10.0::DOUBLE AS danceability,
         NULLIF(l_suppkey % 6, 0) / 5.0::DOUBLE AS acousticness, NULLIF(l_quantity, 1) AS tempo
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT user_id, month, count(*) AS n_lines,
       coalesce({_mean3('energy')}, 0.5) AS energy, coalesce({_mean3('valence')}, 0.5) AS valence,
       coalesce({_mean3('danceability')}, 0.5) AS danceability,
       coalesce({_mean3('acousticness')}, 0.5) AS acousticness, coalesce({_mean3('tempo')}, 120.0) AS tempo
FROM lf GROUP BY user_id, month""")

oracle("r2_genre_evolution", with_(TRACK_FEATURES) + """,
g AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS month, t.genre, count(*) AS plays
  FROM lineitem JOIN tfeat t ON t.track_id = l_partkey GROUP BY 1, 2),
s AS (SELECT *, plays / sum(plays) OVER (PARTITION BY month) AS share FROM g)
SELECT month, genre, plays, share, lag(share) OVER (PARTITION BY genre ORDER BY month) AS prev_share,
       share - lag(share) OVER (PARTITION BY genre ORDER BY month) AS delta
FROM s""")

oracle("r3_mood", """
WITH e AS (
  SELECT CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring'
              WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
         CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, value
  FROM events)
SELECT season, weekday, hour, GROUPING(season, weekday, hour) AS level, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS mean_value
FROM e GROUP BY ROLLUP (season, weekday, hour)""")

_FIVE = ("energy", "valence", "danceability", "acousticness", "tempo")

oracle("r4_silver", with_(TRACK_FEATURES) + f""",
st AS (SELECT {", ".join(f"min({c}) AS {c}_0, max({c}) AS {c}_1" for c in _FIVE)} FROM tfeat),
fam AS (SELECT * FROM (VALUES ('economy', 'value'), ('promo', 'value'), ('small', 'compact'),
                              ('medium', 'compact'), ('large', 'full'), ('standard', 'full')) v(genre, family))
SELECT f.genre, f.track_id, {", ".join(f"(f.{c} - st.{c}_0) / (st.{c}_1 - st.{c}_0) AS {c}_n" for c in _FIVE)},
       coalesce(fam.family, 'other') AS family
FROM tfeat f CROSS JOIN st LEFT JOIN fam ON fam.genre = f.genre""")


def _unique(table: str, key: str, name: str) -> str:
    return (f"SELECT '{name}.{key} unique' AS \"check\", CAST(count({key}) - count(DISTINCT {key}) AS BIGINT) AS failed FROM {table}")


def _not_null(table: str, column: str, name: str) -> str:
    return f"SELECT '{name}.{column} not null', count(*) FILTER (WHERE {column} IS NULL) FROM {table}"


def _range(table: str, column: str, name: str) -> str:
    if column == "tempo":
        return f"SELECT '{name}.tempo in [0,inf]', count(*) FILTER (WHERE tempo < 0) FROM {table}"
    return f"SELECT '{name}.{column} in [0,1]', count(*) FILTER (WHERE NOT ({column} BETWEEN 0 AND 1)) FROM {table}"


def _reference(table: str, column: str, other: str, key: str, name: str) -> str:
    return (f"SELECT '{name}', count(*) FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {other})")


oracle("r5_quality", with_(PLAYLISTS, TRACK_FEATURES, FEATURES) + "\n" + "\nUNION ALL ".join([
    _unique("playlists", "id", "playlists"), _unique("tfeat", "track_id", "tracks"), _unique("events", "event_id", "events"),
    _unique("customer", "c_custkey", "customer"), _unique("supplier", "s_suppkey", "supplier"),
    *[_not_null("playlists", c, "playlists") for c in ("id", "user_id", "created_at", "title")],
    *[_not_null("tfeat", c, "tracks") for c in ("track_id", "genre")], _not_null("lf", "user_id", "listens"),
    *[_not_null("events", c, "events") for c in ("event_id", "ts", "user_id")],
    *[_not_null("customer", c, "customer") for c in ("c_custkey", "c_nationkey")], _not_null("supplier", "s_suppkey", "supplier"),
    *[_range(t, c, n) for t, n in (("tfeat", "tracks"), ("lf", "listens")) for c in _FIVE],
    _reference("lineitem", "l_partkey", "part", "p_partkey", "lineitem.partkey -> part"),
    _reference("lineitem", "l_suppkey", "supplier", "s_suppkey", "lineitem.suppkey -> supplier"),
    _reference("lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem.orderkey -> orders"),
    _reference("orders", "o_custkey", "customer", "c_custkey", "orders.custkey -> customer"),
    _reference("events", "user_id", "customer", "c_custkey", "events.user_id -> customer"),
    _reference("customer", "c_nationkey", "nation", "n_nationkey", "customer.nationkey -> nation")]))

oracle("r6_catalogue", with_(ATTEMPTS, TYPED, FIRST_VALID, TRACK_FEATURES) + """,
pop AS (SELECT p_partkey AS track_id, CAST(floor(p_retailprice) AS BIGINT) % 100 AS popularity FROM part),
sets AS (SELECT DISTINCT target_energy, target_valence, target_tempo, target_danceability, target_acousticness
         FROM crit_table WHERE status = 'ok'),
terms AS (
  SELECT s.*, f.track_id, p.popularity, pow(s.target_energy - f.energy, 2) AS te, pow(s.target_valence - f.valence, 2) AS tv,
         pow((s.target_tempo - f.tempo) / 200.0, 2) AS tt, pow(s.target_danceability - f.danceability, 2) AS td,
         pow(s.target_acousticness - f.acousticness, 2) AS ta
  FROM sets s, tfeat f JOIN pop p ON p.track_id = f.track_id),
scored AS (
  SELECT *, CASE WHEN n > 0 THEN (coalesce(te, 0.0) + coalesce(tv, 0.0) + coalesce(tt, 0.0) + coalesce(td, 0.0)
                                  + coalesce(ta, 0.0)) / n ELSE 0.0 END AS score
  FROM (SELECT *, len(list_filter([te, tv, tt, td, ta], lambda x: x IS NOT NULL)) AS n FROM terms)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY target_energy, target_valence, target_tempo, target_danceability,
                               target_acousticness ORDER BY score, popularity DESC, track_id) AS pos
  FROM scored QUALIFY pos <= 100)
SELECT c.request_id, b.track_id, b.score, CAST(b.pos AS INTEGER) AS position
FROM crit_table c JOIN best b ON b.target_energy IS NOT DISTINCT FROM c.target_energy
 AND b.target_valence IS NOT DISTINCT FROM c.target_valence AND b.target_tempo IS NOT DISTINCT FROM c.target_tempo
 AND b.target_danceability IS NOT DISTINCT FROM c.target_danceability
 AND b.target_acousticness IS NOT DISTINCT FROM c.target_acousticness
WHERE c.status = 'ok' AND b.pos <= c.track_limit""")

oracle("r6_score", with_(HITS, ATTEMPTS, TYPED, FIRST_VALID, TRACK_FEATURES) + f""",
r6_capped AS (
  SELECT h.*, c.year_min, c.year_max, c.track_limit, c.target_energy, c.target_valence, c.target_tempo,
         c.target_danceability, c.target_acousticness,
         CASE WHEN length(h.release_date) >= 4 THEN TRY_CAST(substr(h.release_date, 1, 4) AS INTEGER) END AS year
  FROM hits h JOIN crit_table c ON c.request_id = h.request_id AND c.status = 'ok'
  WHERE h.hit_rank <= 10 AND h.query_idx <= 6 AND h.status = 'ok' AND h.track_id IS NOT NULL),
r6_dedup AS (
  SELECT * FROM r6_capped WHERE {YEAR_OK}
  QUALIFY row_number() OVER (PARTITION BY request_id, track_id ORDER BY query_idx, hit_rank) = 1),
r6_terms AS (
  SELECT d.*, (d.target_energy - f.energy) * (d.target_energy - f.energy) AS te,
         (d.target_valence - f.valence) * (d.target_valence - f.valence) AS tv,
         ((d.target_tempo - f.tempo) / 200.0) * ((d.target_tempo - f.tempo) / 200.0) AS tt,
         (d.target_danceability - f.danceability) * (d.target_danceability - f.danceability) AS td,
         (d.target_acousticness - f.acousticness) * (d.target_acousticness - f.acousticness) AS ta
  FROM r6_dedup d JOIN tfeat f ON f.track_id = d.track_id),
r6_s AS (
  SELECT *, CASE WHEN n > 0 THEN (coalesce(te, 0.0) + coalesce(tv, 0.0) + coalesce(tt, 0.0) + coalesce(td, 0.0)
                                  + coalesce(ta, 0.0)) / n ELSE 0.0 END AS score
  FROM (SELECT *, len(list_filter([te, tv, tt, td, ta], lambda x: x IS NOT NULL)) AS n FROM r6_terms)),
r6_r AS (
  SELECT request_id, track_id, score, track_limit,
         CAST(row_number() OVER (PARTITION BY request_id ORDER BY score, coalesce(popularity, 0) DESC,
                                 query_idx, hit_rank) AS INTEGER) AS position
  FROM r6_s)
SELECT request_id, track_id, score, position FROM r6_r WHERE position <= track_limit""")

oracle("r7_dna", with_(ARTIST_ITEMS, TOP_RAW, W2, GENRES, FEATURES) + """,
ph AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
fav AS (SELECT user_id, hour AS fav_hour FROM ph
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) = 1),
tot AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n_events FROM ph GROUP BY user_id)
SELECT t.user_id, t.n_events, f.fav_hour, g.genre AS top_genre, ft.energy, ft.valence, ft.danceability,
       ft.acousticness, ft.tempo
FROM tot t JOIN fav f USING (user_id)
LEFT JOIN (SELECT user_id, genre FROM genres WHERE genre_rank = 1) g USING (user_id)
LEFT JOIN feat ft USING (user_id)""")


# --------------------------------------------------------------------------
# X1-X4 streaming: batch equivalents (closed windows only)
# --------------------------------------------------------------------------

oracle("x1_ingest", """
SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id, ts AS played_at
FROM events""")

oracle("x1_counts", """
WITH e AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id, ts,
         ts < TIMESTAMP '2024-01-16' AS early, event_id % 97 = 5 AS held FROM events),
sent AS (
  SELECT *, 0 AS batch FROM e WHERE early AND NOT held
  UNION ALL SELECT *, 0 FROM e WHERE early AND NOT held AND event_id % 10 = 0
  UNION ALL SELECT *, 1 FROM e WHERE NOT early
  UNION ALL SELECT *, 1 FROM e WHERE NOT early AND event_id % 10 = 0
  UNION ALL SELECT *, 1 FROM e WHERE early AND NOT held AND event_id % 10 = 1
  UNION ALL SELECT *, 2 FROM e WHERE early AND held
  UNION ALL SELECT *, 2 FROM e WHERE early AND held AND event_id % 10 = 0
  UNION ALL SELECT *, 2 FROM e WHERE early AND NOT held AND event_id % 10 = 2),
newest AS (SELECT batch, max(ts) AS m FROM sent GROUP BY batch),
mark AS (SELECT a.batch, max(b.m) - INTERVAL 1 HOUR AS mark FROM newest a LEFT JOIN newest b ON b.batch < a.batch GROUP BY a.batch),
firsts AS (SELECT min(batch) AS batch FROM sent GROUP BY user_id, track_id, ts),
new AS (SELECT batch, count(*) AS n_new FROM firsts GROUP BY batch)
SELECT CAST(s.batch AS BIGINT) AS batch, count(*) AS n_rows, count(*) FILTER (WHERE s.ts < m.mark) AS n_late,
       CAST(coalesce(any_value(n.n_new), 0) AS BIGINT) AS n_new,
       CAST(count(*) - coalesce(any_value(n.n_new), 0) AS BIGINT) AS n_repeats
FROM sent s JOIN mark m ON m.batch = s.batch LEFT JOIN new n ON n.batch = s.batch GROUP BY s.batch""")

oracle("x2_refresh", with_(CATALOGUE, ARTIST_ITEMS, TOP_RAW, W1, W2, GENRES, FEATURES, PROFILE) + """
SELECT user_id, top_genres, top_artists, top_tracks, energy, valence, danceability, acousticness, tempo
FROM prof WHERE user_id IN (SELECT user_id FROM events)""")

oracle("x3_daily", """
WITH wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
d AS (
  SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
         event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_value
  FROM events GROUP BY 1, 2, 3)
SELECT *, window_end <= (SELECT wm FROM wm) AS closed FROM d""")

oracle("x4_sessions", """
WITH wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
e AS (
  SELECT user_id, ts,
         CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE
              THEN 1 ELSE 0 END AS starts
  FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events
      FROM s GROUP BY user_id, sid)
SELECT *, session_end <= (SELECT wm FROM wm) AS closed FROM g""")


# --------------------------------------------------------------------------
# S5 append rows, S13 JSON edge
# --------------------------------------------------------------------------

oracle("s5_append", G3_ALL + """,
h AS (SELECT *, sha256('playlist:' || request_id) AS hx FROM g3 WHERE status = 'ok')
SELECT substr(hx, 1, 8) || '-' || substr(hx, 9, 4) || '-' || substr(hx, 13, 4) || '-' || substr(hx, 17, 4)
       || '-' || substr(hx, 21, 12) AS id, request_id, CAST(year(created_at) AS INTEGER) AS batch_id, user_id,
       created_at, user_prompt, title, description, track_count, track_ids,
       array_to_string(seed_genres, ',') AS seed_genres, array_to_string(seed_artists, ',') AS seed_artists,
       year_min, year_max, target_energy, market, track_limit
FROM h""")

oracle("s15_bronze", with_(HITS) + """,
seen AS (SELECT *, (request_id + query_idx) % 37 = 0 AS cut FROM hits WHERE hit_rank <= 10 AND query_idx <= 6),
per_query AS (
  SELECT request_id, query_idx, any_value(cut) AS cut, any_value(status) AS status,
         count(*) FILTER (WHERE track_id IS NULL) AS nulls, count(track_id) AS usable,
         count(*) FILTER (WHERE track_id IS NOT NULL AND TRY_CAST(substr(release_date, 1, 4) AS INTEGER) IS NULL) AS bad_years
  FROM seen GROUP BY request_id, query_idx)
SELECT request_id, CAST(count(*) FILTER (WHERE cut) AS BIGINT) AS bad_lines,
       CAST(count(*) FILTER (WHERE NOT cut AND status <> 'ok') AS BIGINT) AS failed_queries,
       CAST(coalesce(sum(nulls) FILTER (WHERE NOT cut AND status = 'ok'), 0) AS BIGINT) AS null_items,
       CAST(coalesce(sum(bad_years) FILTER (WHERE NOT cut AND status = 'ok'), 0) AS BIGINT) AS bad_years,
       CAST(coalesce(sum(usable) FILTER (WHERE NOT cut AND status = 'ok'), 0) AS BIGINT) AS usable
FROM per_query GROUP BY request_id""")

oracle("s1_tables", with_(HITS, CRITERIA, CATALOGUE, CAPPED, TOPN, PLAYLISTS) + """,
lists AS (SELECT request_id, count(*) AS n, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY position) AS ids
          FROM topn GROUP BY request_id)
SELECT p.id, p.user_id, CAST(year(p.created_at) AS INTEGER) AS year, p.title,
       CAST(CASE WHEN year(p.created_at) < 1998 THEN 0 ELSE coalesce(l.n, 0) END AS INTEGER) AS n_tracks,
       CASE WHEN year(p.created_at) < 1998 THEN '' ELSE coalesce(l.ids, '') END AS track_ids
FROM playlists p LEFT JOIN lists l ON p.id = CAST(l.request_id AS VARCHAR)""")

ORACLES["s3_bucketed"] = ORACLES["s3_upsert"]
ORACLES["s7_bucketed"] = ORACLES["s7_update"]

oracle("s9_lookup", with_(PLAYLISTS) + """,
newest AS (SELECT id, user_id, created_at, title FROM playlists
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1),
asked AS (SELECT min(id) AS asked FROM newest UNION ALL SELECT max(id) FROM newest UNION ALL SELECT 'none')
SELECT a.asked, n.user_id, n.created_at, n.title FROM asked a LEFT JOIN newest n ON n.id = a.asked""")

oracle("s13_json_edge", with_(HITS, CRITERIA, CAPPED, TOPN) + """
SELECT request_id, CAST(count(*) AS INTEGER) AS n_tracks, true AS roundtrip_ok FROM topn GROUP BY request_id""")

oracle("x4_sessions_batch", """
WITH e AS (
  SELECT user_id, ts,
         CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE
              THEN 1 ELSE 0 END AS starts, event_id
  FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events
FROM s GROUP BY user_id, sid""")
