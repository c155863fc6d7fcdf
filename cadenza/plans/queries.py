"""Registered queries: one per operator of SURVEY §2, each a function
``(spark, sf_dir) -> DataFrame`` over the stand-in tables.

The jobs return native arrays and structs; registered queries flatten them
to text (``array_join``) only at the end, so that results compare with the
SQL oracle (T10).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.columns import DEFAULT_MARKET, strip_ws, year_in_range, year_of
from cadenza.operators import candidates as G1
from cadenza.operators import profile as P
from cadenza.operators import responses as R
from cadenza.sources import replies as SR
from cadenza.sources import standins as S
from cadenza.sources.tables import read_table, table_path
from cadenza.operators import store as ST
from cadenza import schemas as SC
from cadenza.operators import prompts as PR
from cadenza.operators import reports as RP
from cadenza.operators import search as C1
from cadenza.operators import recommend as RC
from cadenza.operators import marts as M
from cadenza.streaming import streams as X
from cadenza.sources import bronze as BZ
from cadenza.operators import catalog as CT
from cadenza.operators import similar as SI
from cadenza.operators import cursor as CU
from cadenza.operators import profile_state as PS
from cadenza.operators import sessions as SE
from cadenza.session import checkpoint_dir, written

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


# --------------------------------------------------------------------------
# G1 candidate selection and its parts
# --------------------------------------------------------------------------

def _capped(spark, d):
    return G1.usable_hits(G1.cap_hits(S.search_hits(spark, d)))


@register("g1_candidates")
def g1_candidates(spark, d):
    out = G1.select_candidates(S.search_hits(spark, d), S.criteria(spark, d), S.catalogue(spark, d))
    return out.withColumn("artists", F.array_join("artists", ", "))


@register("w5_query_cap")
def w5_query_cap(spark, d):
    return G1.cap_hits(S.search_hits(spark, d)).select("request_id", "query_idx", "hit_rank", "track_id")


@register("p4_p5_year_filter")
def p4_p5_year_filter(spark, d):
    crit = S.criteria(spark, d).select("request_id", "year_min", "year_max")
    j = G1.by_request(_capped(spark, d)).join(crit, "request_id")
    year = year_of(F.col("release_date"))
    return j.select("request_id", "query_idx", "hit_rank", "track_id", "release_date",
                    year.alias("year"),
                    year_in_range(year, F.col("year_min"), F.col("year_max")).alias("kept"))


@register("s12_skipped")
def s12_skipped(spark, d):
    return G1.skipped_hits(G1.cap_hits(S.search_hits(spark, d)))


@register("w4_dedupe_hits")
def w4_dedupe_hits(spark, d):
    kept = G1.filter_years(G1.by_request(_capped(spark, d)), S.criteria(spark, d))
    return G1.dedupe_hits(kept).select("request_id", "query_idx", "hit_rank", "track_id")


@register("k1_top_n")
def k1_top_n(spark, d):
    kept = G1.filter_years(G1.by_request(_capped(spark, d)), S.criteria(spark, d))
    top = G1.top_n(G1.dedupe_hits(kept))
    return top.select("request_id", "position", "track_id", "popularity", "query_idx", "hit_rank")


# --------------------------------------------------------------------------
# G2 profile build and its parts
# --------------------------------------------------------------------------

def _tracks(spark, d):
    return P.top_tracks(S.top_items_raw(spark, d), S.track_items(spark, d))


def _artists(spark, d):
    return P.top_artists(S.top_items_raw(spark, d), S.artist_items(spark, d))


@register("w1_top_tracks")
def w1_top_tracks(spark, d):
    t = _tracks(spark, d)
    return t.select("user_id", "id", "name", F.array_join("artists", ", ").alias("artists"),
                    "uri", "time_range", "term_ord", "rank")


@register("w2_top_artists")
def w2_top_artists(spark, d):
    a = _artists(spark, d)
    return a.select("user_id", "id", "name", F.array_join("genres", ",").alias("genres"),
                    "uri", "time_range", "term_ord", "rank")


@register("w3_recent_plays")
def w3_recent_plays(spark, d):
    return P.recent_plays(S.plays(spark, d)).select("user_id", "track_id", "played_at", "event_id")


#: Times at which the plays so far are polled.
POLLS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00", "2100-01-01 00:00:00")


@register("s11_cursor")
def s11_cursor(spark, d):
    path = f"{checkpoint_dir(spark)}/cursors-{uuid.uuid4().hex}"
    out = None
    for number, until in enumerate(POLLS):
        so_far = S.plays(spark, d).where(F.col("played_at") < F.lit(until).cast("timestamp"))
        pages = CU.poll(so_far, path, number).withColumn("poll", F.lit(number))
        out = pages if out is None else out.unionByName(pages)
    return out.select("poll", "user_id", "page", "position", "track_id", "played_at", "event_id")


@register("a1_k3_genres")
def a1_k3_genres(spark, d):
    return P.genre_ranking(_artists(spark, d)).select("user_id", "genre", "n_artists", "genre_rank")


@register("a2_feature_avg")
def a2_feature_avg(spark, d):
    return P.feature_means(S.line_features(spark, d), S.users(spark, d))


@register("a4_collect_tracks")
def a4_collect_tracks(spark, d):
    lists = P.collect_ordered(_tracks(spark, d), "user_id", ["term_ord", "rank"], F.col("id"))
    return lists.select("user_id", F.size("items").alias("n_tracks"),
                        F.array_join("items", ",").alias("track_ids"))


def _profiles(spark, d):
    return P.build_profiles(S.top_items_raw(spark, d), S.track_items(spark, d),
                            S.artist_items(spark, d), S.line_features(spark, d),
                            S.users(spark, d), F.current_timestamp())


def _flat_features(col="audio_features_avg"):
    return [F.col(f"{col}.{c}").alias(c) for c in P.FEATURES]


@register("g2_profile")
def g2_profile(spark, d):
    p = _profiles(spark, d)
    return p.select(
        "user_id",
        F.array_join("top_genres", ",").alias("top_genres"),
        F.array_join(F.transform("top_artists", lambda a: a["name"]), ",").alias("top_artists"),
        F.array_join(F.transform("top_tracks", lambda t: t["id"]), ",").alias("top_tracks"),
        *_flat_features())


@register("p10_profile_summary")
def p10_profile_summary(spark, d):
    s = P.profile_summary(_profiles(spark, d))
    return s.select("user_id", F.array_join("genres", ",").alias("genres"),
                    "artists_count", "tracks_count", *_flat_features())


# --------------------------------------------------------------------------
# Model replies -> criteria, queries, titles
# --------------------------------------------------------------------------

def _criteria_once(spark, d, *columns):
    """The criteria table written once, all columns or those named, for queries
    that join it more than once: each branch would type every reply again."""
    t = R.criteria_table(SR.llm_attempts(spark, d))
    return written(t.select("request_id", "status", *columns) if columns else t, "criteria")


def _criteria_text(df):
    return df.withColumn("seed_genres", F.array_join("seed_genres", ",")) \
             .withColumn("seed_artists", F.array_join("seed_artists", ","))


@register("f1_f2_criteria")
def f1_f2_criteria(spark, d):
    return _criteria_text(R.typed_attempts(SR.llm_attempts(spark, d)))


@register("w7_first_valid")
def w7_first_valid(spark, d):
    t = R.criteria_table(SR.llm_attempts(spark, d))
    return t.select("request_id", "status", "attempt", "error")


@register("l4_criteria")
def l4_criteria(spark, d):
    return _criteria_text(R.criteria_table(SR.llm_attempts(spark, d)))


@register("l4_quarantine")
def l4_quarantine(spark, d):
    return R.quarantine(SR.llm_attempts(spark, d))


@register("f3_seed_clamp")
def f3_seed_clamp(spark, d):
    t = R.criteria_table(SR.llm_attempts(spark, d)).where(F.col("status") == "ok")
    return t.select("request_id", F.size("seed_genres").alias("n_genres"),
                    F.size("seed_artists").alias("n_artists"),
                    F.array_join("seed_genres", ",").alias("seed_genres"),
                    F.array_join("seed_artists", ",").alias("seed_artists"))


@register("f4_queries")
def f4_queries(spark, d):
    return R.query_rows(SR.llm_attempts(spark, d))


@register("f5_titles")
def f5_titles(spark, d):
    return R.titles(SR.llm_attempts(spark, d))


# --------------------------------------------------------------------------
# Store jobs: S2 S3 S6 S7 S8 S9/J2 S14 G6
# --------------------------------------------------------------------------

def _candidate_lists(spark, d, key="request_id", fields=SC.SELECTED_TRACK.names):
    sel = G1.select_candidates(S.search_hits(spark, d), S.criteria(spark, d), S.catalogue(spark, d))
    # by the text of the request's id, where the lists are joined by it: one exchange for both
    keyed = sel if key == "request_id" else sel.withColumn(key, F.col("request_id").cast("string"))
    return P.collect_ordered(keyed, key, ["position"], F.struct(*fields)).withColumnRenamed("items", "tracks")


def _stored_playlists(spark, d, *fields):
    """The playlists table after S2: old rows without tracks, new ones with theirs.
    ``fields``: those of a track that the query reads, if not all; Spark does not
    prune a list's elements through the aggregate that makes it."""
    pl = S.playlists(spark, d)
    cut = F.col("created_at") < F.lit("1998-01-01 00:00:00").cast("timestamp")
    old = pl.where(cut)
    lists = _candidate_lists(spark, d, "list_of", fields or SC.SELECTED_TRACK.names)
    new = pl.where(~cut).join(lists, F.col("id") == F.col("list_of"), "left").drop("list_of")
    return ST.evolve_tracks(old, new)


@register("s2_schema_evolution")
def s2_schema_evolution(spark, d):
    ev = _stored_playlists(spark, d, "id")
    return ev.select("id", F.size("tracks").alias("n_tracks"),
                     F.array_join(F.transform("tracks", lambda t: t["id"]), ",").alias("track_ids"))


@register("s3_upsert")
def s3_upsert(spark, d):
    existing, writes = S.profile_writes(spark, d)
    return ST.upsert_latest(existing, writes, "user_id").select("user_id", "n_events", "synced_at")


@register("s6_history")
def s6_history(spark, d):
    h = ST.history(S.playlists(spark, d))
    return h.select("user_id", "id", "created_at", "position")


@register("s7_update")
def s7_update(spark, d):
    out = ST.apply_link_updates(S.playlists(spark, d), S.link_updates(spark, d))
    return out.select("id", "external_id", "external_url")


@register("s8_delete")
def s8_delete(spark, d):
    return ST.delete_playlists(S.playlists(spark, d), S.deletions(spark, d)).select("id", "user_id")


@register("g6_delete_counts")
def g6_delete_counts(spark, d):
    return ST.deletion_counts(S.playlists(spark, d), S.deletions(spark, d))


@register("j2_relaunch")
def j2_relaunch(spark, d):
    req = S.relaunch_requests(spark, d)
    j = ST.lookup(_stored_playlists(spark, d, "id").select("id", "title", "track_count", "tracks"), req)
    ids = F.array_join(F.transform("tracks", lambda t: t["id"]), ",")
    return j.select("request_id", F.col("title").alias("prior_title"),
                    F.coalesce("track_count", F.lit(0)).alias("prior_track_count"),
                    F.coalesce(ids, F.lit("")).alias("prior_track_ids"))


@register("s14_batches")
def s14_batches(spark, d):
    li = read_table(spark, d, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    tracks = li.withColumn("uri", F.concat(F.lit("track:"), F.col("l_partkey").cast("string")))
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
                                "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")]
    b = ST.track_batches(tracks, "l_suppkey", order)
    return b.select("l_suppkey", "batch_no", "batch_size", "first_pos", "last_pos",
                    F.array_join("uris", ",").alias("uris"))


# --------------------------------------------------------------------------
# Requests, prompt contexts, playlist build and reports
# --------------------------------------------------------------------------

def _synced_profiles(spark, d):
    return _profiles(spark, d).join(S.synced_users(spark, d), "user_id", "left_semi")


def _req_profiles(spark, d):
    return PR.with_profile(PR.accepted(S.requests(spark, d)), _synced_profiles(spark, d))


@register("p9_request_check")
def p9_request_check(spark, d):
    return PR.check_requests(S.requests(spark, d)).select("request_id", "check", "prompt_clean")


@register("j1_request_profile")
def j1_request_profile(spark, d):
    j = _req_profiles(spark, d)
    return j.select("request_id", "user_id", "has_profile",
                    F.coalesce(F.size("top_artists"), F.lit(0)).alias("n_artists"),
                    F.coalesce(F.size("top_tracks"), F.lit(0)).alias("n_tracks"))


@register("l1_context")
def l1_context(spark, d):
    return PR.criteria_context(_req_profiles(spark, d))


@register("l2_query_context")
def l2_query_context(spark, d):
    crit = R.criteria_table(SR.llm_attempts(spark, d)).where(F.col("status") == "ok")
    return PR.query_context(crit, _req_profiles(spark, d))


def _g1_lists(spark, d):
    sel = G1.select_candidates(S.search_hits(spark, d), S.criteria(spark, d), S.catalogue(spark, d))
    return P.collect_ordered(sel, "request_id", ["position"], F.struct("name", "artists")) \
        .withColumnRenamed("items", "tracks")


@register("l3_title_context")
def l3_title_context(spark, d):
    return PR.title_context(_g1_lists(spark, d), PR.accepted(S.requests(spark, d)))


def _g3(spark, d):
    att = SR.llm_attempts(spark, d)
    crit = _criteria_once(spark, d, "error", "year_min", "year_max", "track_limit")
    return RP.build_playlists(S.search_hits(spark, d), crit, R.query_rows(att), R.titles(att), S.catalogue(spark, d))


@register("g3_playlists")
def g3_playlists(spark, d):
    # the record with user and prompt (D10), also of the requests that got none
    asked = S.requests(spark, d).select("request_id", "user_id", strip_ws(F.col("prompt")).alias("user_prompt"))
    g = _g3(spark, d).join(asked, "request_id", "left")
    return g.select("request_id", "user_id", "user_prompt", "status", "error", "title", "description", "track_count",
                    F.array_join(F.transform("tracks", lambda t: t["id"]), ",").alias("track_ids"))


@register("p12_status")
def p12_status(spark, d):
    return _g3(spark, d).select("request_id", "status")


@register("p11_saved_split")
def p11_saved_split(spark, d):
    return RP.saved_split(S.playlists(spark, d))


@register("g4_history_report")
def g4_history_report(spark, d):
    return RP.history_report(S.playlists(spark, d))


@register("g5_track_report")
def g5_track_report(spark, d):
    sel = G1.select_candidates(S.search_hits(spark, d), S.criteria(spark, d), S.catalogue(spark, d))
    return RP.track_report(sel)


@register("g5_relaunch_report")
def g5_relaunch_report(spark, d):
    return RP.relaunch_report(_stored_playlists(spark, d, *RP.REPORTED), S.relaunch_requests(spark, d))


# --------------------------------------------------------------------------
# C1 catalogue search, G7 recommendation post-processing, P8 parameters
# --------------------------------------------------------------------------

def _c1_queries(spark, d):
    market = S.criteria(spark, d).select("request_id", "market")
    return R.query_rows(SR.llm_attempts(spark, d)).join(market, "request_id", "left") \
        .withColumn("market", F.coalesce("market", F.lit(DEFAULT_MARKET)))


def _c1(spark, d):
    return C1.search(_c1_queries(spark, d), S.catalogue(spark, d))


@register("c1_search")
def c1_search(spark, d):
    return _c1(spark, d).select("request_id", "query_idx", "hit_rank", "track_id", "popularity")


@register("g7_recommend_post")
def g7_recommend_post(spark, d):
    crit = R.criteria_table(SR.llm_attempts(spark, d)).where(F.col("status") == "ok")
    cat = S.catalogue(spark, d)
    # a query row becomes up to ten: its bounds and its hits' fields are joined before
    recs = C1.search(RC.with_bounds(_c1_queries(spark, d), crit), cat, RC.BOUNDS, lambda hits: RC.with_details(hits, cat))
    out = RC.recommend_post(recs, crit, cat)
    return out.withColumn("artists", F.array_join("artists", ", "))


@register("p8_f3b_params")
def p8_f3b_params(spark, d):
    crit = R.criteria_table(SR.llm_attempts(spark, d)).where(F.col("status") == "ok")
    return RC.call_params(crit)


# --------------------------------------------------------------------------
# R1-R7 analytics marts
# --------------------------------------------------------------------------

@register("r1_profile_by_month")
def r1_profile_by_month(spark, d):
    return M.profile_by_month(S.line_features(spark, d))


@register("r2_genre_evolution")
def r2_genre_evolution(spark, d):
    li = read_table(spark, d, "lineitem", ["l_partkey", "l_shipdate"])
    plays = li.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_partkey").alias("track_id"))
    genres = S.track_features(spark, d).select("track_id", "genre")
    return M.genre_evolution(plays, genres)


@register("r3_mood")
def r3_mood(spark, d):
    return M.mood_patterns(read_table(spark, d, "events", ["ts", "value"]))


@register("r4_silver")
def r4_silver(spark, d):
    return M.silver_tracks(S.track_features(spark, d), M.genre_lookup(spark))


@register("r5_quality")
def r5_quality(spark, d):
    def raw(name, *columns):
        return read_table(spark, d, name, list(columns))
    lines = raw("lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    orders, parts = raw("orders", "o_orderkey", "o_custkey"), raw("part", "p_partkey")
    users = raw("customer", "c_custkey", "c_nationkey")
    return M.quality_checks(
        {"playlists": (S.playlists(spark, d), "id", ["user_id", "created_at", "title"]),
         "tracks": (S.track_features(spark, d), "track_id", ["genre"], M.RANGES),
         "listens": (S.line_features(spark, d), None, ["user_id"], M.RANGES),
         "events": (raw("events", "event_id", "ts", "user_id"), "event_id", ["ts", "user_id"]),
         "customer": (users, "c_custkey", ["c_nationkey"]), "supplier": (raw("supplier", "s_suppkey"), "s_suppkey")},
        [(lines, "l_partkey", parts, "p_partkey", "lineitem.partkey -> part"),
         (lines, "l_suppkey", raw("supplier", "s_suppkey"), "s_suppkey", "lineitem.suppkey -> supplier"),
         (lines, "l_orderkey", orders, "o_orderkey", "lineitem.orderkey -> orders"),
         (orders, "o_custkey", users, "c_custkey", "orders.custkey -> customer"),
         (raw("events", "user_id"), "user_id", users, "c_custkey", "events.user_id -> customer"),
         (users, "c_nationkey", raw("nation", "n_nationkey"), "n_nationkey", "customer.nationkey -> nation")])


@register("r6_catalogue")
def r6_catalogue(spark, d):
    crit = R.criteria_table(SR.llm_attempts(spark, d)).where(F.col("status") == "ok")
    tracks = S.track_features(spark, d).join(S.catalogue(spark, d).select("track_id", "popularity"), "track_id")
    return SI.nearest_tracks(written(crit.select("request_id", "track_limit", *SI.TARGETS), "criteria"), written(tracks, "features"))


@register("r6_score")
def r6_score(spark, d):
    crit = _criteria_once(spark, d).where(F.col("status") == "ok")
    kept = G1.filter_years(G1.by_request(_capped(spark, d)), crit)
    out = M.score_candidates(G1.dedupe_hits(kept), crit, S.track_features(spark, d))
    return out.select("request_id", "track_id", "score", "position")


@register("r7_dna")
def r7_dna(spark, d):
    return M.music_dna(P.genre_ranking(_artists(spark, d)),
                       P.feature_means(S.line_features(spark, d), S.users(spark, d)),
                       read_table(spark, d, "events", ["user_id", "ts"]))


# --------------------------------------------------------------------------
# X1-X4 streaming (run with availableNow into a sink, then read back)
# --------------------------------------------------------------------------

def _ingest(spark, d):
    # Three deliveries: the first half of the log but some plays, some rows twice;
    # the second half, some rows of both halves again; the plays left out at
    # first, long after the watermark.  Each run goes on from the one before.
    root = X.new_root(spark)
    first, second = _halves(spark, d)
    held = F.col("event_id") % 97 == 5
    again = F.col("event_id") % 10 == 0
    early, behind = first.where(~held), first.where(held)
    for part in (early.unionByName(early.where(again)),
                 second.unionByName(second.where(again)).unionByName(early.where(F.col("event_id") % 10 == 1)),
                 behind.unionByName(behind.where(again)).unionByName(early.where(F.col("event_id") % 10 == 2))):
        part.write.mode("append").parquet(f"{root}/in")
        base = X.ingest_all(X.event_stream(spark, f"{root}/in", "*.parquet"), root)
    return base


@register("x1_ingest")
def x1_ingest(spark, d):
    return X.ingested(spark, _ingest(spark, d))


@register("x1_counts")
def x1_counts(spark, d):
    return X.ingest_counts(spark, _ingest(spark, d))


MID_LOG = "2024-01-16 00:00:00"


def _halves(spark, d):
    """The event log before and from the middle of its month, as delivered."""
    ev = spark.read.schema(X.EVENTS_SCHEMA).parquet(table_path(d, "events"))
    cut = F.lit(MID_LOG).cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


def _g2_flat(p):
    return p.select(
        "user_id",
        F.array_join("top_genres", ",").alias("top_genres"),
        F.array_join(F.transform("top_artists", lambda a: a["name"]), ",").alias("top_artists"),
        F.array_join(F.transform("top_tracks", lambda t: t["id"]), ",").alias("top_tracks"),
        *_flat_features())


def _top_events(spark, d, ev):
    term = S.term_of(F.col("event_type"))
    return ev.select("user_id", term.alias("term_ord"), "value", "event_id", F.col("track_id").alias("item_key"))


def _refresh(spark, d, root):
    """Take in what was delivered below ``root``: listens into the sums, events
    into the lists; profiles of the users with new events are made of both."""
    lines = spark.readStream.schema(S.line_features(spark, d).schema).parquet(f"{root}/listens")
    X.advance_state(lines, PS.sums_of, PS.SUMS, PS.merge_sums, root, "sums")

    def profiles(users, batch_id):
        tops = PS.stored(spark, PS.state_path(root, "tops"), PS.TOPS, users, batch_id + 1)
        known = S.users(spark, d).join(users, "user_id", "left_semi")
        means = PS.means_of(PS.stored(spark, PS.state_path(root, "sums"), PS.SUMS, users), known)
        return _g2_flat(P.assemble_profiles(PS.ranked_lists(tops), S.track_items(spark, d), S.artist_items(spark, d), means,
                                            F.current_timestamp()))
    return X.advance_state(X.event_stream(spark, f"{root}/in", "*.parquet"),
                           lambda batch: PS.tops_of(_top_events(spark, d, batch)), PS.TOPS, PS.merge_tops, root, "tops", profiles)


@register("x2_refresh")
def x2_refresh(spark, d):
    # Two deliveries, each half of the listens and half of the events; a few
    # events of the first come again with the second.
    root = X.new_root(spark)
    first, second = _halves(spark, d)
    listens = S.line_features(spark, d)
    early = F.coalesce(F.col("played_at") < F.lit("1998-01-01").cast("timestamp"), F.lit(True))
    for events, heard in ((first, listens.where(early)),
                          (second.unionByName(first.where(F.col("event_id") % 10 == 3)), listens.where(~early))):
        events.write.mode("append").parquet(f"{root}/in")
        heard.write.mode("append").parquet(f"{root}/listens")
        out = _refresh(spark, d, root)
    rebuilt = spark.read.parquet(out).drop("batch")
    # users with new listens only: their profiles are of the first delivery
    return _with_means(spark, d, root, ST.latest(rebuilt, "user_id"))


def _with_means(spark, d, root, profiles):
    """Profiles with the means as the sums are now: listens of users without new
    events change nothing else."""
    users = profiles.select("user_id")
    means = PS.means_of(PS.stored(spark, PS.state_path(root, "sums"), PS.SUMS), users)
    return profiles.drop("load_seq", *P.FEATURES).join(means, "user_id")


@register("x3_daily")
def x3_daily(spark, d):
    out = X.run_available(X.daily_counts(X.event_stream(spark, d)), "x3_daily", X.new_root(spark))
    ev = spark.read.schema(X.EVENTS_SCHEMA).parquet(table_path(d, "events")).select("ts", "event_type", "value")
    mark = X.mark_of(ev)
    recent = X.since(ev, mark, "day").withColumn("ts", F.col("ts").cast("timestamp"))
    rest = X.still_open(X.daily_counts(recent), "window_end", mark)
    both = spark.read.parquet(out).withColumn("closed", F.lit(True)) \
        .unionByName(rest.withColumn("closed", F.lit(False)))
    return both.withColumn("total_value", F.col("total_value").cast("double"))


@register("x4_sessions")
def x4_sessions(spark, d):
    parts, out = X.run_sessions(X.event_stream(spark, d), X.new_root(spark))
    closed = spark.read.parquet(out)
    ev = spark.read.schema(X.EVENTS_SCHEMA).parquet(table_path(d, "events")).select("user_id", "ts", "event_id")
    mark = X.mark_of(ev)
    rest = X.open_sessions(ev, mark, spark.read.schema(X.PARTS_SCHEMA).parquet(parts), closed)
    return closed.unionByName(rest).withColumn("closed", F.col("session_end") <= F.lit(mark))


# --------------------------------------------------------------------------
# S5 append rows, S13 JSON edge
# --------------------------------------------------------------------------

@register("s5_append")
def s5_append(spark, d):
    # the records of each year's requests are a batch; all are appended, then
    # the first is delivered again
    att = SR.llm_attempts(spark, d)
    crit = _criteria_once(spark, d)
    built = RP.build_playlists(S.search_hits(spark, d), crit, R.query_rows(att), R.titles(att), S.catalogue(spark, d))
    rows = ST.new_playlist_rows(RP.playlist_records(built, crit, S.requests(spark, d), S.request_times(spark, d)))
    rows = written(rows.withColumn("batch_id", F.year("created_at")), "records")
    path = f"{checkpoint_dir(spark)}/playlists-{uuid.uuid4().hex}"
    ST.append_batches(rows, path)
    ST.append_batches(rows.where(F.col("batch_id") == rows.select(F.min("batch_id")).scalar()), path)
    stored = ST.read_appended(spark, path, rows.schema)
    return stored.select(
        "id", "request_id", "batch_id", "user_id", "created_at", "user_prompt", "title", "description", "track_count",
        F.array_join(F.transform("tracks", lambda t: t["id"]), ",").alias("track_ids"),
        F.array_join("llm_params.seed_genres", ",").alias("seed_genres"),
        F.array_join("llm_params.seed_artists", ",").alias("seed_artists"),
        *[F.col(f"llm_params.{c}").alias(c) for c in ("year_min", "year_max", "target_energy", "market", "track_limit")])


@register("s13_json_edge")
def s13_json_edge(spark, d):
    lists = _candidate_lists(spark, d)
    encoded = BZ.to_bronze(lists)
    decoded = BZ.from_bronze(encoded, lists.schema)
    j = decoded.join(lists.withColumnRenamed("tracks", "orig"), "request_id")
    return j.select("request_id", F.size("tracks").alias("n_tracks"),
                    (F.col("tracks") == F.col("orig")).alias("roundtrip_ok"))


@register("s15_bronze")
def s15_bronze(spark, d):
    # responses as JSON lines, some cut off on the way; read back from the files
    lines = BZ.response_lines(G1.cap_hits(S.search_hits(spark, d)))
    cut = (F.col("request_id") + F.col("query_idx")) % 37 == 0
    path = f"{checkpoint_dir(spark)}/responses-{uuid.uuid4().hex}"
    lines.select(F.when(cut, F.substr("value", F.lit(1), F.floor(F.length("value") / 2).cast("int")))
                 .otherwise(F.col("value")).alias("value")).write.text(path)
    responses, bad = BZ.read_responses(spark, path)
    hits = BZ.response_hits(responses)
    usable = G1.usable_hits(hits).groupBy("request_id").agg(F.count(F.lit(1)).alias("usable"))
    counts = G1.skipped_hits(hits).join(usable, "request_id", "left")
    broken = bad.groupBy("request_id").agg(F.count(F.lit(1)).alias("bad_lines"))
    zero = F.lit(0).cast("long")
    return counts.join(broken, "request_id", "full_outer").select(
        "request_id", *[F.coalesce(c, zero).alias(c) for c in ("bad_lines", "failed_queries", "null_items", "bad_years",
                                                               "usable")])


# --------------------------------------------------------------------------
# The store in the catalog: S1 S2, bucketed S3 S7, point lookups S4 S9
# --------------------------------------------------------------------------

@register("s1_tables")
def s1_tables(spark, d):
    # create, fill the years before 1998, create again, add a column, fill the rest
    table = f"{CT.new_database(spark)}.playlists"
    pl = S.playlists(spark, d).withColumn("year", F.year("created_at"))
    lists = _candidate_lists(spark, d).select(F.col("request_id").cast("string").alias("id"), "tracks")
    CT.create_table(spark, table, pl.schema, "year")
    CT.insert(pl.where(F.col("year") < 1998), table)
    CT.create_table(spark, table, pl.schema, "year")
    CT.add_columns(spark, table, lists.schema)
    CT.insert(pl.where(F.col("year") >= 1998).join(lists, "id", "left"), table)
    return spark.table(table).select("id", "user_id", "year", "title", F.coalesce(F.size("tracks"), F.lit(0)).alias("n_tracks"),
                                     F.coalesce(F.array_join(F.transform("tracks", lambda t: t["id"]), ","), F.lit(""))
                                     .alias("track_ids"))


def _buckets(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@register("s3_bucketed")
def s3_bucketed(spark, d):
    existing, writes = S.profile_writes(spark, d)
    stored = CT.write_bucketed(existing, f"{CT.new_database(spark)}.profiles", "user_id", _buckets(spark))
    return CT.upsert_bucketed(stored, writes, "user_id", _buckets(spark)).select("user_id", "n_events", "synced_at")


@register("s7_bucketed")
def s7_bucketed(spark, d):
    stored = CT.write_bucketed(S.playlists(spark, d), f"{CT.new_database(spark)}.playlists", "id", _buckets(spark))
    out = CT.update_links_bucketed(stored, S.link_updates(spark, d), _buckets(spark))
    return out.select("id", "external_id", "external_url")


@register("s9_lookup")
def s9_lookup(spark, d):
    # each user's newest playlist is stored for lookups; the first and the last
    # of their ids and an unknown one are asked for
    newest = S.playlists(spark, d).groupBy("user_id").agg(F.max(F.struct("created_at", "id", "title")).alias("p")) \
        .select("p.id", "user_id", "p.created_at", "p.title")
    path = f"{checkpoint_dir(spark)}/newest-{uuid.uuid4().hex}"
    CT.write_for_lookup(newest, path, "id", 1_000_000)
    table = spark.read.schema(newest.schema).parquet(path)
    ends = table.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    return CT.point_lookup(table, "id", [ends["first"], ends["last"], "none"]).drop("id")


@register("x4_sessions_batch")
def x4_sessions_batch(spark, d):
    ev = read_table(spark, d, "events", ["user_id", "ts", "event_id"])
    return SE.sessions(ev)
