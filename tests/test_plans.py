"""Plan properties the scale design relies on (checked through explain)."""

import re

import pytest

from cadenza.plans import inspect
from cadenza.plans.queries import REGISTRY


@pytest.fixture()
def no_broadcast(spark):
    # Plan as at scale, where the dimension sides exceed the broadcast limit.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_g1_cuts_hits_before_the_first_shuffle(spark, sf_small):
    df = REGISTRY["g1_candidates"](spark, sf_small)
    assert inspect.has_partial_group_limit(df)


def test_g1_windows_share_one_request_exchange(spark, sf_small, no_broadcast):
    text = inspect.plan_text(REGISTRY["k1_top_n"](spark, sf_small))
    # hit cap (request, query) + one request_id clustering reused by the
    # criteria join, the dedupe and the top-N windows
    assert text.count("hashpartitioning(l_orderkey") + text.count("hashpartitioning(request_id") <= 3
    assert "hashpartitioning(request_id#" in text or "hashpartitioning(o_orderkey" in text


def test_scans_read_only_needed_columns(spark, sf_small):
    text = inspect.plan_text(REGISTRY["r3_mood"](spark, sf_small))
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_filters_reach_the_scan(spark, sf_small):
    text = inspect.plan_text(REGISTRY["w5_query_cap"](spark, sf_small))
    assert "LessThanOrEqual(l_linenumber,6)" in text


@pytest.mark.parametrize("name", ["c1_search", "g3_playlists", "r4_silver", "r6_score", "r6_catalogue", "s6_history"])
def test_no_cross_joins(spark, sf_small, name):
    text = inspect.plan_text(REGISTRY[name](spark, sf_small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_profile_caps_are_map_side(spark, sf_small):
    assert inspect.has_partial_group_limit(REGISTRY["w1_top_tracks"](spark, sf_small))
    assert inspect.has_partial_group_limit(REGISTRY["w3_recent_plays"](spark, sf_small))


def test_search_head_pass_is_map_side(spark, sf_small):
    assert inspect.has_partial_group_limit(REGISTRY["c1_search"](spark, sf_small))


def test_batch_sessions_never_cluster_a_user(spark, sf_small):
    from cadenza.operators import sessions
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    assert "rangepartitioning(user_id" in inspect.plan_text(sessions.ranged(events, 8))
    text = inspect.plan_text(REGISTRY["x4_sessions_batch"](spark, sf_small))
    assert "hashpartitioning(user_id" not in text


def test_search_keeps_ten_rows_of_a_key(spark):
    """Queries of one or two tokens, with and without years, read heads only."""
    from cadenza.operators import search
    cat = spark.range(400).selectExpr(
        "id AS track_id", "id % 7 AS popularity", "'same name' AS name", "array(named_struct('name', 'b c')) AS artists",
        "named_struct('name', 'x', 'release_date', cast(1990 + id % 3 AS string)) AS album", "array('g') AS genres",
        "array('FR') AS markets")
    texts = ['genre:g', 'artist:"b c"', 'genre:g year:1991', 'year:0000-9999', 'genre:g same name',
             'artist:"b c" same year:1990-1991', 'artist:b c', 'genre:none same', 'genre:"g" name x year:1992']
    hits = search.search_texts(spark.createDataFrame([(t, None) for t in texts], "query string, market string"), cat).collect()
    rows = [(i, i % 7, 1990 + i % 3) for i in range(400)]

    def want(lo, hi):
        return [i for i, p, y in sorted(rows, key=lambda r: (-r[1], r[0])) if lo <= y <= hi][:10]
    found = {t: [r.track_id for r in sorted((h for h in hits if h.query == t), key=lambda r: r.hit_rank)] for t in texts}
    assert found == {'genre:g': want(0, 9999), 'artist:"b c"': want(0, 9999), 'genre:g year:1991': want(1991, 1991),
                     'year:0000-9999': want(0, 9999), 'genre:g same name': want(0, 9999),
                     'artist:"b c" same year:1990-1991': want(1990, 1991), 'artist:b c': [], 'genre:none same': [],
                     'genre:"g" name x year:1992': want(1992, 1992)}


def _many_token_catalogue(spark, n):
    return spark.range(n).selectExpr(
        "id AS track_id", "cast(id % 100 AS int) AS popularity",
        "concat('common song ', CASE WHEN id % 5 = 0 THEN 'loud' ELSE 'low' END, CASE WHEN id = 17 THEN ' single' ELSE '' END) AS name",
        "array(named_struct('name', concat('b', id % 3))) AS artists",
        "named_struct('name', 'x', 'release_date', cast(1990 + id % 7 AS string)) AS album", "array('g') AS genres",
        "CASE WHEN id % 4 = 0 THEN array('FR', 'US') WHEN id % 4 = 1 THEN array('US') WHEN id % 4 = 2 THEN cast(array() AS array<string>) END AS markets")


def test_search_of_many_tokens_by_blocks(spark, monkeypatch):
    """The same ten hits as a plain scan, with small blocks; markets; queries of
    few hits, of none, and without a market."""
    from cadenza.operators import search
    monkeypatch.setattr(search, "FIRST_BLOCK", 16)
    rows = {r.track_id: r for r in search.track_tokens(_many_token_catalogue(spark, 3000)).collect()}
    texts = [(t, m) for t in ("common song loud", "common song artist:b1 genre:g", "common song single", "loud low common",
                              "common song x year:1992-1993", "common song none", "common song") for m in ("FR", "US", "ZZ", None)]
    hits = search.search_texts(spark.createDataFrame(texts, "query string, market string"),
                               _many_token_catalogue(spark, 3000)).collect()
    got = {}
    for h in sorted(hits, key=lambda h: h.hit_rank):
        got.setdefault((h.query, h.market), []).append(h.track_id)
    for text, market in texts:
        words = [t for t in text.split() if not t.startswith("year:")]
        need = {("g:" + w[6:] if w.startswith("genre:") else "a:" + w[7:] if w.startswith("artist:") else "w:" + w) for w in words}
        want = [i for i in sorted(rows, key=lambda i: (-rows[i].popularity, i))
                if need <= set(rows[i].t_tokens) and (market is None or market in rows[i].t_markets)
                and ("year:" not in text or 1992 <= rows[i].t_year <= 1993)][:10]
        assert got.get((text, market or ""), []) == want, (text, market)


def test_search_stops_at_the_blocks_it_needs(spark, monkeypatch):
    from cadenza.operators import search
    monkeypatch.setattr(search, "FIRST_BLOCK", 16)
    seen, post = [], search.written
    def watched(df, tag):
        if tag == "hits":
            seen.append(inspect.plan_text(df))
        return post(df, tag)
    monkeypatch.setattr(search, "written", watched)
    cat = _many_token_catalogue(spark, 20000)
    search.search_texts(spark.createDataFrame([("common song g:x loud", None), ("common song loud", "US")],
                                              "query string, market string"), cat).collect()
    # of seven blocks the first five answer; each round reads the folder of its block alone
    assert len(seen) == 5
    assert all(re.search(rf"PartitionFilters: \[[^\n]*block#[0-9]+ = {i}\)", text) for i, text in enumerate(seen))
    assert not any("CartesianProduct" in text or "BroadcastNestedLoopJoin" in text for text in seen)


def test_relaunch_joins_named_playlists_only(spark, sf_small):
    from cadenza.operators import store
    ids = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, None)], "request_id long, playlist_id string")
    stored = spark.createDataFrame([("a", "t")], "id string, title string")
    found = store.lookup(stored, ids)
    assert sorted((r.request_id, r.title) for r in found.collect()) == [(1, None), (2, "t"), (3, None), (4, None)]
    assert "Union" in inspect.plan_text(found) and "isnull(playlist_id" in inspect.plan_text(found)


def test_criteria_replies_are_dealt_out_before_typing(spark, sf_small):
    text = inspect.plan_text(REGISTRY["l4_criteria"](spark, sf_small))
    assert re.search(r"hashpartitioning\(request_id#[0-9]+L, attempt#[0-9]+", text)


@pytest.mark.parametrize("name", ["s5_append", "g3_playlists", "p12_status", "r6_score"])
def test_criteria_replies_are_typed_once(monkeypatch, spark, sf_small, name):
    from cadenza.plans import queries
    plans, write = {}, queries.written

    def noted(df, tag):
        plans[tag] = inspect.plan_text(df)
        return write(df, tag)
    monkeypatch.setattr(queries, "written", noted)
    plans["query"] = inspect.plan_text(REGISTRY[name](spark, sf_small))
    # the table is typed for one write, which all joins read
    assert "request_id" in plans.pop("criteria")
    assert not any("invalid:limit" in text or "target_tempo:variant" in text for text in plans.values())


def test_hits_are_derived_after_the_rank_exchange(spark, sf_small):
    text = inspect.plan_text(REGISTRY["s12_skipped"](spark, sf_small))
    assert inspect.has_partial_group_limit(REGISTRY["s12_skipped"](spark, sf_small))
    # the details of the plan begin at the scan
    at = re.search(r"hashpartitioning\(request_id#[0-9]+L, query_idx", text)
    assert at and at.start() < text.index("19xx-")


def test_relaunch_report_shuffles_what_it_reports(spark, sf_small, no_broadcast):
    text = inspect.plan_text(REGISTRY["g5_relaunch_report"](spark, sf_small))
    assert "preview_url" not in text and "album" not in text
    # the lists are made by the text key that joins them: they cross no exchange of their own
    assert len(re.findall(r"hashpartitioning\((?:list_of|cast\(request_id)", text)) == 1
