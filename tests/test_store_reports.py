"""Store jobs and report columns on the FIXTURES.md edge rows:
S2 S3 S7 S8 S14 P9 F6 L1, plus the skew-safe position numbering."""

import datetime as dt

from pyspark.sql import functions as F

from cadenza.functions.columns import duration_text
from cadenza.operators import candidates, ordering, prompts, reports, store
from cadenza.plans import inspect
from cadenza.sources import bronze

PL = "id string, user_id long, created_at timestamp, external_id string, external_url string"


def _playlists(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("a", 1, t, None, None), ("b", 1, t, "x", "u")], PL)


def test_old_rows_read_empty_tracks(spark):
    old = spark.createDataFrame([("a",)], "id string")
    new = spark.createDataFrame([("b", ["t1"])], "id string, tracks array<string>")
    got = {r.id: r.tracks for r in store.evolve_tracks(old, new).collect()}
    assert got == {"a": [], "b": ["t1"]}


def test_upsert_last_write_wins(spark):
    existing = spark.createDataFrame([(1, "old", dt.datetime(2024, 5, 1))], "user_id long, v string, synced_at timestamp")
    writes = spark.createDataFrame([(1, "first", dt.datetime(2024, 3, 1), 1), (1, "second", dt.datetime(2024, 2, 1), 2),
                                    (2, "only", dt.datetime(2024, 1, 1), 1)],
                                   "user_id long, v string, synced_at timestamp, load_seq int")
    got = {r.user_id: r.v for r in store.upsert_latest(existing, writes, "user_id").collect()}
    assert got == {1: "second", 2: "only"}


def test_update_of_unknown_id_is_a_no_op(spark):
    upd = spark.createDataFrame([("zzz", "e", "https://x", 1), ("a", "e1", "u1", 1), ("a", "e2", "u2", 2)],
                                "playlist_id string, external_id string, external_url string, update_seq int")
    got = {r.id: (r.external_id, r.external_url) for r in store.apply_link_updates(_playlists(spark), upd).collect()}
    assert got == {"a": ("e2", "u2"), "b": ("x", "u")}


def test_delete_counts_repeats_and_unknown_ids(spark):
    dels = spark.createDataFrame([(9, "a"), (9, "a"), (9, "missing")], "requester_id long, playlist_id string")
    counts = store.deletion_counts(_playlists(spark), dels).first()
    assert (counts.requested, counts.deleted) == (3, 1)
    assert [r.id for r in store.delete_playlists(_playlists(spark), dels).collect()] == ["b"]
    empty = spark.createDataFrame([], "requester_id long, playlist_id string")
    assert store.deletion_counts(_playlists(spark), empty).count() == 0


def test_batches_of_one_hundred(spark):
    rows = [(k, f"t{k}-{i}", i) for k, n in ((1, 100), (2, 101), (3, 250)) for i in range(n)]
    tracks = spark.createDataFrame(rows, "k long, uri string, i long")
    b = store.track_batches(tracks, "k", [F.col("i")])
    got = {}
    for r in b.collect():
        got.setdefault(r.k, []).append((r.batch_no, r.batch_size, r.first_pos, r.last_pos))
    assert sorted(got[1]) == [(0, 100, 1, 100)]
    assert sorted(got[2]) == [(0, 100, 1, 100), (1, 1, 101, 101)]
    assert sorted(got[3]) == [(0, 100, 1, 100), (1, 100, 101, 200), (2, 50, 201, 250)]
    first = {r.k: r.uris[0] for r in b.where("batch_no = 0").collect()}
    assert first == {1: "t1-0", 2: "t2-0", 3: "t3-0"}


def test_positions_are_partition_independent_under_skew(spark):
    # one key holds most rows: numbering must be 1..n whatever the partitioning
    rows = [(0 if i % 10 else i % 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    for n in (1, 8):
        p = ordering.positions(df, ["k"], [F.col("v")], num_partitions=n)
        w = p.groupBy("k").agg(F.count("*").alias("c"), F.min("position").alias("lo"),
                               F.max("position").alias("hi"), F.countDistinct("position").alias("d"))
        assert w.where("lo != 1 or hi != c or d != c").count() == 0
        head = [(r.v, r.position) for r in p.where("k = 0").orderBy("v").limit(3).collect()]
        assert head == [(0, 1), (1, 2), (2, 3)]


def test_request_checks(spark):
    req = spark.createDataFrame([(1, 1, "   "), (2, 1, "abcd"), (3, 1, " abcde "), (4, 1, "\tok fine\n")],
                                "request_id long, user_id long, prompt string")
    got = {r.request_id: (r.check, r.prompt_clean) for r in prompts.check_requests(req).collect()}
    assert got[1][0] == "empty" and got[2][0] == "too_short"
    assert got[3] == ("accepted", "abcde") and got[4] == ("accepted", "ok fine")


def test_duration_text(spark):
    df = spark.createDataFrame([(223456,), (59999,), (0,), (None,)], "ms long")
    assert [r.d for r in df.select(duration_text(F.col("ms")).alias("d")).collect()] == ["3:43", "0:59", "-", "-"]


def test_criteria_context(spark):
    req = spark.createDataFrame([(1, 1, "p1"), (2, 2, "p2"), (3, 3, "p3")],
                                "request_id long, user_id long, prompt string")
    artist = "struct<id:string,name:string,genres:array<string>,uri:string,time_range:string>"
    track = "struct<id:string,name:string,artists:array<string>,uri:string,time_range:string>"
    many = [(str(i), f"a{i}", [], "u", "short_term") for i in range(25)]
    prof = spark.createDataFrame(
        [(2, [], [("t", "song", [], "u", "short_term")]), (3, many, [])],
        f"user_id long, top_artists array<{artist}>, top_tracks array<{track}>")
    ctx = {r.request_id: r.context for r in prompts.criteria_context(prompts.with_profile(req, prof)).collect()}
    assert ctx[1].startswith("No listening profile.")
    assert "Top artists: not available" in ctx[2] and "Top tracks: song\n" in ctx[2]
    assert "a19" in ctx[3] and "a20" not in ctx[3]


def test_tables_created_once_and_snapshots_never_overwrite(spark):
    import os
    import tempfile
    root = tempfile.mkdtemp(prefix="cadenza-test-store-", dir="/tmp")
    first = store.ensure_tables(spark, root)
    again = store.ensure_tables(spark, root)
    assert first == again and spark.read.parquet(first["playlists"]).count() == 0
    a = store.write_snapshot(_playlists(spark), "playlists", root)
    b = store.write_snapshot(_playlists(spark), "playlists", root)
    assert a != b and os.path.isdir(a) and spark.read.parquet(b).count() == 2


RECORD = "id string, request_id long, title string"


def test_a_batch_appended_twice_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 1), ("c", 3, "z", 2)], RECORD + ", batch_id int")
    store.append_batches(rows, path)
    store.append_batches(rows.where("batch_id = 1"), path)
    got = store.read_appended(spark, path, rows.schema)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.collect())
    # delivered again with other rows: the batch is replaced, the other one stays
    store.append_batches(spark.createDataFrame([("b", 2, "w", 1)], RECORD + ", batch_id int"), path)
    assert sorted((r.id, r.title) for r in store.read_appended(spark, path, rows.schema).collect()) == [("b", "w"), ("c", "z")]
    assert "PartitionFilters: [isnotnull(batch_id" in inspect.plan_text(
        store.read_appended(spark, path, rows.schema).where("batch_id = 2"))


def test_playlist_records_carry_user_prompt_and_criteria(spark):
    crit = spark.createDataFrame([(1, "ok", ["g"], ["a"], 1990, 2000, 0.5, None, None, None, None, "FR", 30)],
                                 "request_id long, status string, seed_genres array<string>, seed_artists array<string>, "
                                 "year_min long, year_max long, target_energy double, target_valence double, target_tempo double, "
                                 "target_danceability double, target_acousticness double, market string, track_limit int")
    built = spark.createDataFrame([(1, "ok", "t", "d", 0), (2, "failed", None, None, 0)],
                                  "request_id long, status string, title string, description string, track_count int") \
        .withColumn("tracks", F.array().cast(reports.PLAYLISTS["tracks"].dataType))
    asked = spark.createDataFrame([(1, 7, "  music \n"), (2, 8, "x")], "request_id long, user_id long, prompt string")
    times = spark.createDataFrame([(i, dt.datetime(2024, 1, i)) for i in (1, 2)], "request_id long, requested_at timestamp")
    rows = store.new_playlist_rows(reports.playlist_records(built, crit, asked, times)).collect()
    assert len(rows) == 1 and (rows[0].user_id, rows[0].user_prompt, rows[0].llm_params.market) == (7, "music", "FR")
    assert rows[0].created_at == dt.datetime(2024, 1, 1) and rows[0].external_url is None
    again = store.new_playlist_rows(reports.playlist_records(built, crit, asked, times)).collect()
    assert again == rows        # a batch built again has the same ids


def test_relaunch_report(spark):
    tracks = [("1", "u", "n", ["a", "b"], "al", "1990", 61000, 5, None, "", "img"), ("2", "u", None, ["c"], "al", "1990", 0, 5, None, "l", None)]
    stored = spark.createDataFrame([("p", tracks), ("q", []), ("r", None)], "id string, tracks array<struct<" + ",".join(
        f"{f.name}:{f.dataType.simpleString()}" for f in reports.PLAYLISTS["tracks"].dataType.elementType) + ">>")
    asked = spark.createDataFrame([(1, "p"), (2, "q"), (3, "none"), (4, None), (5, "p"), (6, "r")], "request_id long, playlist_id string")
    got = sorted(tuple(r) for r in reports.relaunch_report(stored, asked).select(
        "request_id", "position", "artists", "duration", "link").collect())
    one = [(1, "a · b", "1:01", "https://open.example.com/track/1"), (2, "c", "-", "l")]
    assert got == [(i, *t) for i in (1, 5) for t in one]


def test_history_keeps_dates_that_are_none(spark):
    day = dt.datetime(2024, 8, 3)
    rows = [(1, "a", day, "2024-08-03T10:00:00", "p", "t", 1, None), (1, "b", day, "summer", "p", "t", 1, "u"),
            (1, "c", day, None, "p", "t", 1, "")]
    pl = spark.createDataFrame(rows, "user_id long, id string, created_at timestamp, created_text string, user_prompt string, "
                                     "title string, track_count int, external_url string")
    got = {r.relaunch_id: (r.date_text, r.date_fr, r.saved) for r in reports.history_report(pl).collect()}
    assert got == {"a": ("3 August 2024", "3 août 2024", False), "b": ("summer", "summer", True), "c": (None, None, False)}


def test_bronze_lines_that_are_no_record(spark, tmp_path):
    path = str(tmp_path / "lines")
    lines = ['{"request_id":1,"query_idx":1,"status":"ok","items":[{"track_id":5,"popularity":1,"release_date":"1990"},null]}',
             '{"request_id":1,"query_idx":2,"status":"error"}', '{"request_id":1,"query_idx":3,"stat', "no json", "[]", "{}",
             '{"request_id":2,"query_idx":1,"status":"ok","items":[{"track_id":6,"release_date":"19xx-01"},{"track_id":7}]}',
             '{"request_id":"x","query_idx":1,"status":"ok","items":[]}', "",
             '{"request_id":3,"query_idx":1,"status":"ok","items":[]}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    responses, bad = bronze.read_responses(spark, path)
    assert sorted((r.request_id, r.query_idx) for r in responses.collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    assert [r.request_id for r in bad.collect() if r.request_id is not None] == [1] and bad.count() >= 4
    counts = {r.request_id: tuple(r)[1:] for r in candidates.skipped_hits(bronze.response_hits(responses)).collect()}
    assert counts == {1: (1, 1, 0), 2: (0, 0, 1)}
