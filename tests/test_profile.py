"""G2 parts on the FIXTURES.md edge rows: W1, A1, K3, W3, A2."""

import datetime as dt

from pyspark.sql import functions as F

from cadenza.operators import cursor
from cadenza.operators import profile as P
from cadenza.plans import inspect
from cadenza.session import checkpoint_dir

RAW = "user_id long, term_ord int, time_range string, rank int, item_key long"
ARTISTS = "item_key long, id string, name string, genres array<string>, uri string"
TRACKS = "item_key long, id string, name string, artists array<struct<name:string>>, uri string"


def test_earliest_range_wins(spark):
    raw = spark.createDataFrame([(1, 2, "medium_term", 1, 10), (1, 1, "short_term", 40, 10)], RAW)
    items = spark.createDataFrame([(10, "t10", "song", [("a",)], "u")], TRACKS)
    out = P.top_tracks(raw, items).collect()
    assert [(r.id, r.time_range, r.rank) for r in out] == [("t10", "short_term", 40)]


def test_ranks_beyond_fifty_are_not_read(spark):
    raw = spark.createDataFrame([(1, 1, "short_term", 51, 10)], RAW)
    items = spark.createDataFrame([(10, "t10", "song", [("a",)], "u")], TRACKS)
    assert P.top_tracks(raw, items).count() == 0


def test_genres_count_distinct_artists_and_repeats(spark):
    raw = spark.createDataFrame([(1, 1, "short_term", 1, 1), (1, 3, "long_term", 1, 1), (1, 1, "short_term", 2, 2)],
                                RAW)
    items = spark.createDataFrame([(1, "X", "X", ["g", "h"], "u"), (2, "Y", "Y", ["k", "k"], "u")], ARTISTS)
    g = P.genre_ranking(P.top_artists(raw, items))
    got = {r.genre: r.n_artists for r in g.collect()}
    assert got == {"g": 1, "h": 1, "k": 2}


def test_genre_ties_keep_first_appearance(spark):
    raw = spark.createDataFrame([(1, 1, "short_term", 1, 1), (1, 1, "short_term", 2, 2),
                                 (1, 1, "short_term", 3, 3)], RAW)
    items = spark.createDataFrame([(1, "A", "A", ["h"], "u"), (2, "B", "B", ["g", "h"], "u"),
                                   (3, "C", "C", ["g"], "u")], ARTISTS)
    g = P.genre_ranking(P.top_artists(raw, items))
    assert [r.genre for r in g.orderBy("genre_rank").collect()] == ["h", "g"]


def test_newest_play_of_a_track_is_kept(spark):
    rows = [(1, 7, dt.datetime(2024, 1, 1, 10), 1), (1, 7, dt.datetime(2024, 1, 1, 11), 2)]
    plays = spark.createDataFrame(rows, "user_id long, track_id long, played_at timestamp, event_id long")
    out = P.recent_plays(plays).collect()
    assert [r.played_at.hour for r in out] == [11]


def test_only_the_newest_hundred_plays_count(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i) for i in range(150)]
    plays = spark.createDataFrame(rows, "user_id long, track_id long, played_at timestamp, event_id long")
    out = P.recent_plays(plays)
    assert out.count() == 100 and out.agg(F.min("track_id")).first()[0] == 50


def test_feature_means_and_defaults(spark):
    feats = spark.createDataFrame([(1, 0.2, None), (1, None, None), (1, 0.4, None)],
                                  "user_id long, energy double, tempo double")
    for c in ("valence", "danceability", "acousticness"):
        feats = feats.withColumn(c, F.lit(None).cast("double"))
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = {r.user_id: r for r in P.feature_means(feats, users).collect()}
    assert got[1].energy == 0.3 and got[1].tempo == 120.0 and got[1].valence == 0.5
    assert (got[2].energy, got[2].danceability, got[2].tempo) == (0.5, 0.5, 120.0)


def test_mean_rounds_half_up(spark):
    feats = spark.createDataFrame([(1, 0.5025)], "user_id long, energy double")
    for c in ("valence", "danceability", "acousticness", "tempo"):
        feats = feats.withColumn(c, F.lit(None).cast("double"))
    out = P.feature_means(feats, spark.createDataFrame([(1,)], "user_id long")).first()
    assert out.energy == 0.503


def test_polls_read_behind_the_cursor(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, t + dt.timedelta(minutes=i // 2), i) for i in range(130)] + [(2, 5, t, 900), (3, 6, None, 901)]
    schema = "user_id long, track_id long, played_at timestamp, event_id long"
    path = f"{checkpoint_dir(spark)}/cursors-{dt.datetime.now().timestamp()}"

    def poll(more, number):
        pages = cursor.poll(spark.createDataFrame(rows + more, schema), path, number).collect()
        return {u: [(r.page, r.position, r.event_id) for r in sorted(pages, key=lambda r: r.position) if r.user_id == u]
                for u in {r.user_id for r in pages}}
    first = poll([], 0)
    assert first == {1: [(1 + i // 50, i + 1, 129 - i) for i in range(100)], 2: [(1, 1, 900)]}
    assert poll([], 1) == {}                                        # nothing new
    # the second of two plays at the cursor's time, and a later one; user 4 is new
    more = [(1, 9, t + dt.timedelta(minutes=64), 130), (1, 9, t + dt.timedelta(minutes=70), 131), (4, 1, t, 7)]
    want = {1: [(1, 1, 131), (1, 2, 130)], 4: [(1, 1, 7)]}
    assert poll(more, 2) == want and poll(more, 2) == want          # a poll that runs again
    assert poll(more, 3) == {}
    assert inspect.has_partial_group_limit(cursor.read_pages(spark.createDataFrame(rows, schema),
                                                             spark.createDataFrame([], cursor.CURSOR)))
