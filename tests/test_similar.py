"""R6 over the whole catalogue, R4 R5 R7 over all features."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import marts, similar
from cadenza.plans import inspect

CRIT = "request_id long, track_limit int, " + ", ".join(f"{t} double" for t in similar.TARGETS)


def _tracks(spark, n, wide=True):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        v = [round(rng.random(), 2) if wide else rng.choice([0.2, 0.8]) for _ in range(5)]
        rows.append((i, rng.randrange(0, 9), v[0], v[1], 60 + 140 * v[2], v[3], v[4]))
    return rows, spark.createDataFrame(rows, "track_id long, popularity int, energy double, valence double, tempo double, "
                                             "danceability double, acousticness double")


def _plain(crit, rows):
    out = []
    for request, limit, *targets in crit:
        scored = []
        for i, pop, *v in rows:
            terms = [((t - x) / s) ** 2 for t, x, s in zip(targets, v, similar.SCALES.values()) if t is not None]
            scored.append((sum(terms) / len(terms) if terms else 0.0, -pop, i))
        scored.sort()
        out += [(request, pos + 1, i) for pos, (_, _, i) in enumerate(scored[:limit])]
    return sorted(out)


@pytest.mark.parametrize("wide", [True, False])
def test_nearest_tracks_are_brute_force(spark, wide):
    rows, tracks = _tracks(spark, 1500, wide)
    crit = [(1, 5, 0.5, None, None, None, None), (2, 30, 0.1, 0.9, 120.0, 0.3, 0.7), (3, 100, None, None, None, None, None),
            (4, 7, 0.1, 0.9, 120.0, 0.3, 0.7), (5, 3, None, None, 500.0, None, None), (6, 1, 0.0, 0.0, 60.0, 0.0, 0.0),
            (7, 2, None, None, None, None, None), (8, 100, None, 0.33, None, None, 0.5)]
    got = similar.nearest_tracks(spark.createDataFrame(crit, CRIT), tracks).collect()
    assert sorted((r.request_id, r.position, r.track_id) for r in got) == _plain(crit, rows)


def test_few_cells_are_read(spark):
    _, tracks = _tracks(spark, 4000)
    placed, boxes = similar.grid(tracks)
    sets = spark.createDataFrame([(0.1, 0.9, 120.0, 0.3, 0.7, 10)], ", ".join(f"{t} double" for t in similar.TARGETS) + ", wanted int")
    cells = similar.cells_of(sets, boxes)
    assert 0 < cells.count() < boxes.count() / 4
    assert boxes.agg(F.sum("n")).first()[0] == 4000 and boxes.count() <= similar.CUTS ** 5


def test_one_target_reads_a_small_part_of_the_catalogue(spark):
    tracks = spark.range(20000).selectExpr("id AS track_id", "CAST(id % 7 AS INT) AS popularity", "(id * 7919 % 20000) / 20000 AS energy",
                                           "(id * 31 % 97) / 97 AS valence", "60D + id % 140 AS tempo",
                                           "(id % 89) / 89 AS danceability", "(id % 83) / 83 AS acousticness")
    sets = spark.createDataFrame([(0.31, None, None, None, None, 10)], ", ".join(f"{t} double" for t in similar.TARGETS) + ", wanted int")
    placed, boxes = similar.grid(tracks, ("energy",))
    assert boxes.count() > 900 and boxes.agg(F.sum("n")).first()[0] == 20000
    near = similar.cells_of(sets, boxes, ("energy",)).join(placed, "cell")
    assert 10 <= near.count() < 200            # 4,000 and more in a grid of all five


def test_empty_tables(spark):
    _, tracks = _tracks(spark, 50)
    crit = spark.createDataFrame([(1, 5, 0.5, None, None, None, None), (2, 5, None, None, None, None, None)], CRIT)
    assert similar.nearest_tracks(crit, tracks.limit(0)).count() == 0
    assert similar.nearest_tracks(crit.limit(0), tracks).count() == 0


def test_checks_count_what_fails(spark):
    rows = [("a", 1, 0.5, 100.0), ("a", None, 1.5, -1.0), ("b", 2, None, 0.0), (None, 3, -0.1, float("nan")), (None, 3, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "id string, user_id long, energy double, tempo double")
    got = {r.check: r.failed for r in marts.checks_of(table, "t", "id", ["user_id"], {c: marts.RANGES[c] for c in ("energy", "tempo")}).collect()}
    assert got == {"t.id unique": 1, "t.id not null": 2, "t.user_id not null": 1, "t.energy in [0,1]": 2, "t.tempo in [0,inf]": 2}
    assert marts.checks_of(table.limit(0), "t", "id", ["user_id"]).collect()[0].failed == 0
    other = spark.createDataFrame([(1,), (2,)], "key long")
    lost = marts.dangling(table, "user_id", other, "key", "t -> o")
    assert lost.first().failed == 2 and inspect.count_operator(lost, "BroadcastNestedLoopJoin") == 0


def test_silver_normalises_every_feature(spark):
    rows = [(1, "economy", 0.2, 0.0, 100.0, 0.5, 0.5), (2, "x", 0.6, 0.5, 150.0, 0.5, 1.0), (3, "large", 1.0, 1.0, 200.0, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "track_id long, genre string, energy double, valence double, tempo double, "
                                     "danceability double, acousticness double")
    got = {r.track_id: r for r in marts.silver_tracks(df, marts.genre_lookup(spark)).collect()}
    assert [round(got[2][f"{c}_n"], 9) for c in ("energy", "valence", "tempo", "acousticness")] == [0.5, 0.5, 0.5, 1.0]
    assert got[1].danceability_n is None and got[2].family == "other" and got[3].family == "full"
