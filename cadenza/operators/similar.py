"""R6 over the whole catalogue: the tracks nearest to a request's targets.

The score is R6's: the mean of the squared differences over the targets that are
set, tempo in units of 200.  No request meets every track:

1. The catalogue is cut into a grid of the features that a request has targets
   for, one for each such combination that occurs (31 at most): each feature at
   its quantiles, 2^BITS parts a feature, at most 1,024 cells.  Few features are
   cut finely: with one target a cell is a thousandth of the catalogue, where a grid
   of all five would leave a quarter of it to each search.  A cell keeps its number
   of tracks and the least and largest value of each feature.  These few rows are
   the grid's table, bounded whatever the size of the catalogue.
2. For each distinct set of targets the boxes give the least and the largest
   score that a cell's tracks can have.  In the order of the largest scores the
   counts add up to the number of tracks wanted; the largest score there is a
   bound, and cells whose least score is above it hold none of the tracks wanted.
3. The cells left are joined to their tracks, which are scored and cut to the
   wanted number map-side.

Targets that no request repeats cost one search each, repeated ones one for all.
Without any target every score is 0, and the tracks are the most popular ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import written

#: Features in the order of the score's sum, with the size of a unit of each.
SCALES = {"energy": 1.0, "valence": 1.0, "tempo": 200.0, "danceability": 1.0, "acousticness": 1.0}
CUTS = 4
#: Halvings of each feature of a grid, by the number of its features.
BITS = {1: 10, 2: 5, 3: 3, 4: 2, 5: 2}
TARGETS = [f"target_{x}" for x in SCALES]
#: Rounding of sums: a bound is this much wider than computed.
SLACK = 1e-9


def _mean(terms: list[Column]) -> Column:
    """Mean of the terms that are not NULL; 0 without any.  Summed in order."""
    n = sum(F.when(t.isNotNull(), 1).otherwise(0) for t in terms)
    total = F.coalesce(terms[0], F.lit(0.0))
    for t in terms[1:]:
        total = total + F.coalesce(t, F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def score(row_of=F.col, target_of=F.col) -> Column:
    """R6's distance of a track's features to the targets."""
    return _mean([F.pow((target_of(f"target_{x}") - row_of(x)) / s, F.lit(2.0)) for x, s in SCALES.items()])


def _parts(tracks: DataFrame, features, bits: int, at) -> DataFrame:
    """Add ``_p_<feature>``: how many of the feature's 2^bits - 1 quantiles are below
    its value, found by halving.  A step is a projection of its own, so that none is
    computed twice."""
    out = tracks
    for step in [0, *(1 << b for b in reversed(range(bits)))]:
        columns = {}
        for x in features:
            cuts = F.lit([float(q) for q in at[x] or []] or [0.0])
            below = F.get(cuts, F.col(f"_p_{x}") + (step - 1)) < F.col(x) if step else None
            columns[f"_p_{x}"] = F.lit(0) if not step else F.col(f"_p_{x}") + F.when(below, step).otherwise(0)
        out = out.withColumns(columns)
    return out


def grid(tracks: DataFrame, features=tuple(SCALES)) -> tuple[DataFrame, DataFrame]:
    """(tracks with their ``cell``, one row for each cell: ``n`` and the box), cut
    by some features.  A track with a NULL feature scores NULL in that term and is
    left out."""
    whole = tracks.where(F.greatest(*[F.col(x).isNull() for x in SCALES]) == F.lit(False))
    bits = BITS[len(features)]
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    at = whole.agg(*[F.percentile_approx(x, share, 10000).alias(x) for x in features]).first()
    cell = F.lit(0)
    for x in features:
        cell = cell * (1 << bits) + F.col(f"_p_{x}")
    placed = _parts(whole, features, bits, at).withColumn("cell", cell).drop(*[f"_p_{x}" for x in features])
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[e for x in features for e in (
        F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}"))])
    return placed, boxes


def _box_terms(box, nearest: bool, features) -> list[Column]:
    out = []
    for x in features:
        s = SCALES[x]
        t, lo, hi = F.col(f"target_{x}"), box[f"lo_{x}"], box[f"hi_{x}"]
        away = F.greatest(lo - t, t - hi, F.lit(0.0)) if nearest else F.greatest(F.abs(t - lo), F.abs(t - hi))
        out.append(F.when(t.isNotNull(), F.pow(away / s, F.lit(2.0))))
    return out


def cells_of(targets: DataFrame, boxes: DataFrame, features=tuple(SCALES)) -> DataFrame:
    """(targets..., wanted) -> the cells that can hold one of the wanted tracks.
    The boxes are one value for all rows, an array of at most 1,024 entries; they
    are bounded, sorted and cut within the row, so no pair of rows is formed that
    is not used."""
    fields = ["cell", "n", *[f"{e}_{x}" for x in features for e in ("lo", "hi")]]
    table = boxes.agg(F.collect_list(F.struct(*fields)).alias("_boxes")).scalar()
    rated = targets.withColumn("_boxes", table).withColumn("_rated", F.transform("_boxes", lambda b: F.struct(
        (_mean(_box_terms(b, False, features)) + SLACK).alias("most"), (_mean(_box_terms(b, True, features)) - SLACK).alias("least"),
        b["n"].alias("n"), b["cell"].alias("cell"))))
    # the bound: the largest score of the cell that makes the count
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("bound"))
    bound = F.aggregate(F.array_sort("_rated"), start, lambda a, r: F.struct(
        (a["n"] + r["n"]).alias("n"),
        F.when((a["n"] < F.col("wanted")) & (a["n"] + r["n"] >= F.col("wanted")), r["most"]).otherwise(a["bound"]).alias("bound")))
    near = rated.withColumn("_bound", bound["bound"])
    return near.select(*targets.columns, F.explode(F.filter("_rated", lambda r: r["least"] <= F.col("_bound"))).alias("r")) \
        .select(*targets.columns, "r.cell")


def nearest_tracks(crit: DataFrame, tracks: DataFrame) -> DataFrame:
    """``crit(request_id, track_limit, target_*)`` and ``tracks(track_id,
    popularity, features)`` -> (request_id, track_id, score, position): the
    ``track_limit`` nearest, ties by popularity (descending) and id."""
    some = F.coalesce(*TARGETS).isNotNull()
    asked = crit.select("request_id", F.col("track_limit").alias("wanted"), *TARGETS)
    # one search for each set of targets, for the longest list asked of it
    sets = asked.where(some).groupBy(*TARGETS).agg(F.max("wanted").alias("wanted"))
    sets = sets.withColumn("set", F.xxhash64(F.to_json(F.struct(*TARGETS))))
    best = Window.partitionBy("set").orderBy("score", F.desc("popularity"), "track_id")
    sets = sets.withColumn("asks", F.concat_ws(",", *[F.when(F.col(t).isNotNull(), F.lit(t[7:])) for t in TARGETS]))
    sets = written(sets, "targets")
    scored = []
    for asks in sorted(r.asks for r in sets.select("asks").distinct().collect()):     # 31 at most
        features = tuple(asks.split(","))
        placed, boxes = grid(tracks, features)
        cells = cells_of(sets.where(F.col("asks") == asks).drop("asks"), boxes, features)
        scored.append(cells.join(placed, "cell").withColumn("score", score()).select("set", "popularity", "track_id", "score"))
    if not scored:
        scored = [sets.join(tracks, F.lit(False)).select("set", "popularity", "track_id", F.lit(0.0).alias("score"))]
    top = reduce(DataFrame.unionByName, scored).withColumn("position", F.row_number().over(best)).where(F.col("position") <= 100) \
        .select("set", "track_id", "score", "position")
    with_targets = asked.where(some).withColumn("set", F.xxhash64(F.to_json(F.struct(*TARGETS)))) \
        .join(top, "set").where(F.col("position") <= F.col("wanted"))
    # no target: the most popular, one list of 100 for all such requests
    first = tracks.select("track_id", "popularity").orderBy(F.desc("popularity"), "track_id").limit(100)
    listed = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("popularity")).alias("p"), "track_id"))).alias("_first"))
    without = asked.where(~some).withColumn("_first", listed.scalar()).select(
        "request_id", F.posexplode(F.slice("_first", F.lit(1), F.col("wanted"))).alias("pos", "t")) \
        .select("request_id", F.col("t.track_id").alias("track_id"), F.lit(0.0).alias("score"), (F.col("pos") + 1).alias("position"))
    return with_targets.select("request_id", "track_id", "score", "position").unionByName(without)
