"""The analytics tables the application planned but never built.

All are aggregates with map-side partial aggregation; windows only run over
already-aggregated rows (months x genres, hours per user), whose groups are
bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import FEATURE_DEFAULTS
from cadenza.operators.profile import FEATURES, _mean3

# Genre family of each catalogue genre (R4 taxonomy, ours).
GENRE_FAMILY = {"economy": "value", "promo": "value", "small": "compact", "medium": "compact",
                "large": "full", "standard": "full"}


def exact_mean(c) -> F.Column:
    """Mean whose value does not depend on summation order: the sum is
    exact (decimal), one final division in double."""
    return F.try_divide(F.sum(c.cast("decimal(18,4)")).cast("double"), F.count(c))


def profile_by_month(features: DataFrame) -> DataFrame:
    """A2's rounded means per user and calendar month."""
    month = F.date_format("played_at", "yyyy-MM")
    agg = features.groupBy("user_id", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n_lines"), *[_mean3(c).alias(c) for c in FEATURES])
    return agg.select("user_id", "month", "n_lines",
                      *[F.coalesce(F.col(c), F.lit(float(v))).alias(c) for c, v in FEATURE_DEFAULTS.items()])


def genre_evolution(plays: DataFrame, genres: DataFrame) -> DataFrame:
    """R2: plays, share and change of share of each genre per month.

    ``plays(month, track_id)`` is first counted per (month, track) -- a
    partial aggregate before the shuffle -- so the join to the genre table
    sees one row per (month, track) instead of one per play."""
    per_track = plays.groupBy("month", "track_id").agg(F.count(F.lit(1)).alias("n"))
    g = per_track.join(genres, "track_id").groupBy("month", "genre").agg(F.sum("n").alias("plays"))
    month_total = F.sum("plays").over(Window.partitionBy("month"))
    g = g.withColumn("share", F.col("plays") / month_total)
    prev = F.lag("share").over(Window.partitionBy("genre").orderBy("month"))
    return g.withColumn("prev_share", prev).withColumn("delta", F.col("share") - F.col("prev_share"))


def season_of(ts) -> F.Column:
    m = F.month(ts)
    return (F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
            .when(m.isin(6, 7, 8), "summer").otherwise("autumn"))


def mood_patterns(events: DataFrame) -> DataFrame:
    """Event count and mean value by season, weekday (1 = Sunday) and
    hour, with roll-up subtotals (``level`` = grouping id)."""
    e = events.select(season_of(F.col("ts")).alias("season"), F.dayofweek("ts").alias("weekday"),
                      F.hour("ts").alias("hour"), "value")
    return e.rollup("season", "weekday", "hour").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_events"),
        exact_mean(F.col("value")).alias("mean_value"))


def silver_tracks(track_features: DataFrame, spark_lookup: DataFrame) -> DataFrame:
    """One row per track (latest wins on repeated ids), min-max
    normalised features, genre family from the taxonomy lookup.

    The minima and maxima are scalar subqueries (Spark merges them into one
    global aggregate, partial per task, and uses the values as constants);
    the taxonomy is a fixed table of a few rows, broadcast."""
    cols = [c for c in track_features.columns if c != "track_id"]
    one = track_features.groupBy("track_id").agg(F.max_by(F.struct(*cols), F.struct(*cols)).alias("_t")) \
        .select("track_id", "_t.*")
    normed = []
    for c in FEATURES:
        lo = one.select(F.min(c)).scalar()
        hi = one.select(F.max(c)).scalar()
        normed.append(F.try_divide(F.col(c) - lo, hi - lo).alias(f"{c}_n"))
    out = one.select("track_id", "genre", *normed)
    return out.join(F.broadcast(spark_lookup), "genre", "left") \
        .withColumn("family", F.coalesce("family", F.lit("other")))


def genre_lookup(spark) -> DataFrame:
    return spark.createDataFrame(sorted(GENRE_FAMILY.items()), "genre string, family string")


#: The range of each audio feature (D3); no end to the tempo.
RANGES = {"energy": (0.0, 1.0), "valence": (0.0, 1.0), "danceability": (0.0, 1.0), "acousticness": (0.0, 1.0),
          "tempo": (0.0, None)}


def checks_of(table: DataFrame, name: str, key: str | None, not_null: list[str] = (),
              ranges: dict[str, tuple] | None = None) -> DataFrame:
    """(check, failed) for one table, which is read once: rows that repeat a
    key, NULL keys and columns, values out of range.

    Rows are counted by key with everything else summed map-side, so a key that
    holds many rows is one row a task."""
    tests = {f"{name}.{c} not null": F.col(c).isNull() for c in [*([key] if key else []), *not_null]}
    for c, (lo, hi) in (ranges or {}).items():
        outside = F.col(c) < lo if hi is None else (F.col(c) < lo) | (F.col(c) > hi)
        tests[f"{name}.{c} in [{lo:g},{'inf' if hi is None else f'{hi:g}'}]"] = F.coalesce(outside | F.isnan(c), F.lit(False))
    counts = [F.count_if(t).alias(f"_{i}") for i, t in enumerate(tests.values())]
    zero = F.lit(0).cast("long")
    if key:
        per_key = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *counts)
        repeats = F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("_n") - 1)), zero)
        totals = [F.coalesce(F.sum(f"_{i}"), zero) for i in range(len(tests))]
        one = per_key.agg(repeats.alias("_r"), *[t.alias(f"_{i}") for i, t in enumerate(totals)])
        rows = [F.struct(F.lit(f"{name}.{key} unique").alias("check"), F.col("_r").alias("failed"))]
    else:
        one, rows = table.agg(*counts), []
    rows += [F.struct(F.lit(t).alias("check"), F.col(f"_{i}").alias("failed")) for i, t in enumerate(tests)]
    return one.select(F.inline(F.array(*rows)))


def dangling(table: DataFrame, column: str, other: DataFrame, key: str, name: str) -> DataFrame:
    """(check, failed): rows whose reference is in no row of the other table
    (a NULL refers to nothing and is none of them)."""
    refs = table.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    lost = refs.join(other.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("failed")).select(F.lit(name).alias("check"), "failed")


def quality_checks(tables: dict[str, tuple], references: list[tuple]) -> DataFrame:
    """Failing-row counts of all checks.  ``tables``: name -> arguments of
    ``checks_of`` after the name, table first; ``references``: arguments of
    ``dangling``."""
    out = None
    for part in [checks_of(t, name, *rest) for name, (t, *rest) in tables.items()] + [dangling(*r) for r in references]:
        out = part if out is None else out.unionByName(part)
    return out


def score_candidates(hits: DataFrame, crit: DataFrame, track_features: DataFrame) -> DataFrame:
    """Distance of each candidate to the request's target features,
    over the five targets that are set (tempo difference in units of 200 BPM);
    no target -> score 0.  Ranked by score, then popularity, then the hit
    order, cut to the request's limit."""
    names = ["energy", "valence", "tempo", "danceability", "acousticness"]
    tf = track_features.select("track_id", *names)
    t = crit.select("request_id", *[f"target_{x}" for x in names])
    j = hits.join(t, "request_id").join(tf, "track_id")
    off = [(F.col(f"target_{x}") - F.col(x)) / (200.0 if x == "tempo" else 1.0) for x in names]
    terms = [x * x for x in off]
    n = sum(F.when(x.isNotNull(), 1).otherwise(0) for x in terms)
    total = F.coalesce(terms[0], F.lit(0.0))
    for x in terms[1:]:
        total = total + F.coalesce(x, F.lit(0.0))
    score = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    w = Window.partitionBy("request_id").orderBy("score", F.desc(F.coalesce("popularity", F.lit(0))),
                                                  "query_idx", "hit_rank")
    ranked = j.withColumn("score", score).withColumn("position", F.row_number().over(w))
    return ranked.where(F.col("position") <= F.col("track_limit"))


def music_dna(genres: DataFrame, means: DataFrame, events: DataFrame) -> DataFrame:
    """Per user with events: top genre (A1/K3 rank 1), the five feature
    means (A2) and the favourite hour (most events, ties to the earlier hour)."""
    top = genres.where(F.col("genre_rank") == 1).select("user_id", F.col("genre").alias("top_genre"))
    per_hour = events.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "hour")
    fav = per_hour.withColumn("_r", F.row_number().over(w)).where("_r = 1") \
        .select("user_id", F.col("hour").alias("fav_hour"))
    totals = per_hour.groupBy("user_id").agg(F.sum("n").alias("n_events"))
    return totals.join(fav, "user_id").join(top, "user_id", "left") \
        .join(means.select("user_id", *FEATURES), "user_id", "left")
