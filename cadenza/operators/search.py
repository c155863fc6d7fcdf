"""C1 catalogue search: query rows x track catalogue -> top 10 hits per query.

The original sent each query to a remote search service; the matching rule
is therefore ours and stated here.  A query is split on whitespace
(lower-cased):

- ``genre:X``   the track's genres contain X (all such tokens must hold);
- ``artist:Y``  one of the track's artists is named Y (case-insensitive);
- ``year:A-B`` / ``year:A``  the release year lies in [A, B] (all must hold);
- any other token is a free word that must occur among the words of the
  track name or album name.

Hits are ordered by popularity descending, then track id; the first 10 are
kept (W5).  A query without any token finds nothing.  A query that names a
market finds tracks that are on sale there only; one without (NULL) finds all.

A value with spaces is quoted: ``artist:"b c"``, ``genre:"b c"``.

Plan (no cross join, no cap on candidates, no switch by size):

0. Hits depend on the query text and market only: each distinct pair is searched
   once and its <= 10 hits are joined back to the query rows.
1. A track is posted under *keys*: the empty key, each of its tokens
   (``g:``/``a:``/``w:``) and each pair of its tokens; only keys that some
   query asks for are kept.
2. A query of at most two tokens is one key.  With a year range its hits are
   the first ten of each year of the range, merged: exact from heads of ten rows,
   which a map-side WindowGroupLimit cuts before the exchange, however popular
   the key is.
3. Every other query reads the postings of its key, or of its rarest pair if it
   has more tokens, in the order of the ranking, a block at a time: the tracks are
   numbered in it, and block b holds four times as many of them as the one
   before.  Every track of a later block ranks below every one of an earlier
   block, so a query that has ten hits is answered, and one whose pair has no
   posting further on as well; only the others go on.  The postings are written
   by block, and a block that nobody needs is not read.

Every test is a codegen-able expression (no lambdas per pair of rows).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import HITS_PER_QUERY
from cadenza.operators.ordering import positions
from cadenza.session import checkpoint_dir, written

YEAR_RE = r"^year:([0-9]{4})(-([0-9]{4}))?$"
TOKEN_RE = r'((?:genre|artist):"[^"]*"|\S+)'
SEP = "\u0001"
QKEY = ["query", "market"]   # results depend on these only
#: Tracks of the first block, and how much more the next one holds.
FIRST_BLOCK, GROWTH = 1024, 4


def parse_queries(queries: DataFrame) -> DataFrame:
    """``(query, market)`` -> required tokens in order and year range; no market
    is ''."""
    toks = F.regexp_extract_all(F.lower(F.col("query")), F.lit(TOKEN_RE), F.lit(1))
    is_year = lambda t: t.rlike(YEAR_RE)

    def values(kind: str, prefix: str):
        return F.transform(F.filter(toks, lambda t: t.startswith(kind)), lambda t: F.concat(
            F.lit(prefix), F.replace(F.substr(t, F.lit(len(kind) + 1)), F.lit('"'), F.lit(""))))
    words = F.transform(F.filter(toks, lambda t: ~(t.startswith("genre:") | t.startswith("artist:") | is_year(t))),
                        lambda t: F.concat(F.lit("w:"), t))
    years = F.filter(toks, is_year)
    lo = F.transform(years, lambda t: F.regexp_extract(t, YEAR_RE, 1).cast("int"))
    hi = F.transform(years, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, YEAR_RE, 3), F.lit("")),
                                                 F.regexp_extract(t, YEAR_RE, 1)).cast("int"))
    required = F.concat(values("genre:", "g:"), values("artist:", "a:"), words)
    return queries.select("query", F.coalesce("market", F.lit("")).alias("market"), F.array_sort(F.array_distinct(required)).alias("required"),
                          F.array_max(lo).alias("y_lo"), F.array_min(hi).alias("y_hi"),
                          F.size(toks).alias("n_tokens"))


def track_tokens(catalogue: DataFrame) -> DataFrame:
    """``(track_id, popularity, t_tokens, t_year, t_markets)``: the distinct
    tokens of a track in order; its markets and '' for any."""
    names = F.transform("artists", lambda a: F.concat(F.lit("a:"), F.lower(a["name"])))
    words = F.transform(F.filter(F.split(F.lower(F.concat_ws(" ", F.col("name"), F.col("album.name"))), r"\s+"),
                                 lambda w: F.length(w) > 0), lambda w: F.concat(F.lit("w:"), w))
    genres = F.transform("genres", lambda g: F.concat(F.lit("g:"), F.lower(g)))
    year = F.col("album.release_date").substr(1, 4).try_cast("int")
    return catalogue.select("track_id", "popularity",
                            F.array_sort(F.array_distinct(F.concat(genres, names, words))).alias("t_tokens"),
                            year.alias("t_year"), F.array_append(F.coalesce("markets", F.array().cast("array<string>")),
                                                                 "").alias("t_markets"))


def _pairs(tokens):
    """Keys of the pairs of an ordered token list."""
    return F.flatten(F.transform(tokens, lambda a, i: F.transform(
        F.slice(tokens, i + 2, F.size(tokens)), lambda b: F.concat(a, F.lit(SEP), b))))


def _top(matches: DataFrame) -> DataFrame:
    w = Window.partitionBy(*QKEY).orderBy(F.desc("popularity"), "track_id")
    return matches.select(*QKEY, "track_id", "popularity") \
        .withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= HITS_PER_QUERY)


def _heads(posted: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("popularity"), "track_id")
    return posted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= HITS_PER_QUERY).drop("_r")


def search(queries: DataFrame, catalogue: DataFrame, keep: tuple[str, ...] = (), details=None) -> DataFrame:
    """``(request_id, query_idx, hit_rank, track_id, popularity)`` of
    ``queries(request_id, query_idx, query, market)``.

    The hits of a query depend on its text and market only, and both repeat
    (popular searches), so each distinct pair is searched once and its <= 10
    hits are joined back to the query rows.  What the rows are to have besides goes
    in before that join, which makes ten rows of one: columns ``keep`` of the
    queries, and columns that ``details`` adds to the hits of the distinct pairs."""
    rows = written(queries.select("request_id", "query_idx", "query", F.coalesce("market", F.lit("")).alias("market"), *keep),
                   "queries")
    hits = search_texts(rows.select(*QKEY).distinct(), catalogue)
    found = hits if details is None else details(hits)
    added = [c for c in found.columns if c not in hits.columns]
    return rows.join(found, QKEY).select("request_id", "query_idx", "hit_rank", "track_id", "popularity", *keep, *added)


def search_texts(texts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Top-10 hits per distinct query text and market ``(query, market, hit_rank,
    track_id, popularity)``."""
    tracks = track_tokens(catalogue)
    parsed = written(parse_queries(texts).where("n_tokens > 0"), "parsed")
    short = F.size("required") <= 2
    key = F.array_join("required", SEP)
    dated = parsed.where(short & F.col("y_lo").isNotNull()).withColumn("key", key)
    others = parsed.where(~short | F.col("y_lo").isNull()).withColumn(
        "keys", F.when(short, F.array(key)).otherwise(_pairs(F.col("required"))))
    return _top(_dated(dated, tracks).unionByName(_by_blocks(others, tracks)))


def _keys(tokens):
    """All keys of a track."""
    return F.concat(F.array(F.lit("")), tokens, _pairs(tokens))


def _post(tracks: DataFrame, asked: DataFrame, keys, *columns: str) -> DataFrame:
    """Postings (key, columns) of the keys that are asked for."""
    return tracks.select(*columns, F.explode(keys).alias("key")).join(asked.select("key").distinct(), "key", "left_semi")


def _dated(few: DataFrame, tracks: DataFrame) -> DataFrame:
    """At most two tokens and years: heads of the key in each market and year."""
    posted = _post(tracks.where(F.col("t_year").isNotNull()), few, _keys(F.col("t_tokens")), "track_id", "popularity",
                   "t_year", "t_markets").withColumn("market", F.explode("t_markets")).drop("t_markets")
    span = tracks.agg(F.min("t_year").alias("first"), F.max("t_year").alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    dated = few.withColumns(
        {"_lo": F.greatest("y_lo", first), "_hi": F.least("y_hi", last)}).where("_lo <= _hi")
    by_year = dated.select(*QKEY, "key", F.explode(F.sequence("_lo", "_hi")).alias("t_year")) \
        .join(_heads(posted, "key", "market", "t_year"), ["key", "market", "t_year"])
    return by_year.select(*QKEY, "track_id", "popularity")


def postings(tracks: DataFrame, asked: DataFrame) -> tuple[DataFrame, str]:
    """Keys asked for, in blocks of the ranking: the tracks with their block, and
    the folder of the postings (key, track_id), written by block."""
    ranked = positions(tracks, [], [F.desc("popularity"), F.col("track_id")], name="_at")
    over = (F.col("_at") - 1) / FIRST_BLOCK
    block = F.when(over < 1, 0).otherwise(F.floor(F.log(float(GROWTH), over)) + 1).cast("int")
    placed = written(ranked.withColumn("block", block).drop("_at"), "tracks")
    path = f"{checkpoint_dir(tracks.sparkSession)}/postings-{uuid.uuid4().hex}"
    _post(placed, asked, _keys(F.col("t_tokens")), "track_id", "block") \
        .repartition("block", "key").write.partitionBy("block").parquet(path)
    return placed, path


def _by_blocks(many: DataFrame, tracks: DataFrame) -> DataFrame:
    """The postings of the rarest of each query's ``keys`` in order of the
    ranking, tested for the rest, until ten are found."""
    spark, cols = tracks.sparkSession, [*QKEY, "track_id", "popularity"]
    pairs = many.select(*QKEY, F.explode("keys").alias("key"))
    many = many.drop("keys")
    placed, path = postings(tracks, pairs)
    posted = spark.read.schema("key string, track_id " + tracks.schema["track_id"].dataType.simpleString()
                               + ", block int").parquet(path)
    stats = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("last"))
    # a key without postings answers its queries: they find nothing
    none = pairs.join(stats, "key", "left_anti").select(*QKEY).distinct()
    anchor = pairs.join(stats, "key").join(none, QKEY, "left_anti").groupBy(*QKEY).agg(
        F.min_by(F.struct("key", "last"), F.struct("n", "key")).alias("_a")).select(*QKEY, "_a.key", "_a.last")
    waiting = written(many.drop("n_tokens").join(anchor, QKEY), "waiting")
    end = waiting.agg(F.max("last")).first()[0]
    found = []
    for block in range(0 if end is None else end + 1):      # their number is a logarithm of the catalogue's size
        here = waiting.select(*QKEY, "required", "y_lo", "y_hi", "key") \
            .join(posted.where(F.col("block") == block).select("key", "track_id"), "key") \
            .join(placed.where(F.col("block") == block).drop("block"), "track_id")
        fits = ((F.size(F.array_except("required", "t_tokens")) == 0) & F.array_contains("t_markets", F.col("market"))
                & (F.col("y_lo").isNull() | ((F.col("t_year") >= F.col("y_lo")) & (F.col("t_year") <= F.col("y_hi")))))
        found.append(written(_top(here.where(fits).select(*cols)).select(*cols), "hits"))
        full = reduce(DataFrame.unionByName, found).groupBy(*QKEY).agg(F.count(F.lit(1)).alias("_n")) \
            .where(F.col("_n") >= HITS_PER_QUERY)
        waiting = written(waiting.where(F.col("last") > block).join(full, QKEY, "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    return reduce(DataFrame.unionByName, found) if found else many.select(
        *QKEY, F.lit(None).cast(tracks.schema["track_id"].dataType).alias("track_id"),
        F.lit(None).cast(tracks.schema["popularity"].dataType).alias("popularity")).limit(0)
