"""Domain tables derived from the driver's TPC-H-style tables.

The application's inputs (search hits, criteria, ranked top items, plays,
model replies, playlists) come from remote services in the original; here
each is a deterministic projection of a driver table, so every job's work
grows with the data.  The same derivations are written in DuckDB SQL in
``cadenza.plans.oracles`` for the correctness gate.

Every derivation is a narrow projection (no shuffle) unless it says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.sources.tables import read_table


def _release_text(ts, selector):
    """Release dates come at year, month or day precision."""
    return (F.when(selector % 3 == 0, F.date_format(ts, "yyyy"))
            .when(selector % 3 == 1, F.date_format(ts, "yyyy-MM"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd")))


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze ``search_hits(request_id, query_idx, hit_rank, status, ...)``.

    request = order, query = line number, hit = line item.  ``hit_rank`` is
    the service's ranking: extended price descending, then the remaining
    columns so that only fully identical rows tie.  The window is keyed by
    (request, query); a later ``hit_rank <= k`` lets Spark plan a partial
    WindowGroupLimit before the exchange.

    One query in 23 failed (status ``error``, S12), the hits of one supplier in
    29 are null items (P6), and those of one in 31 have a date whose year is no
    number (P4).
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                     "l_linestatus", "l_shipdate"])
    # Keyed by the output names, so filters on request/query push through
    # the window down to the scan.  All else is derived after the window, so
    # that its exchange carries the table's columns only.
    named = li.withColumnsRenamed({"l_orderkey": "request_id", "l_linenumber": "query_idx"})
    order = Window.partitionBy("request_id", "query_idx").orderBy(
        F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    ranked = named.withColumn("hit_rank", F.row_number().over(order))
    return ranked.select(
        "request_id", "query_idx", "hit_rank",
        F.when((F.col("request_id") * 7 + F.col("query_idx")) % 23 == 0, F.lit("error")).otherwise(F.lit("ok"))
         .alias("status"),
        F.when(F.col("l_suppkey") % 29 != 0, F.col("l_partkey")).alias("track_id"),
        F.col("l_quantity").cast("int").alias("popularity"),
        F.when(F.col("l_suppkey") % 31 == 0, F.concat(F.lit("19xx-"), F.date_format("l_shipdate", "MM")))
         .otherwise(_release_text(F.col("l_shipdate"), F.col("l_suppkey"))).alias("release_date"))


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated criteria per request (one row per order).

    Years are the order year +-1; priority 5 has no lower bound (NULL),
    priority 4 a zero lower bound (also no bound), priority 3 no upper
    bound.  The track limit is 1..6.  Two requests in seven name no market.
    """
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    year = F.year("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("int"))
         .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(0))
         .otherwise(year - 1).alias("year_min"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(None).cast("int"))
         .otherwise(year + 1).alias("year_max"),
        (F.col("o_orderkey") % 6 + 1).cast("int").alias("track_limit"),
        F.get(F.array(*map(F.lit, MARKETS)), (F.col("o_orderkey") % 7).cast("int")).alias("market"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track catalogue: one track per part.

    artist = brand (plus a guest artist for sizes divisible by 5), album =
    type, genres = lower-case type and the first word of the name, release
    year = 1975 + size, duration and popularity from the retail price.  Some tracks lack a
    name, a preview, an external URL or cover images.  A track is on sale in
    all markets but one or two.
    """
    p = read_table(spark, sf_dir, "part",
                   ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    artists = F.when(size % 5 == 0,
                     F.array(F.struct(F.col("p_brand").alias("name")),
                             F.struct(F.concat(F.lit("Guest "), size.cast("string")).alias("name"))))
    artists = artists.otherwise(F.array(F.struct(F.col("p_brand").alias("name"))))
    images = F.when(size % 3 == 0, F.array().cast("array<struct<url:string>>")).otherwise(
        F.array(F.struct(F.concat(F.lit("img:"), key, F.lit(":640")).alias("url")),
                F.struct(F.concat(F.lit("img:"), key, F.lit(":64")).alias("url"))))
    return p.select(
        F.col("p_partkey").alias("track_id"),
        F.concat(F.lit("track:"), key).alias("uri"),
        F.when(size % 25 != 0, F.col("p_name")).alias("name"),
        artists.alias("artists"),
        F.struct(F.col("p_type").alias("name"),
                 F.concat((size + 1975).cast("string"), F.lit("-01-01")).alias("release_date"),
                 images.alias("images")).alias("album"),
        F.array(F.lower("p_type"), F.split("p_name", " ").getItem(0)).alias("genres"),
        F.floor(F.col("p_retailprice") * 200).cast("bigint").alias("duration_ms"),
        (F.floor("p_retailprice") % 100).cast("int").alias("popularity"),
        F.when(size % 4 != 0, F.concat(F.lit("preview:"), key)).alias("preview_url"),
        F.when(size % 7 != 0, F.concat(F.lit("https://tracks.example/t/"), key)).alias("external_url"),
        F.filter(F.array(*map(F.lit, MARKETS)), lambda m, i: (i != F.col("p_partkey") % 6) & (i != size % 9))
         .alias("markets"),
    )


#: Markets of the catalogue; the model replies ask for some of them.
MARKETS = ["FR", "US", "DE", "GB", "JP"]




def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events",
                    ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ev.withColumn("item_key", F.get_json_object("props", "$.k").cast("bigint"))


def term_of(event_type):
    """The time range that an event type stands for (1 to 3)."""
    return F.when(event_type.isin("view", "signup"), 1).when(event_type.isin("click", "error"), 2).otherwise(3)


def top_items_raw(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Bronze ranked lists ``(user_id, term_ord, time_range, rank, item_key)``.

    view and signup events are the short-term list, click and error events
    the medium-term list, all others the long-term list; the rank within a
    (user, range) list is by value descending, then event id.  Ranks are not
    capped here; the 50-per-range read (S10) is the job's filter.  ``until``
    gives the lists as they were at that time, from the events before it.
    """
    ev = _events(spark, sf_dir)
    if until is not None:
        ev = ev.where(F.col("ts") < F.lit(until).cast("timestamp"))
    ev = ev.withColumn("term_ord", term_of(F.col("event_type")))
    w = Window.partitionBy("user_id", "term_ord").orderBy(F.desc("value"), "event_id")
    names = F.array(*[F.lit(t) for t in ("short_term", "medium_term", "long_term")])
    return ev.select(
        "user_id", "term_ord",
        F.element_at(names, F.col("term_ord")).alias("time_range"),
        F.row_number().over(w).alias("rank"),
        "item_key",
    )


def track_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track payload per item key: ``(item_key, id, name, artists, uri)``."""
    cat = catalogue(spark, sf_dir)
    return cat.select(F.col("track_id").alias("item_key"),
                      F.col("track_id").cast("string").alias("id"),
                      "name", "artists", "uri")


def artist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist payload per item key: the brand of the part, with the part's
    genres (type, first name word; sizes divisible by 10 repeat the type)."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    genres = F.when(F.col("p_size") % 10 == 0,
                    F.array(F.lower("p_type"), F.split("p_name", " ").getItem(0), F.lower("p_type"))) \
        .otherwise(F.array(F.lower("p_type"), F.split("p_name", " ").getItem(0)))
    return p.select(F.col("p_partkey").alias("item_key"),
                    F.col("p_brand").alias("id"), F.col("p_brand").alias("name"),
                    genres.alias("genres"),
                    F.concat(F.lit("artist:"), F.col("p_brand")).alias("uri"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play log ``(user_id, track_id, played_at, event_id)``: every event."""
    ev = _events(spark, sf_dir)
    return ev.select("user_id", F.col("item_key").alias("track_id"),
                     F.col("ts").alias("played_at"), "event_id")


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-listen audio features ``(user_id, played_at, energy, valence,
    danceability, acousticness, tempo)`` from line items joined to their order's customer.
    Zero discount / zero tax / quantity one / part keys divisible by 11 /
    supplier keys divisible by 6 stand for a missing value."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("played_at"),
        (F.nullif("l_discount", F.lit(0.0)) * 10).alias("energy"),
        (F.nullif("l_tax", F.lit(0.0)) * 12.5).alias("valence"),
        (F.nullif(F.col("l_partkey") % 11, F.lit(0)) / 10.0).alias("danceability"),
        (F.nullif(F.col("l_suppkey") % 6, F.lit(0)) / 5.0).alias("acousticness"),
        F.nullif("l_quantity", F.lit(1.0)).alias("tempo"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer", ["c_custkey"]).select(
        F.col("c_custkey").alias("user_id"))


def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio features per catalogue track (R4, R6): energy = size/50,
    valence, danceability and acousticness from the key, tempo = price/10."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_retailprice", "p_type"])
    return p.select(
        F.col("p_partkey").alias("track_id"),
        F.lower("p_type").alias("genre"),
        (F.col("p_size") / 50.0).alias("energy"),
        ((F.col("p_partkey") % 100) / 100.0).alias("valence"),
        (F.col("p_retailprice") / 10.0).alias("tempo"),
        ((F.col("p_partkey") * 7 % 100) / 100.0).alias("danceability"),
        ((F.col("p_partkey") * 3 % 100) / 100.0).alias("acousticness"),
    )


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored playlists: one per order.  Status F = saved (external id and
    URL), P = URL present but empty, O = never saved.  ``created_text`` is the
    date as text, one in 13 no ISO date (F7)."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                    "o_orderpriority", "o_totalprice"])
    key = F.col("o_orderkey").cast("string")
    status = F.col("o_orderstatus")
    return o.select(
        key.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("music for "), F.lower(F.substring("o_orderpriority", 3, 20))).alias("user_prompt"),
        F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("around "), F.year("o_orderdate").cast("string")))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_text"),
        F.concat(F.lit("Mix "), key).alias("title"),
        (F.col("o_orderkey") % 60 + 1).cast("int").alias("track_count"),
        F.when(status == "F", F.concat(F.lit("ext"), key)).alias("external_id"),
        F.when(status == "F", F.concat(F.lit("https://lists.example/p/"), key))
         .when(status == "P", F.lit("")).alias("external_url"),
    )


UNKNOWN_ID_OFFSET = 1_000_000_000   # ids shifted past every order key never exist


def link_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 change set ``(playlist_id, external_id, external_url, update_seq)``:
    urgent orders get a link; urgent open orders a second, later one; high
    priority orders name an id that does not exist."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    k = F.col("o_orderkey").cast("string")
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT")
    first = urgent.select(k.alias("playlist_id"), F.concat(F.lit("ext2-"), k).alias("external_id"),
                          F.concat(F.lit("https://lists.example/p2/"), k).alias("external_url"),
                          F.lit(1).alias("update_seq"))
    second = urgent.where(F.col("o_orderstatus") == "O").select(
        k.alias("playlist_id"), F.concat(F.lit("ext3-"), k).alias("external_id"),
        F.concat(F.lit("https://lists.example/p3/"), k).alias("external_url"), F.lit(2).alias("update_seq"))
    ghost_key = (F.col("o_orderkey") + UNKNOWN_ID_OFFSET).cast("string")
    ghost = o.where(F.col("o_orderpriority") == "2-HIGH").select(
        ghost_key.alias("playlist_id"), F.lit("ext-x").alias("external_id"),
        F.lit("https://lists.example/x").alias("external_url"), F.lit(1).alias("update_seq"))
    return first.unionByName(second).unionByName(ghost)


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 change set ``(requester_id, playlist_id)``: returned first lines
    ask to delete their order's playlist (repeats arise from repeated
    lines), all other returned lines name an id that does not exist."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag"])
    r = li.where(F.col("l_returnflag") == "R")
    key = F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")) \
        .otherwise(F.col("l_orderkey") + UNKNOWN_ID_OFFSET)
    return r.select(
        F.col("l_suppkey").alias("requester_id"), key.cast("string").alias("playlist_id"))


def relaunch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 input ``(request_id, playlist_id)``: high-priority orders relaunch
    the playlist three orders back (absent for the first keys)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    pid = F.when(F.col("o_orderpriority") == "2-HIGH", (F.col("o_orderkey") - 3).cast("string"))
    return o.select(F.col("o_orderkey").alias("request_id"), pid.alias("playlist_id"))


def profile_writes(spark: SparkSession, sf_dir: str):
    """S3 input: the stored summary per user (first half of the log) and
    two later writes in order: second-half summaries (seq 1), then
    error-only summaries over the whole log (seq 2)."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type"])

    def summary(df):
        return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("synced_at"))
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    existing = summary(ev.where(F.col("ts") < cut))
    w1 = summary(ev.where(F.col("ts") >= cut)).withColumn("load_seq", F.lit(1))
    w2 = summary(ev.where(F.col("event_type") == "error")).withColumn("load_seq", F.lit(2))
    return existing, w1.unionByName(w2)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming requests ``(request_id, user_id, prompt)``, one per order.
    The prompt cycles through blank, too short, padded, plain and
    over-long texts (key % 5)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    k = F.col("o_orderkey")
    sel = k % 5
    prompt = (F.when(sel == 0, F.lit("  \t\n "))
              .when(sel == 1, F.concat(F.lit(" ab"), (k % 10).cast("string"), F.lit(" ")))
              .when(sel == 2, F.concat(F.lit("  music for "), F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("\n")))
              .when(sel == 3, F.concat(F.lit("songs like order "), k.cast("string")))
              .otherwise(F.repeat(F.lit("la "), 200)))
    return o.select(k.alias("request_id"), F.col("o_custkey").alias("user_id"), prompt.alias("prompt"))


def request_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request came in ``(request_id, requested_at)``."""
    return read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("requested_at"))


def synced_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who ever synced a profile: those present in the event log."""
    return read_table(spark, sf_dir, "events", ["user_id"]).distinct()
