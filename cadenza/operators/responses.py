"""Model-reply tables -> criteria, query rows and titles.

Input: ``attempts(request_id, kind, attempt, raw_text)``, kind one of
``criteria``, ``queries``, ``title``.  All parsing is column expressions
(``cadenza.functions.replies``); the only shuffles are that of the criteria
texts before they are typed and the per-request aggregate of W7, which is a
partial aggregate (``min_by``/``max_by``), so a request with many attempts
costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.replies import parse_reply, query_list, title_pair, typed_criteria

MAX_ATTEMPTS = 3          # first try + two retries


def typed_attempts(attempts: DataFrame) -> DataFrame:
    """F1 + F2 + F3 per criteria attempt: every field typed, ``ok``, ``error``."""
    c = attempts.where(F.col("kind") == "criteria").select("request_id", "attempt", "raw_text")
    return typed_criteria(c).select("request_id", "attempt", "c.*")


def first_valid(typed: DataFrame) -> DataFrame:
    """The first valid attempt among the first three; when none is
    valid the request fails with the last error seen."""
    within = F.col("attempt") <= MAX_ATTEMPTS
    fields = [c for c in typed.columns if c not in ("request_id", "attempt", "ok", "error")]
    good_order = F.when(within & F.col("ok"), F.col("attempt"))
    agg = typed.groupBy("request_id").agg(
        F.min(good_order).alias("attempt"),
        F.min_by(F.struct(*fields), good_order).alias("c"),
        F.max_by(F.col("error"), F.when(within, F.col("attempt"))).alias("last_error"))
    return agg.select(
        "request_id",
        F.when(F.col("attempt").isNotNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        "attempt",
        *[F.col(f"c.{f}").alias(f) for f in fields],
        F.when(F.col("attempt").isNull(), F.col("last_error")).alias("error"))


def criteria_table(attempts: DataFrame) -> DataFrame:
    """L4: one row per request, ``status`` ok/failed.  Attempts past the
    third are never made, so they are dropped before the typing work.

    Typing costs far more than reading: the texts are dealt out first, so that
    it takes as many tasks as a shuffle has, however few files hold them.  They
    are dealt by request and attempt; the aggregate keeps its map-side half."""
    made = attempts.where((F.col("kind") == "criteria") & (F.col("attempt") <= MAX_ATTEMPTS))
    return first_valid(typed_attempts(made.repartition("request_id", "attempt")))


def quarantine(attempts: DataFrame) -> DataFrame:
    """L4 quarantine: every rejected criteria attempt with its reason."""
    t = typed_attempts(attempts)
    return t.where(~F.col("ok")).select("request_id", "attempt", "error")


def query_rows(attempts: DataFrame) -> DataFrame:
    """``(request_id, query_idx, query)``, query_idx 1-based, at most 6."""
    q = attempts.where(F.col("kind") == "queries").select("request_id", parse_reply(F.col("raw_text")).alias("_v"))
    return q.select("request_id", F.posexplode(query_list(F.col("_v"))).alias("pos", "query")) \
        .select("request_id", (F.col("pos") + 1).alias("query_idx"), "query")


def titles(attempts: DataFrame) -> DataFrame:
    """``(request_id, title, description)``."""
    t = attempts.where(F.col("kind") == "title").select("request_id", parse_reply(F.col("raw_text")).alias("_v"))
    return t.select("request_id", title_pair(F.col("_v")).alias("t")) \
        .select("request_id", "t.title", "t.description")
