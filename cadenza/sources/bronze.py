"""Bronze edge (S13, S15): nested columns travel as JSON text only here.

Remote replies land as JSON lines; inside the jobs everything is native
arrays and structs.  ``to_bronze`` encodes nested columns with
``to_json``; ``from_bronze`` decodes them with an explicit schema (never
inferred), so a malformed record becomes NULL instead of failing the job.

Whole responses are read with a column for lines that are no record of the
schema: ``read_responses`` gives the records and, apart from them, those lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import written

CORRUPT = "_corrupt_record"
#: A search response: one line for each query of a request, its items in rank
#: order, null for an item that the catalogue could not give.
RESPONSE = T.StructType().add("request_id", T.LongType()).add("query_idx", T.IntegerType()).add(
    "status", T.StringType()).add("items", T.ArrayType(T.StructType().add("track_id", T.LongType()).add(
        "popularity", T.IntegerType()).add("release_date", T.StringType())))


def to_bronze(df: DataFrame) -> DataFrame:
    """Nested columns -> JSON text columns of the same name."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                       for f in df.schema.fields])


def from_bronze(df: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON text columns -> typed columns following ``schema``."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out.append(F.from_json(F.col(f.name), f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def write_json_lines(df: DataFrame, path: str) -> None:
    to_bronze(df).write.mode("errorifexists").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    text_schema = T.StructType([T.StructField(f.name, T.StringType() if isinstance(
        f.dataType, (T.ArrayType, T.StructType, T.MapType)) else f.dataType) for f in schema.fields])
    return from_bronze(spark.read.schema(text_schema).json(path), schema)


def response_lines(hits: DataFrame) -> DataFrame:
    """Capped hits (at most ten a query) -> one JSON line ``value`` for each
    (request, query); a failed query has no items."""
    item = F.when(F.col("track_id").isNotNull(), F.struct("track_id", "popularity", "release_date"))
    # the rank first, so that the list is in order; null items keep their place
    ranked = F.array_sort(F.collect_list(F.struct("hit_rank", item.alias("item"))))
    lines = hits.groupBy("request_id", "query_idx").agg(F.max("status").alias("status"), ranked.alias("_r"))
    ok = F.col("status") == "ok"
    record = F.struct("request_id", "query_idx", "status",
                      F.when(ok, F.transform("_r", lambda r: r["item"])).alias("items"))
    return lines.select("request_id", "query_idx", F.to_json(record).alias("value"))


def read_responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(responses, quarantine): the records of the JSON lines at ``path``, and
    the lines that are none (cut off, no JSON, a field of another type, no
    request) with the request that their text still names, if any.

    The parsed lines are written once: a line's fate is settled by one parser
    run, and the quarantine does not parse the files again."""
    schema = T.StructType([*RESPONSE.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = written(spark.read.schema(schema).option("mode", "PERMISSIVE")
                     .option("columnNameOfCorruptRecord", CORRUPT).json(path), "bronze")
    bad = F.col(CORRUPT).isNotNull() | F.col("request_id").isNull() | F.col("query_idx").isNull()
    named = F.regexp_extract(F.coalesce(CORRUPT, F.lit("")), r'"request_id"\s*:\s*([0-9]{1,18})', 1)
    quarantine = parsed.where(bad).select(F.coalesce("request_id", F.nullif(named, F.lit("")).try_cast("long"))
                                          .alias("request_id"), F.col(CORRUPT).alias("line"))
    return parsed.where(~bad).drop(CORRUPT), quarantine


def response_hits(responses: DataFrame) -> DataFrame:
    """Responses -> search hits in the shape of ``search_hits``: one row an item,
    null items with a NULL track, and one row with neither rank nor track for a
    failed query, so that it is counted; none for a query that found nothing."""
    rows = responses.select("request_id", "query_idx", "status",
                            F.posexplode_outer(F.when(F.col("status") == "ok", F.col("items"))).alias("pos", "item"))
    found = rows.where(F.col("pos").isNotNull() | ~F.coalesce(F.col("status") == "ok", F.lit(False)))
    return found.select("request_id", "query_idx", (F.col("pos") + 1).alias("hit_rank"), "status", "item.*")
