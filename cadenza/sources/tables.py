"""Reading the driver's parquet tables.

Only the columns a job names are read: ``read_table(..., columns=[...])``
puts a projection right on the scan, so the parquet reader prunes the
rest and later filters are pushed into the scan (``PushedFilters``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Timestamp columns arrive as TIMESTAMP_NTZ from parquet; watermarks and
# session windows need TIMESTAMP (T4).  With the session zone at UTC the
# cast keeps the wall-clock value.
_TS_COLUMNS = {"l_shipdate", "o_orderdate", "ts"}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns is not None:
        df = df.select(*columns)
    casts = [F.col(c).cast("timestamp").alias(c) if c in _TS_COLUMNS else F.col(c)
             for c in df.columns]
    return df.select(*casts)
