"""Spark session settings shared by the jobs, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  UTC because stored timestamps are zone-less
# UTC values; AQE so that join strategy, partition count and skew splitting
# are decided on measured shuffle sizes rather than on estimates.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "cadenza", extra: dict | None = None) -> SparkSession:
    """Session for local runs (tests, bench).  On a cluster the launcher
    supplies master, memory and partition counts; only BASE_CONF matters."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for key, value in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and snapshot tables.

    A cluster names it in ``spark.checkpoint.dir``; that value is always
    used.  Only a local-mode session without the setting (tests, bench)
    gets a fresh scratch folder, registered with the context so later calls
    agree.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="cadenza-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    # setCheckpointDir adds a unique sub-folder; report what Spark uses.
    return sc.getCheckpointDir() or path


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table written once to the shared folder and read back: every later
    branch sees the same rows, also after a lost executor."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
