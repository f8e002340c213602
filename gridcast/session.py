"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; all of them are plain Spark SQL options.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "gridcast", master: str | None = None, **conf) -> SparkSession:
    """Build (or fetch) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names.

    ``spark.checkpoint.dir`` is where intermediate tables and streaming
    checkpoints go, so that they outlive any executor. Where it is unset, a
    session on one machine (tests) gets a temporary folder; a cluster must name one.
    """
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridcast-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once that several branches of a job read.

    The rows go to the shared checkpoint folder, so losing an executor costs a
    read, not a recomputation, and the hash partitioning of the rows is kept:
    what follows needs no new shuffle.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_base(spark))
    return df.checkpoint(eager=True)
