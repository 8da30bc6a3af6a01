"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", name: str = "tallyframe", memory: str | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites cost milliseconds for each column expression
    )
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under the folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, as in tests, a folder of the warehouse is set, which every session has.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/tallyframe-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back.

    Cuts the lineage, and gives Spark the true size: a small table is then broadcast and a
    large one joined by shuffle, without a guess.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
