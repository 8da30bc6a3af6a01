"""Saved datasets that can be replaced while they are read, and batches that are added once.

A dataset is a folder with a log and a folder of Parquet files for each write. What is written becomes part of the
dataset with its line in the log, a file that Spark commits by one rename, so a write that fails, or is cut off
before, leaves the dataset as it was. A reader resolves the log once: to the last replacement and what was appended to
it since, each batch id counting once. What it has resolved is never changed or removed, so it can go on reading, or
replace the dataset from itself. Folders of former versions stay until the storage's retention removes them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOG = "_log"
_LOG_SCHEMA = "version long, replaces boolean, batch string, folder string"


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LOG_SCHEMA).parquet(f"{path.rstrip('/')}/{LOG}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _members(spark: SparkSession, path: str) -> list:
    """The log's lines that make up the dataset: the last replacement, then the appended batches, each once.

    A line a write; two writers that add the same batch at once are settled here, by folder name.
    """
    log = _log(spark, path)
    if log is None:
        return []
    lines = log.collect()
    base = max((r for r in lines if r["replaces"]), key=lambda r: (r["version"], r["folder"]), default=None)
    since = [r for r in lines if not r["replaces"] and (base is None or r["version"] > base["version"])]
    batches: dict[str, object] = {}
    for r in sorted(since, key=lambda r: r["folder"]):
        if base is None or r["batch"] != base["batch"]:
            batches.setdefault(r["batch"], r)
    return ([base] if base else []) + sorted(batches.values(), key=lambda r: (r["version"], r["folder"]))


def save_dataset(df: DataFrame, path: str, append: bool = False, max_rows_per_file: int | None = None, batch: str | None = None) -> DataFrame:
    """Persist a dataset as Parquet, in place of what is there or added to it, and give it back as read from there.

    A ``batch`` that the dataset already holds is not written again.
    """
    spark = df.sparkSession
    members = _members(spark, path)
    if append and batch is not None and any(r["batch"] == batch for r in members):
        return load_dataset(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", max_rows_per_file) if max_rows_per_file else df.write
    writer.parquet(f"{path.rstrip('/')}/{folder}")
    line = [(max((r["version"] for r in members), default=0) + 1, not append, batch or folder, folder)]
    spark.createDataFrame(line, _LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{LOG}")
    return load_dataset(spark, path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The dataset as it is now; later writes do not change what this frame reads. A folder without a log is plain Parquet."""
    members = _members(spark, path)
    if not members:
        return spark.read.parquet(path)
    folders = [f"{path.rstrip('/')}/{r['folder']}" for r in members]
    return spark.read.option("mergeSchema", len(folders) > 1).parquet(*folders)


def batches_of(spark: SparkSession, path: str) -> DataFrame:
    """``batch, folder, version`` of what the dataset is made of."""
    rows = [(r["batch"], r["folder"], r["version"]) for r in _members(spark, path)]
    return spark.createDataFrame(rows, "batch string, folder string, version long").orderBy("version", "folder")
