"""Datasets under replacement, failure and repetition."""

import pytest
from pyspark.sql import functions as F

from tallyframe.sources.datasets import LOG, batches_of, load_dataset, save_dataset


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_reader_keeps_the_version_it_found(spark, tmp_path):
    path = str(tmp_path / "d")
    old = save_dataset(spark.range(10), path)
    new = save_dataset(old.where("id < 3").union(spark.range(50, 52)), path)  # from itself
    assert ids(old) == list(range(10)) and ids(new) == [0, 1, 2, 50, 51] == ids(load_dataset(spark, path))
    save_dataset(spark.range(100, 101), path, append=True)
    assert ids(new) == [0, 1, 2, 50, 51] and ids(load_dataset(spark, path)) == [0, 1, 2, 50, 51, 100]
    assert ids(save_dataset(spark.range(2), path)) == [0, 1]  # the appended rows went with what they were added to


@pytest.mark.parametrize("append", [False, True])
def test_a_failed_write_leaves_the_old_rows(spark, tmp_path, append):
    path = str(tmp_path / "d")
    save_dataset(spark.range(5), path, batch="a")
    broken = spark.range(8).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        save_dataset(broken, path, append=append, batch="b")
    assert ids(load_dataset(spark, path)) == list(range(5))
    assert ids(save_dataset(spark.range(7, 9), path, append=True, batch="b")) == [0, 1, 2, 3, 4, 7, 8]


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "d")
    for name, start in (("a", 0), ("b", 10), ("a", 0), ("b", 99)):
        save_dataset(spark.range(start, start + 2), path, append=True, batch=name)
    assert ids(load_dataset(spark, path)) == [0, 1, 10, 11]
    # written, but cut off before its line in the log; then two writers at once
    spark.range(20, 22).write.parquet(f"{path}/data-orphan")
    assert ids(load_dataset(spark, path)) == [0, 1, 10, 11]
    for folder in ("data-x", "data-y"):
        spark.range(30, 32).write.parquet(f"{path}/{folder}")
        spark.createDataFrame([(9, False, "c", folder)], "version long, replaces boolean, batch string, folder string").write.mode("append").parquet(f"{path}/{LOG}")
    assert ids(load_dataset(spark, path)) == [0, 1, 10, 11, 30, 31]
    assert [r["batch"] for r in batches_of(spark, path).collect()] == ["a", "b", "c"]


def test_appended_columns_are_matched_by_name_and_plain_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "d")
    save_dataset(spark.range(1).withColumn("x", F.lit("a")), path)
    both = save_dataset(spark.range(1, 2).withColumn("y", F.lit(2.0)), path, append=True)
    assert sorted(map(tuple, both.select("id", "x", "y").collect())) == [(0, "a", None), (1, None, 2.0)]
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    assert ids(load_dataset(spark, str(tmp_path / "plain"))) == [0, 1, 2]
