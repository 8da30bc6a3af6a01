"""Percentiles without gathering a group, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import percentile as P


def check(spark, groups, wanted):
    rows = [(g, v) for g, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    out = P.exact_percentiles(df, ["g"], [(f"p{i}", "v", p) for i, p in enumerate(wanted)])
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for i, p in enumerate(wanted):
            assert got[g][f"p{i}"] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, p)


def test_small_groups_of_every_size(spark):
    rng = random.Random(2)
    groups = {f"g{n}": [round(rng.uniform(-9, 9), 1) for _ in range(n)] for n in range(1, 60)}
    check(spark, groups, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])


def test_one_group_holds_most_rows(spark):
    rng = random.Random(3)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(40_000)],
        "ties": [float(rng.randrange(3)) for _ in range(5_000)],
        "one value": [7.0] * 100,
        "skewed": [rng.expovariate(1) ** 6 for _ in range(20_000)],
        "tiny": [1.0, 2.0],
    }
    check(spark, groups, [0.01, 0.5, 0.75])


def test_coarse_sketch_is_still_exact(spark, monkeypatch):
    monkeypatch.setattr(P, "ACCURACY", 50)
    monkeypatch.setattr(P, "MARGIN", 5 / 50)
    monkeypatch.setattr(P, "CELLS", 16)
    rng = random.Random(4)
    check(spark, {"a": [rng.uniform(0, 1) for _ in range(3_000)], "b": [float(i) for i in range(1_001)]}, [0.3, 0.5])


def test_missing_values_do_not_count_and_the_plan_is_lazy(spark):
    rows = [("a", None), ("a", 1.0), ("a", float("nan")), ("a", 3.0), (None, 5.0), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    spark.sparkContext.setJobGroup("lazy", "building percentiles")
    out = P.exact_percentiles(df, ["g"], [("m", "v", 0.5)])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    assert {r["g"]: r["m"] for r in out.collect()} == {"a": 2.0, None: 5.0}


def test_a_group_of_nearly_all_rows_is_dealt_over_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "SALT_ROWS", 500)
    used = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in used}
    met = []
    real = P.with_brackets
    monkeypatch.setattr(P, "with_brackets", lambda *a: met.append(real(*a)) or met[-1])
    rng = random.Random(6)
    groups = {"hot": [float(rng.randrange(10_000)) for _ in range(36_000)]} | {f"g{i}": [rng.random() for _ in range(8)] for i in range(500)}
    try:
        for k, v in used.items():
            spark.conf.set(k, v)
        check(spark, groups, [0.5, 0.9])
        tasks = sorted(n for (n,) in met[0].groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 80_000 and len(tasks) == 8 and tasks[-1] <= 4 * tasks[len(tasks) // 2]
