"""Comparisons along an order: close values merged, ranks, and changes between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions.numeric import as_column
from tallyframe.session import stored

CLOSE_PERCENT = 0.5


def merge_close_values(points: DataFrame, tolerance_percent: float = CLOSE_PERCENT) -> DataFrame:
    """Join neighbouring values of a metric that are no further apart than a share of its span.

    ``points`` has ``metric, member, value``. Gives ``metric, low, high, y, members,
    is_overlap`` per run of close values: ``y`` is the mean of its points and ``members``
    counts the distinct (member, value) pairs in it.

    Values in one cell half a tolerance wide always belong together, so points are reduced
    to such cells first and only a few hundred rows per metric are ever put in order.
    """
    pairs = points.where(F.col("value").isNotNull()).groupBy("metric", "member", "value").agg(F.count(F.lit(1)).alias("n"))
    spans = points.groupBy(F.col("metric").alias("__m")).agg(
        F.min("value").alias("__low"),
        ((F.max("value") - F.min("value")) * (tolerance_percent / 100)).alias("__tolerance"),
    )
    tolerance = F.col("__tolerance")
    offset = F.col("value") - F.col("__low")
    cell = F.when(tolerance > 0, F.floor(offset / (tolerance / 2)).cast("double")).otherwise(F.col("value"))
    cells = (
        pairs.join(stored(spans), F.col("metric") == F.col("__m"))
        .groupBy("metric", cell.alias("cell"))
        .agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.sum(F.col("value") * F.col("n")).alias("s"),
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("members"),
            F.max("__tolerance").alias("tolerance"),
        )
    )
    if tolerance_percent == 0:
        merged = cells.withColumn("run", F.col("cell"))
    else:
        along = Window.partitionBy("metric").orderBy("cell")
        starts = F.when(F.col("low") - F.lag("high").over(along) <= F.col("tolerance"), 0).otherwise(1)
        merged = cells.withColumn("starts", starts).withColumn("run", F.sum("starts").over(along))
    return merged.groupBy("metric", "run").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        (F.sum("s") / F.sum("n")).alias("y"),
        F.sum("members").alias("members"),
        (F.sum("members") > 1).alias("is_overlap"),
    ).drop("run")


def best_ranked(rows: DataFrame, metric: str, n: int) -> DataFrame:
    """The rows ranked ``n`` or better by a metric, ties sharing a rank.

    The n-th best value is found first, so only the rows shown are ever in one window.
    """
    cut = rows.select(as_column(metric).alias("v")).orderBy(F.desc_nulls_last("v")).limit(n).agg(F.min("v")).scalar()
    above = rows.where(as_column(metric) >= cut)
    counts = above.groupBy(as_column(metric).alias("__v")).count()
    # at most n distinct values reach this window
    better = F.sum("count").over(Window.orderBy(F.desc("__v")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("__v", (F.coalesce(better, F.lit(0)) + 1).alias("rank"))
    return above.join(ranks, as_column(metric) == F.col("__v")).drop("__v")


def with_change(rows: DataFrame, metric: str, against: str = "previous") -> DataFrame:
    """Add the previous value of a label, the change and the change in percent.

    ``previous`` is the label's row before this one on the date axis; ``year_ago`` the row
    whose date label differs only in the year.
    """
    if against == "previous":
        # a label's rows are the intervals it occurs in
        before = F.lag(as_column(metric)).over(Window.partitionBy("label").orderBy("date_label"))
        out = rows.withColumn("previous_value", before)
    elif against == "year_ago":
        next_year = F.lpad((F.left("date_label", F.lit(4)).cast("int") + 1).cast("string"), 4, "0")
        earlier = rows.select(
            F.col("label").alias("__l"),
            F.concat(next_year, F.substring("date_label", 5, 20)).alias("__d"),
            as_column(metric).alias("previous_value"),
        )
        same = F.col("label").eqNullSafe(F.col("__l")) & (F.col("date_label") == F.col("__d"))
        out = rows.join(earlier, same, "left").drop("__l", "__d")
    else:
        raise ValueError(f"unknown comparison {against!r}")
    change = as_column(metric) - F.col("previous_value")
    return out.withColumn("change", change).withColumn(
        "change_percent", F.try_divide(change, F.col("previous_value")) * 100
    )
