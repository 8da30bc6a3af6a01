"""Two-axis results as wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.numeric import as_column, zero_if_null
from tallyframe.operators.breakdown import OTHER_LABEL
from tallyframe.operators.metrics import filled
from tallyframe.operators.normalize import share
from tallyframe.operators.views import Calc


def pivot_axis(cells: DataFrame) -> DataFrame:
    """Distinct labels of the second axis in display order: ascending, the folded rest last."""
    labels = cells.where(filled("date_label")).select("date_label").distinct()
    return labels.orderBy(F.col("date_label") == OTHER_LABEL, "date_label")


def axis_values(cells: DataFrame) -> list[str]:
    """The axis as column names, for :func:`pivot`; an axis too long for columns goes to :func:`long_cells`."""
    return [r[0] for r in pivot_axis(cells).collect()]


def row_totals(cells: DataFrame, metric: str, calc: Calc | None = None) -> DataFrame:
    """Total per label over its dated cells: a sum, or the formula on summed operands; 0 when empty."""
    dated = cells.where(filled("date_label"))
    if calc is None:
        return dated.groupBy("label").agg(zero_if_null(F.sum(as_column(metric))).alias("total"))
    total = calc.column(lambda c: F.sum(as_column(c)))
    return dated.groupBy("label").agg(zero_if_null(total).alias("total"))


def pivot(cells: DataFrame, metric: str, values: Sequence[str] | None = None, calc: Calc | None = None) -> DataFrame:
    """Labels down, second axis across, a ``total`` column; largest totals first."""
    values = axis_values(cells) if values is None else list(values)
    dated = cells.where(filled("date_label"))
    # labels that were equal only after trimming meet in one cell: they add up, a formula is evaluated again
    cell = F.sum(as_column(metric)) if calc is None else calc.column(lambda c: F.sum(as_column(c)))
    wide = dated.groupBy("label").pivot("date_label", values).agg(cell)
    if calc is None:
        parts = [zero_if_null(as_column(v)) for v in values]
        total = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
        out = wide.withColumn("total", total)
    else:
        out = wide.join(row_totals(cells, metric, calc), "label")
    return out.orderBy(F.desc_nulls_last("total"), "label")


def long_cells(cells: DataFrame, metric: str, calc: Calc | None = None) -> DataFrame:
    """The pivot in long form, for an axis of any length: ``label, date_label, value, total, share`` of the total."""
    value = F.sum(as_column(metric)) if calc is None else calc.column(lambda c: F.sum(as_column(c)))
    one = cells.where(filled("date_label")).groupBy("label", "date_label").agg(value.alias("value"))
    return one.join(row_totals(cells, metric, calc), "label").withColumn("share", share("value", F.col("total")))


def total_shares(totals: DataFrame) -> DataFrame:
    """Each row total's share of the grand total."""
    grand = totals.agg(F.sum("total")).scalar()
    return totals.withColumn("share", share("total", grand))
