"""The view of one metric group at a place in the hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.numeric import as_column
from tallyframe.operators.breakdown import Axis, Breakdown
from tallyframe.operators.filters import Path
from tallyframe.operators.metrics import Metric
from tallyframe.operators.normalize import normalize, normalize_by_period
from tallyframe.operators.report import overlay
from tallyframe.operators.views import Calc, DisplayRule, display_filter, display_filter_2d, row_order, sort_rows


@dataclass(frozen=True)
class GroupView:
    """Drill-down of a group's metrics with entered values, display filters, shares and an order."""

    metrics: Sequence[Metric]
    rules: Sequence[DisplayRule] = ()
    sort_key: str | None = None
    descending: bool = True
    axis: Axis | None = None
    calcs: Mapping[str, Calc] = field(default_factory=dict)
    limit: int | None = None

    def breakdown(self, df: DataFrame, path: Path) -> Breakdown:
        return Breakdown(df, self.metrics, path.next_level, self.axis, path.filters, self.limit)

    def rows(self, df: DataFrame, path: Path, entered: DataFrame | None = None) -> DataFrame:
        """Rows of the next level as shown.

        The order of steps decides the numbers: entered values, then display filters, then
        shares of what is left, then the sort. The total row is never normalised.
        """
        names = [m.id for m in self.metrics]
        formats = {m.id: m.fmt for m in self.metrics}
        b = self.breakdown(df, path)
        rows = b.rows(ordered=False)
        if "date_label" in b.keys:
            if entered is not None:
                raise ValueError("entered values belong to nodes and have no place on a second axis")
            rows = display_filter_2d(rows, self.rules, names, formats, self.calcs, path.depth)
            return self._two_axes(rows)
        if entered is not None:
            rows = overlay(rows, entered, [n for n in names if n in entered.columns], path.values)
        rows = display_filter(rows, self.rules, formats, path.depth)
        rows = normalize(rows, {m.id: m.normalize_by for m in self.metrics if m.normalize_by})
        return sort_rows(rows, self.sort_key, self.descending) if self.sort_key else rows

    def _two_axes(self, rows: DataFrame) -> DataFrame:
        """Shares of each period's own reference; labels by their total over the periods, or by name."""
        shown = rows
        for m in self.metrics:
            if m.normalize_by:
                shown = normalize_by_period(shown, m.id, m.normalize_by)
        if not self.sort_key:
            return shown.orderBy("date_label", "label")
        if self.sort_key == "label":
            return shown.orderBy(*row_order("label", self.descending), "date_label")
        totals = rows.groupBy(F.col("label").alias("__of")).agg(F.sum(as_column(self.sort_key)).alias("__total"))
        total = F.desc_nulls_last("__total") if self.descending else F.asc_nulls_first("__total")
        return shown.join(totals, F.col("label") == F.col("__of")).orderBy(total, "label", "date_label").drop("__of", "__total")

    def total(self, df: DataFrame, path: Path) -> DataFrame:
        return self.breakdown(df, path).total()
