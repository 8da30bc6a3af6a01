"""Breakdowns: metrics by a category, a date interval, or a category and a second axis."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.dates import interval, interval_label
from tallyframe.functions.numeric import as_column, finite, num
from tallyframe.functions.text import trim_all
from tallyframe.operators.filters import Filter, apply_filters, visible_columns
from tallyframe.operators.metrics import RECORD_COUNT, Metric, MetricGroup, MetricPlan, filled
from tallyframe.operators.percentile import exact_percentiles
from tallyframe.session import stored

OTHER_LABEL = "Прочее"


@dataclass(frozen=True)
class Axis:
    """The second axis: ``date`` with a granularity, ``column`` with an optional top-N, or ``bucket``."""

    column: str
    kind: str = "column"
    granularity: str | None = None
    top_n: int | None = None
    buckets: int | None = None


#: Values that the counters of a heavy-hitter search may hold; what they miss has at most ``DOUBT / TRACKED`` of the rows.
TRACKED = 10_000
# Twice the error of the counters, as a value is only given when its lower bound is above the error.
DOUBT = 2 * 3.5 * 0.75
_COUNTED = (T.StringType, T.IntegralType, T.BooleanType, T.DateType)


def top_values(df: DataFrame, column: str, n: int) -> list:
    """The ``n`` most frequent values, counted exactly; ties go to the smaller value, null comes last among equals.

    Counters of bounded size, merged over the tasks, name the candidates; only those are counted, so the shuffle
    holds no more than the counters do. Where a value that is no candidate could still be as frequent as the last of
    the ``n``, all values are counted. Runs its jobs at once; the driver gets ``TRACKED`` values at most.
    """
    values = df.select(as_column(column).alias("v"))
    ranked = lambda counts: [(r["v"], r["count"]) for r in counts.orderBy(F.desc("count"), F.asc_nulls_last("v")).limit(n).collect()]
    tracked = max(TRACKED, n)
    seen = values.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(v, {tracked}, {tracked})").alias("top")).first()
    if not seen["n"]:
        return []
    beyond = seen["n"] * DOUBT / tracked
    found = sorted((t["count"] for t in seen["top"]), reverse=True)
    whole = sum(found) == seen["n"]  # perhaps there are no other values at all
    least = found[n - 1] - beyond if len(found) >= n and not whole else 0
    candidates = df.sparkSession.createDataFrame([(t["item"],) for t in seen["top"] if t["count"] >= least] + [(None,)], values.schema).distinct()
    counted = values.join(F.broadcast(candidates.withColumnRenamed("v", "c")), F.col("v").eqNullSafe(F.col("c")), "left_semi").groupBy("v").count()
    best = ranked(counted)
    sure = len(best) == n and best[-1][1] > beyond or whole and counted.agg(F.sum("count")).first()[0] == seen["n"]
    return [v for v, _ in (best if sure else ranked(values.groupBy("v").count()))]


def fold_top_n(df: DataFrame, column: str, n: int, into: str) -> DataFrame:
    """Add ``into``: the value if it is among the ``n`` most frequent, else the label for the rest.

    Ties go to the smaller value. Null takes part in the ranking but is always folded.
    """
    if isinstance(df.schema[column].dataType, _COUNTED):
        return df.withColumn(into, F.when(as_column(column).isin([v for v in top_values(df, column, n) if v is not None]), as_column(column).cast("string")).otherwise(OTHER_LABEL))
    ranked = df.groupBy(as_column(column).alias("__top")).count()
    top = ranked.orderBy(F.desc("count"), F.asc_nulls_last("__top")).limit(n).select("__top")
    joined = df.join(top, as_column(column) == F.col("__top"), "left")
    hit = F.col("__top").isNotNull()
    return joined.withColumn(into, F.when(hit, as_column(column).cast("string")).otherwise(OTHER_LABEL)).drop("__top")


def bucket_label(df: DataFrame, column: str, buckets: int) -> Column:
    """Number, from 1, of the equal-width bucket between the smallest and largest value."""
    v = finite(num(column))
    ends = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias("ends")).scalar()
    low, high = ends["low"], ends["high"]
    place = F.when(high > low, F.floor((v - low) / (high - low) * buckets)).when(v.isNotNull(), F.lit(0))
    number = F.when(place.isNotNull(), F.least(place, F.lit(buckets - 1)) + 1)  # least would pass over a null
    return F.lpad(number.cast("string"), len(str(buckets)), "0")


class Breakdown:
    """A breakdown of one table.

    ``rows()`` are the labelled rows, ``total()`` the row re-aggregated from them,
    both as lazy frames. ``limit`` keeps the leading rows only; the total then covers the
    kept rows and says so in ``truncated``. Medians and percentiles are computed without
    gathering a group in one task.
    """

    def __init__(
        self,
        df: DataFrame,
        metrics: Sequence[Metric | MetricGroup],
        by: str | None = None,
        axis: Axis | None = None,
        filters: Sequence[Filter] = (),
        limit: int | None = None,
    ):
        self.plan = MetricPlan(metrics, visible_columns(df))
        self.source = apply_filters(df, filters)
        self.limit = limit
        self._stored: DataFrame | None = None
        self._label(by, axis)

    def _label(self, by: str | None, axis: Axis | None) -> None:
        df = self.source
        known = self.plan.columns
        second = None
        # rows are grouped by the plain values and intervals; labels are made after the aggregation
        self.granularity: str | None = None
        if axis is not None and axis.column in known:
            if axis.kind == "date":
                second = interval(axis.column, axis.granularity)
                self.granularity = None if second is None else axis.granularity
            elif axis.kind == "bucket":
                second = bucket_label(df, axis.column, axis.buckets or 10)
            elif axis.top_n:
                df = fold_top_n(df, axis.column, axis.top_n, "__second")
                second = F.col("__second")
            else:
                second = as_column(axis.column)
        elif axis is not None:
            warnings.warn(f"unknown second axis ignored: {axis.column!r}", stacklevel=3)

        self.keys: list[str] = []
        labels: dict[str, Column] = {}
        self.by_first_metric = False
        if by is not None and by in known:
            labels["label"] = as_column(by)
            if second is not None:
                labels["date_label"] = second
            self.by_first_metric = second is None
        elif second is not None:
            labels["label"] = second
        elif by is not None:
            warnings.warn(f"unknown category gives an empty label: {by!r}", stacklevel=3)
            labels["label"] = F.lit(None).cast("string")
        self.keys = list(labels)
        needed = sorted({a.column for a in self.plan.aggs})
        # internal names, since the source may have a column called label
        self.labelled = df.select(*[c.alias(f"__{k}") for k, c in labels.items()], *map(as_column, needed))

    def grouped(self) -> DataFrame:
        """One row per label: keys, record count, partials and metric columns; all labels, in no order."""
        return self.plan.finish(self._partials(self.keys) if self._stored is None else self._stored)

    def store(self) -> Breakdown:
        """Aggregate once into the shared folder; rows and totals then come from there."""
        self._stored = stored(self._partials(self.keys))
        return self

    def _partials(self, by: Sequence[str], percentiles: bool = True) -> DataFrame:
        """The mergeable partials by group; without ``percentiles`` those are null and cost nothing."""
        keys = [f"__{k}" for k in by]
        wanted = [(a.key, a.column, a.p) for a in self.plan.percentiles]
        out = self.labelled.groupBy(*keys).agg(*self.plan.row_aggregates())
        if wanted and not percentiles:
            out = out.withColumns({name: F.lit(None).cast("double") for name, _, _ in wanted})
        elif wanted:
            holistic = exact_percentiles(self.labelled, keys, wanted)
            if keys:
                other = holistic.withColumnsRenamed({k: f"{k}__2" for k in keys})
                same = [F.col(k).eqNullSafe(F.col(f"{k}__2")) for k in keys]
                out = out.join(other, same, "left").drop(*[f"{k}__2" for k in keys])
            else:
                values = {name: holistic.select(as_column(name)).scalar() for name, _, _ in wanted}
                out = out.withColumns(values)
        out = out.withColumnsRenamed({f"__{k}": k for k in by})
        labels = {k: F.col(k).cast("string") for k in by}
        if self.granularity and by:
            labels[by[-1]] = interval_label(F.col(by[-1]), self.granularity)
        return out.withColumns(labels) if labels else out

    def _order(self) -> list[Column]:
        if "date_label" in self.keys:
            return [F.asc_nulls_last("date_label"), F.asc_nulls_last("label")]
        if self.by_first_metric and self.plan.names:
            return [as_column(self.plan.names[0]).desc_nulls_last(), F.asc_nulls_last("label")]
        return [F.asc_nulls_last("label")]

    def _kept(self) -> DataFrame:
        grouped = self.grouped()
        return grouped if self.limit is None or not self.keys else grouped.orderBy(*self._order()).limit(self.limit)

    def rows(self, ordered: bool = True) -> DataFrame:
        """Breakdown rows with trimmed labels; rows with a blank label are left out."""
        kept = self._kept()
        trimmed = {k: trim_all(k) for k in self.keys}
        shown = kept.withColumns(trimmed).where(filled("label")) if self.keys else kept
        shown = shown.select(*self.keys, RECORD_COUNT, *map(as_column, self.plan.names))
        return shown.orderBy(*self._order()) if ordered and self.keys else shown

    def total(self, exact: bool = False) -> DataFrame:
        """The total row.

        Sums and counts add up, extremes compare, averages are weighted, formulas are
        evaluated again on these. Approximate distinct counts and percentiles merge their sketches;
        exact ones cannot be re-aggregated and are null. ``exact`` computes every metric from the
        data rows instead. Rows with a blank label count.
        """
        if exact or not self.keys:
            whole = self.plan.finish(self._partials([]))
            return whole.select(RECORD_COUNT, *map(as_column, self.plan.names))
        merged = self._mergeable().agg(*self.plan.total_aggregates())
        total = self.plan.finish(merged, total=True)
        return total.select(F.coalesce(RECORD_COUNT, F.lit(0)).alias(RECORD_COUNT), *map(as_column, self.plan.names), *self._flag())

    def _mergeable(self) -> DataFrame:
        """The kept rows with their partials, without percentiles where nothing else has computed them."""
        if self.limit is None and self._stored is None:
            return self.plan.finish(self._partials(self.keys, percentiles=False))
        return self._kept()

    def totals_by_label(self) -> DataFrame:
        """The total of each label over the second axis, re-aggregated like :meth:`total`."""
        if "date_label" not in self.keys:
            raise ValueError("totals by label need a category and a second axis")
        merged = self._mergeable().groupBy(trim_all("label").alias("label")).agg(*self.plan.total_aggregates())
        total = self.plan.finish(merged.where(filled("label")), total=True)
        return total.select("label", RECORD_COUNT, *map(as_column, self.plan.names))

    def _flag(self) -> list[Column]:
        if self.limit is None:
            return []
        more = self.grouped().limit(self.limit + 1).agg(F.count(F.lit(1)).alias("n"))
        return [(more.scalar() > self.limit).alias("truncated")]


def total_records(rows: DataFrame) -> DataFrame:
    """Number of source records behind grouped rows."""
    return rows.agg(F.coalesce(F.sum(RECORD_COUNT), F.lit(0)).alias("total_records"))


def to_long(rows: DataFrame, groups: Sequence[MetricGroup], columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per result row, group and dashboard column; an unbound column is null."""
    cells = []
    for group in groups:
        for column in columns:
            metric = group.columns.get(column)
            present = metric is not None and MetricPlan.alias(group.id, metric) in rows.columns
            value = as_column(MetricPlan.alias(group.id, metric)) if present else F.lit(None)
            cells.append(
                F.struct(
                    F.lit(group.id).alias("group_id"),
                    F.lit(group.title).alias("group_name"),
                    F.lit(column).alias("metric_id"),
                    value.cast("double").alias("value"),
                )
            )
    return rows.select(*keys, RECORD_COUNT, F.inline(F.array(*cells)))
