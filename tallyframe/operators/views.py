"""What is done to breakdown rows before they are shown: filters, orders, pages, unions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.functions.display import display_scale, format_value, meets, rule_color
from tallyframe.functions.formula import Term, result_column
from tallyframe.functions.numeric import as_column, zero_if_null
from tallyframe.functions.text import natural_key
from tallyframe.operators.metrics import RECORD_COUNT, Metric
from tallyframe.session import shared_folder, stored

PAGE_SIZE = 50
SERIES_LIMIT = 8
RELATIVE_EPSILON = 1e-9


@dataclass(frozen=True)
class DisplayRule:
    """Keep rows whose metric meets the rule, at one depth of the hierarchy only."""

    metric: str
    op: str
    value: float = 0.0
    value2: float | None = None
    compare: str | None = None
    level: int = 0


@dataclass(frozen=True)
class Calc:
    """A formula over other metric columns of the same result: alias -> column."""

    formula: Callable
    operands: Mapping[str, str]

    def column(self, values: Callable[[str], Column]) -> Column:
        terms = {alias: Term(zero_if_null(values(c))) for alias, c in self.operands.items()}
        return result_column(self.formula(**terms))


def metrics_compare(a: Column, op: str, b: Column) -> Column:
    """Metric against metric, with a tolerance that grows with the values; ``between`` means unequal."""
    eps = F.greatest(F.lit(1.0), F.abs(a), F.abs(b)) * RELATIVE_EPSILON
    tests = {
        ">": a - b > eps,
        ">=": a - b > -eps,
        "<": b - a > eps,
        "<=": b - a > -eps,
        "==": F.abs(a - b) <= eps,
        "!=": F.abs(a - b) > eps,
        "between": F.abs(a - b) > eps,
    }
    return tests.get(op, F.lit(False))


def rule_condition(rule: DisplayRule, formats: Mapping[str, str | None]) -> Column:
    left = display_scale(rule.metric, formats.get(rule.metric))
    if rule.compare:
        return metrics_compare(left, rule.op, display_scale(rule.compare, formats.get(rule.compare)))
    return meets(left, rule.op, rule.value, rule.value2)


def display_filter(
    rows: DataFrame, rules: Sequence[DisplayRule], formats: Mapping[str, str | None] | None = None, depth: int = 0
) -> DataFrame:
    """Rows meeting every rule of this depth, compared in display scale; a missing value fails."""
    active = [r for r in rules if r.level == depth]
    known = set(rows.columns)
    if any(r.metric not in known or (r.compare and r.compare not in known) for r in active):
        return rows.where(F.lit(False))
    conditions = [rule_condition(r, formats or {}) for r in active]
    return rows.where(reduce(and_, conditions)) if conditions else rows


def label_totals(cells: DataFrame, metrics: Sequence[str], calcs: Mapping[str, Calc] | None = None) -> DataFrame:
    """One row per label of a two-axis result: metrics summed, calculated ones evaluated on sums."""
    calcs = calcs or {}
    summed = dict.fromkeys([m for m in metrics if m not in calcs] + [c for k in calcs.values() for c in k.operands.values()])
    totals = cells.groupBy("label").agg(
        F.sum(RECORD_COUNT).alias(RECORD_COUNT), *[F.sum(as_column(m)).alias(f"__t__{m}") for m in summed]
    )
    total_of = lambda m: as_column(f"__t__{m}")
    return totals.select(
        "label",
        RECORD_COUNT,
        *[(calcs[m].column(total_of) if m in calcs else total_of(m)).alias(m) for m in metrics],
    )


def display_filter_2d(
    cells: DataFrame,
    rules: Sequence[DisplayRule],
    metrics: Sequence[str],
    formats: Mapping[str, str | None] | None = None,
    calcs: Mapping[str, Calc] | None = None,
    depth: int = 0,
) -> DataFrame:
    """Cells of the labels whose totals meet the rules."""
    if not any(r.level == depth for r in rules):
        return cells
    passing = display_filter(label_totals(cells, metrics, calcs), rules, formats, depth).select("label")
    return cells.join(passing, "label", "left_semi")


def search(rows: DataFrame, text: str, name: str | None = None) -> DataFrame:
    """Rows whose label, or dictionary name, contains the text in any case."""
    if not text:
        return rows
    needle = text.lower()
    hit = F.lower("label").contains(needle)
    return rows.where(hit | F.lower(as_column(name)).contains(needle) if name else hit)


def row_order(key: str = "label", descending: bool = False) -> list[Column]:
    """The order by label (natural), record count, or a metric whose nulls count as minus infinity."""
    if key == "label":
        k = natural_key("label")
        return [k.desc(), F.desc("label")] if descending else [k.asc_nulls_last(), F.asc_nulls_last("label")]
    k = as_column(key)
    return [k.desc_nulls_last() if descending else k.asc_nulls_first(), F.asc_nulls_last("label")]


def sort_rows(rows: DataFrame, key: str = "label", descending: bool = False) -> DataFrame:
    """The rows in :func:`row_order`."""
    return rows.orderBy(*row_order(key, descending))


def placed(rows: DataFrame, order: Sequence[Column | str], into: str = "place") -> DataFrame:
    """Rows with their place, from 1, in a given order; ties are decided by the other columns.

    The sorted rows are stored with their number in their partition, to which the rows of earlier partitions are
    added: no window over all rows.
    """
    ties = [as_column(f.name) for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    kept = stored(rows.orderBy(*order, *ties).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return kept.join(starts, part == F.col("__part")).withColumn(into, place).drop("__id", "__part", "__start")


class Pages:
    """A result put in order and stored once, with the number of rows in each of its sorted ranges.

    A page is read from the one or two ranges that hold it: the ranges are folders, so no other is opened, and rows
    carry their number within the range, so no more of it is decoded than the row groups around the page. Ties in the
    order are decided by the other columns. The driver keeps a number for each range.
    """

    def __init__(self, rows: DataFrame, order: Sequence[Column | str], size: int = PAGE_SIZE):
        ties = [as_column(f.name) for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
        self.size, self.columns = size, rows.columns
        path = shared_folder(rows.sparkSession)
        numbered = rows.orderBy(*order, *ties).withColumn("__id", F.monotonically_increasing_id())
        numbered = numbered.withColumn("__range", F.shiftright("__id", 33)).withColumn("__id", F.col("__id").bitwiseAND((1 << 33) - 1))
        numbered.write.partitionBy("__range").parquet(path)
        schema = T.StructType([*rows.schema.fields, T.StructField("__id", T.LongType()), T.StructField("__range", T.LongType())])
        self.kept = rows.sparkSession.read.schema(schema).parquet(path)
        counts = self.kept.groupBy("__range").count().orderBy("__range").collect()
        self.ranges = list(zip((r["__range"] for r in counts), accumulate((r["count"] for r in counts), initial=0), (r["count"] for r in counts)))
        self.rows = sum(n for _, _, n in self.ranges)

    @property
    def last(self) -> int:
        """The number of the last page, 1 where there are no rows."""
        return max(1, -(-self.rows // self.size))

    def page(self, number: int) -> DataFrame:
        """One page, from 1; the number is clamped to the pages there are."""
        start = (min(max(1, number), self.last) - 1) * self.size
        held = [(r, first, n) for r, first, n in self.ranges if first < start + self.size and first + n > start]
        within = [(F.col("__range") == r) & F.col("__id").between(start - first, start + self.size - first - 1) for r, first, _ in held]
        shown = self.kept.where(reduce(or_, within, F.lit(False)))
        return shown.orderBy("__range", "__id").select(*map(as_column, self.columns))


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page, from 1, of rows in a given order. Whoever wants several keeps the :class:`Pages`, which sort once."""
    return Pages(rows, order, size).page(number)


def top_series(cells: DataFrame, totals: DataFrame, metric: str, n: int = SERIES_LIMIT, chosen: Sequence[str] | None = None) -> DataFrame:
    """Cells of the ``n`` labels with the largest totals, or of the labels chosen by hand."""
    if chosen is not None:
        return cells.where(F.col("label").isin(*chosen))
    best = totals.orderBy(as_column(metric).desc_nulls_last(), F.asc_nulls_last("label")).limit(n).select("label")
    return cells.join(best, "label", "left_semi")


def treemap(rows: DataFrame, metric: str, fmt: str | None = None) -> DataFrame:
    """Name and positive size per label, in display scale."""
    return rows.select(F.col("label").alias("name"), display_scale(metric, fmt).alias("value")).where(F.col("value") > 0)


def chart_table(rows: DataFrame, metrics: Sequence[str], formats: Mapping[str, str | None] | None = None,
                thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Label and metrics in display scale, missing as 0, with constant threshold columns."""
    formats = formats or {}
    return rows.select(
        "label",
        *[zero_if_null(display_scale(m, formats.get(m))).alias(m) for m in metrics],
        *[F.lit(float(v)).alias(k) for k, v in (thresholds or {}).items()],
    )


def formatted(rows: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Add ``<metric>_text`` in each metric's display format and ``<metric>_color`` by its rules."""
    texts = {f"{m.id}_text": format_value(m.id, m.fmt, m.decimals, m.unit) for m in metrics}
    colors = {f"{m.id}_color": rule_color(m.id, m.rules, m.fmt) for m in metrics if m.rules}
    return rows.withColumns(texts | colors)


def flatten_groups(long: DataFrame, group_count: int) -> DataFrame:
    """Breakdown rows of all groups in one frame, labels prefixed by their group if there are several."""
    label = F.concat_ws(" · ", "group_name", "label") if group_count > 1 else F.col("label")
    return long.withColumn("label", label)


def group_rows(summary_long: DataFrame) -> DataFrame:
    """At a leaf of the hierarchy, without a breakdown: the groups themselves are the rows."""
    return summary_long.withColumn("label", F.col("group_name"))


def first_values(long: DataFrame, order: Column) -> DataFrame:
    """One value per metric id: the first in the given order."""
    return long.groupBy("metric_id").agg(F.min_by(F.struct("value"), order).alias("s")).select("metric_id", "s.value")


def time_series(long: DataFrame) -> DataFrame:
    """Group by time: every group's dated rows as one series named by the group."""
    return long.select(
        F.col("group_name").alias("label"), F.col("label").alias("date_label"), RECORD_COUNT, "metric_id", "value"
    )
