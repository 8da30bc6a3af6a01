"""Dashboards: groups of metrics and KPI cards over one table, computed in one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.display import format_value
from tallyframe.functions.numeric import as_column
from tallyframe.operators.breakdown import Axis, Breakdown, to_long
from tallyframe.operators.filters import Filter
from tallyframe.operators.metrics import Agg, Metric, MetricGroup, MetricPlan

KPI_GROUP = "kpi"


@dataclass(frozen=True)
class Template:
    """A reusable formula with its display settings; the variables are bound where it is used."""

    name: str
    formula: Callable
    agg: Mapping[str, str] | None = None
    fmt: str = "number"
    decimals: int = 2
    unit: str | None = None


@dataclass(frozen=True)
class Card:
    """A KPI card: a template whose variables are bound to columns or to other cards."""

    id: str
    template: Template
    bindings: Mapping[str, str]


def card_group(cards: Sequence[Card]) -> MetricGroup:
    """The cards as one metric group; a variable bound to a card's id is that card's value."""
    ids = {c.id for c in cards}
    metrics = []
    for card in cards:
        t = card.template
        fields = {v: Agg(b, (t.agg or {}).get(v, "SUM")) for v, b in card.bindings.items() if b not in ids}
        others = {v: b for v, b in card.bindings.items() if b in ids}
        metrics.append(Metric(card.id, fields, t.formula, others, name=t.name, fmt=t.fmt, decimals=t.decimals, unit=t.unit))
    return MetricGroup(KPI_GROUP, metrics, "KPI")


class Dashboard:
    """Metric groups and cards of one table.

    ``columns`` are the dashboard's column ids; each group binds them to its metrics.
    """

    def __init__(self, groups: Sequence[MetricGroup], columns: Sequence[str], cards: Sequence[Card] = ()):
        self.groups, self.columns = list(groups), list(columns)
        self.cards = list(cards)

    def _breakdown(self, df, filters, by=None, axis=None, limit=None) -> Breakdown:
        members = self.groups + ([card_group(self.cards)] if self.cards else [])
        return Breakdown(df, members, by, axis, filters, limit)

    def summary(self, df: DataFrame, filters: Sequence[Filter] = ()) -> DataFrame:
        """One row per group and dashboard column."""
        return to_long(self._breakdown(df, filters).rows(), self.groups, self.columns, [])

    def breakdown(self, df: DataFrame, by: str | None, axis: Axis | None = None, filters: Sequence[Filter] = (),
                  limit: int | None = None) -> DataFrame:
        """One row per label, group and dashboard column."""
        b = self._breakdown(df, filters, by, axis, limit)
        return to_long(b.rows(ordered=False), self.groups, self.columns, b.keys)

    def totals(self, df: DataFrame, by: str | None, axis: Axis | None = None, filters: Sequence[Filter] = (),
               limit: int | None = None) -> DataFrame:
        """One row per group and dashboard column, re-aggregated from the breakdown."""
        return to_long(self._breakdown(df, filters, by, axis, limit).total(), self.groups, self.columns, [])

    def card_values(self, df: DataFrame, filters: Sequence[Filter] = ()) -> DataFrame:
        """``card, name, value, text`` per KPI card, from the same aggregation; no value shows as 0 and a dash."""
        row = self._breakdown(df, filters).rows()
        cells = []
        for m in card_group(self.cards).metrics:
            value = as_column(MetricPlan.alias(KPI_GROUP, m.id))
            cells.append(
                F.struct(
                    F.lit(m.id).alias("card"), F.lit(m.title).alias("name"),
                    F.coalesce(value, F.lit(0.0)).alias("value"),
                    format_value(value, m.fmt, m.decimals, m.unit).alias("text"),
                )
            )
        return row.select(F.inline(F.array(*cells)))
