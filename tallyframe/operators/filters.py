"""Row filters, hierarchy paths and the columns that metrics may see."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import as_column

CLASSIFICATION = "classification"


@dataclass(frozen=True)
class Filter:
    """``column op value``; the default ``exact`` is equality, ``between`` takes ``value2``."""

    column: str
    value: object
    op: str | None = "exact"
    value2: object = None


def _operator(op: str | None) -> str:
    name = (op or "exact").upper()
    if name in ("EXACT", "="):
        return "="
    if name in (">", "<", ">=", "<=", "!=", "<>", "LIKE", "ILIKE", "BETWEEN"):
        return name
    warnings.warn(f"unknown filter operator {op!r} read as '='", stacklevel=3)
    return "="


def condition(df: DataFrame, f: Filter) -> Column | None:
    """The filter as a Column, None when its column is unknown.

    A literal is brought to the column's type; text that is no such value compares as null.
    """
    if f.column not in df.columns:
        warnings.warn(f"filter on unknown column dropped: {f.column!r}", stacklevel=2)
        return None
    c = as_column(f.column)
    op = _operator(f.op)
    if op in ("LIKE", "ILIKE"):
        text = c.cast("string")
        return text.like(str(f.value)) if op == "LIKE" else text.ilike(str(f.value))
    kind = df.schema[f.column].dataType.simpleString()

    def literal(v) -> Column:
        return F.lit(v).try_cast(kind)

    if op == "BETWEEN":
        if f.value2 is None:
            raise ValueError(f"between on {f.column!r} needs value2")
        return c.between(literal(f.value), literal(f.value2))
    v = literal(f.value)
    return {"=": c == v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v, "!=": c != v, "<>": c != v}[op]


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows meeting all filters; filters on unknown columns are dropped with a warning."""
    conditions = [c for c in (condition(df, f) for f in filters) if c is not None]
    return df.where(reduce(and_, conditions)) if conditions else df


def visible_columns(df: DataFrame) -> list[str]:
    """Columns not classified ``ignore`` in their metadata."""
    return [f.name for f in df.schema.fields if (f.metadata or {}).get(CLASSIFICATION) != "ignore"]


def classify(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Record a classification (numeric, categorical, date, ignore) in the column metadata."""
    return df.select(
        *[
            as_column(f.name).alias(f.name, metadata={**(f.metadata or {}), CLASSIFICATION: classes[f.name]})
            if f.name in classes
            else as_column(f.name)
            for f in df.schema.fields
        ]
    )


def select_visible(df: DataFrame) -> DataFrame:
    return df.select(*map(as_column, visible_columns(df)))


@dataclass(frozen=True)
class Path:
    """A drill-down position: hierarchy levels and one filter per level chosen so far."""

    levels: tuple[str, ...]
    filters: tuple[Filter, ...] = ()

    def drill(self, value, op: str = "exact", value2=None, level: int | None = None) -> Path:
        """Choose a value at a level (the next one by default); deeper choices are dropped."""
        at = len(self.filters) if level is None else level
        if not 0 <= at <= len(self.filters) or at >= len(self.levels):
            raise ValueError("levels are chosen from the root down")
        return replace(self, filters=(*self.filters[:at], Filter(self.levels[at], value, op, value2)))

    def up(self, level: int) -> Path:
        return replace(self, filters=self.filters[:level])

    @property
    def depth(self) -> int:
        return len(self.filters)

    @property
    def next_level(self) -> str | None:
        return self.levels[self.depth] if self.depth < len(self.levels) else None

    @property
    def values(self) -> list[str]:
        return [str(f.value) for f in self.filters]
