"""Numeric Columns shared by every operator: casting, finiteness, references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def as_column(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def num(c: Column | str) -> Column:
    """The cell as a double; text that is no number gives null instead of an ANSI error."""
    return as_column(c).try_cast("double")


def finite(c: Column) -> Column:
    """NaN and the infinities become null (NaN sorts above infinity, so one test does)."""
    return F.when(F.abs(c) < F.lit(INF), c)


def zero_if_null(c: Column) -> Column:
    """A missing operand counts as 0, a missing value does not."""
    return F.coalesce(c, F.lit(0.0))
