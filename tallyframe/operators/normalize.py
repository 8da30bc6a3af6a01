"""Whole-column references, shares, extents and axis domains.

A reference is one row of aggregates read as a scalar subquery (or one row per
period, joined), so no window ever holds a whole column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.display import format_value, heat_alpha, heat_color
from tallyframe.functions.numeric import as_column, finite

# The references a column may be normalised by.
REFERENCES = {"total": F.sum, "max": F.max, "min": F.min, "mean": F.avg}


def reference(c: Column | str, base: str) -> Column:
    """Aggregate of the finite values; null when there are none."""
    return REFERENCES[base](finite(as_column(c)))


def share(c: Column | str, ref: Column) -> Column:
    """Value over reference; null when either is missing or the reference is 0."""
    return F.try_divide(finite(as_column(c)), ref)


def column_reference(rows: DataFrame, metric: str, base: str) -> DataFrame:
    return rows.agg(reference(metric, base).alias("reference"))


def normalize(rows: DataFrame, bases: Mapping[str, str], decimals: Mapping[str, int] | None = None,
              text: bool = False) -> DataFrame:
    """Replace metrics by their share of the column's reference; others stay.

    With ``text`` each normalised metric also gets a ``<metric>_text`` percent column.
    """
    bases = {m: b for m, b in bases.items() if m in rows.columns}
    if not bases:
        return rows
    refs = rows.agg(F.struct(*[reference(m, b).alias(f"r{i}") for i, (m, b) in enumerate(bases.items())]).alias("refs")).scalar()
    shares = {m: share(m, refs[f"r{i}"]) for i, m in enumerate(bases)}
    out = rows.withColumns(shares)
    if text:
        out = out.withColumns({f"{m}_text": format_value(m, "percent", (decimals or {}).get(m, 1)) for m in bases})
    return out


def normalize_by_period(cells: DataFrame, metric: str, base: str) -> DataFrame:
    """Share of each cell in the reference of its own date label."""
    refs = cells.groupBy(F.col("date_label").alias("__period")).agg(reference(metric, base).alias("__ref"))
    joined = cells.join(refs, F.col("date_label").eqNullSafe(F.col("__period")), "left")
    return joined.withColumn(metric, share(metric, F.col("__ref"))).drop("__period", "__ref")


def heat_map(cells: DataFrame, metric: str) -> DataFrame:
    """Opacity and colour of every cell between the lowest and highest value."""
    v = F.when(~F.isnan(as_column(metric)), as_column(metric))
    ends = cells.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias("ends")).scalar()
    alpha = heat_alpha(as_column(metric), ends["low"], ends["high"])
    return cells.withColumn("heat", alpha).withColumn("heat_color", heat_color(F.col("heat")))


def axis_domain(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row ``low, high``: the padded range of the finite values, never empty."""
    values = [finite(as_column(m)) for m in metrics]
    low, high = F.col("low"), F.col("high")
    flat = F.abs(low) * F.lit(0.1)
    pad = F.when(low == high, F.when(flat == 0, F.lit(1.0)).otherwise(flat)).otherwise((high - low) * F.lit(0.08))
    lows = F.least(*[F.min(v) for v in values]) if len(values) > 1 else F.min(values[0])
    highs = F.greatest(*[F.max(v) for v in values]) if len(values) > 1 else F.max(values[0])
    return rows.agg(lows.alias("low"), highs.alias("high")).select(
        F.coalesce(low - pad, F.lit(0.0)).alias("low"), F.coalesce(high + pad, F.lit(1.0)).alias("high")
    )
