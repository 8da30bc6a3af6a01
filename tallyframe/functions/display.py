"""Display scale, ru-RU number text, threshold colours and ids as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tallyframe.functions.numeric import as_column

NBSP = "\u00a0"
DASH = "—"
# Colour names a rule may give, with their hex form.
COLOR_HEX = {
    "emerald": "#10b981",
    "rose": "#f43f5e",
    "amber": "#f59e0b",
    "blue": "#3b82f6",
    "indigo": "#6366f1",
    "slate": "#94a3b8",
}
# Suffixes of compact numbers, by power of a thousand.
COMPACT_SUFFIXES = ("", "тыс.", "млн", "млрд", "трлн")
# The heat map colour, the rounding nudge, and the least opacity and range of a heat cell.
HEAT_RGB = (99, 102, 241)
EPSILON = 2.220446049250313e-16
HEAT_LEAST, HEAT_RANGE = 0.06, 0.64


@dataclass(frozen=True)
class Rule:
    """One threshold: compare the displayed value with ``value`` (and ``value2`` for ``between``)."""

    op: str
    value: float = 0.0
    value2: float | None = None
    color: str | None = None


def display_scale(c: Column | str, fmt: str | None) -> Column:
    """The value as the reader sees it: a ``percent`` share is shown times 100."""
    c = as_column(c)
    return c * F.lit(100.0) if fmt == "percent" else c


def meets(c: Column, op: str, value: float, value2: float | None = None) -> Column:
    """Rule test; ``between`` includes its bounds and takes them in either order."""
    if op == "between":
        other = value if value2 is None else value2
        return c.between(float(min(value, other)), float(max(value, other)))
    v = F.lit(float(value))
    tests = {
        ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "==": c == v, "!=": c != v,
    }
    return tests.get(op, F.lit(False))


def rule_color(c: Column | str, rules: Sequence[Rule], fmt: str | None = None) -> Column:
    """Hex colour of the first rule met in display scale, null if none is."""
    scaled = display_scale(c, fmt)
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        hex_color = F.lit(COLOR_HEX.get(rule.color)).cast("string")
        out = F.when(meets(scaled, rule.op, rule.value, rule.value2), hex_color).otherwise(out)
    return out


def round_half_up(c: Column, decimals: int) -> Column:
    """Rounding of displayed numbers: halves go up, towards plus infinity."""
    scaled = (c + F.lit(EPSILON)) * F.lit(10.0**decimals)
    whole = F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled + F.lit(0.5)).cast("double")).otherwise(scaled)
    return whole / F.lit(10.0**decimals)


def ru_text(c: Column | str, max_decimals: int = 3, fixed: bool = False) -> Column:
    """Number with a no-break space between thousands and a comma.

    At most ``max_decimals`` digits follow the comma, exactly so many if ``fixed``.
    """
    text = F.translate(F.format_number(F.round(as_column(c), max_decimals), max_decimals), ",.", f"{NBSP},")
    return text if fixed or max_decimals == 0 else F.rtrim(F.rtrim(text, F.lit("0")), F.lit(","))


def format_value(c: Column | str, fmt: str = "number", decimals: int = 0, unit: str | None = None) -> Column:
    """Text of a metric value in its display format; a missing value is a dash."""
    c = as_column(c)
    if fmt == "scientific":
        text = F.regexp_replace(F.format_string(f"%.{decimals}e", c), r"e([+-])0+(\d)", "e$1$2")
    else:
        rounded = round_half_up(display_scale(c, fmt), decimals)
        text = ru_text(rounded, decimals, fixed=fmt in ("decimal", "currency"))
        if fmt in ("percent", "percent_raw"):
            text = F.concat(text, F.lit("%"))
    if unit and fmt not in ("percent", "percent_raw"):
        text = F.concat(text, F.lit(f" {unit}"))
    return F.when(c.isNull(), F.lit(DASH)).otherwise(text)


def compact_text(c: Column | str) -> Column:
    """Short number with one decimal at most: ``1,2 тыс.``, ``3,4 млн``."""
    c = as_column(c)
    last = len(COMPACT_SUFFIXES) - 1
    out = None
    for power in range(last, -1, -1):
        scaled = F.round(c / F.lit(1000.0**power), 1)
        suffix = f"{NBSP}{COMPACT_SUFFIXES[power]}" if power else ""
        text = F.concat(ru_text(scaled, 1), F.lit(suffix))
        # a value that rounds up to 1000 of a unit is shown in the next one
        out = text if out is None else F.when(F.abs(scaled) < 1000, text).otherwise(out)
    return F.when(c.isNotNull(), out)


def value_label(c: Column | str, fmt: str | None = None, unit: str | None = None) -> Column:
    """Label of a value that is already in display scale."""
    text = ru_text(c, 3)
    if fmt in ("percent", "percent_raw"):
        return F.concat(text, F.lit("%"))
    return F.concat(text, F.lit(f" {unit}")) if unit else text


def cell_text(c: Column | str, data_type: str) -> Column:
    """Raw cell for a table view: dash for nothing, a mark for a boolean, up to four decimals for a number."""
    c = as_column(c)
    if data_type == "boolean":
        text = F.when(c, "✓").otherwise("✗")
    elif data_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or data_type.startswith("decimal"):
        text = ru_text(c.cast("double"), 4)
    else:
        text = c.cast("string")
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(DASH)).otherwise(text)


def metric_id(*fields: Column | str) -> Column:
    """Deterministic id of a dashboard column from its fields (a missing field counts as empty)."""
    parts = [F.coalesce(as_column(f).cast("string"), F.lit("")) for f in fields]
    return F.concat(F.lit("vm-"), F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 16))


def heat_alpha(c: Column, low: Column, high: Column) -> Column:
    """Opacity of a heat-map cell between the lowest and highest value."""
    share = F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - low) / (high - low)))).otherwise(0.0)
    return F.when(c.isNotNull() & ~F.isnan(c) & low.isNotNull(), F.lit(HEAT_LEAST) + F.lit(HEAT_RANGE) * share)


def heat_color(alpha: Column) -> Column:
    red, green, blue = HEAT_RGB
    return F.when(alpha.isNotNull(), F.concat(F.lit(f"rgba({red}, {green}, {blue}, "), F.format_string("%.3f", alpha), F.lit(")")))
