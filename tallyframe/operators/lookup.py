"""Reference dictionaries and hierarchy nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.numeric import as_column
from tallyframe.functions.text import natural_key, normalize_key, trim_all
from tallyframe.operators.filters import Filter, apply_filters
from tallyframe.operators.metrics import filled


def build_dictionary(pairs: DataFrame, key: str, name: str, order: str, mode: str = "none") -> DataFrame:
    """``code, name`` with codes in canonical form; of several entries for a code the last wins."""
    code = normalize_key(key, mode)
    entries = pairs.select(code.alias("code"), trim_all(name).alias("name"), as_column(order).alias("__order"))
    filled = entries.where((F.col("code") != "") & (F.col("name") != ""))
    return filled.groupBy("code").agg(F.max_by("name", "__order").alias("name"))


def resolve_names(rows: DataFrame, dictionary: DataFrame, column: str = "label", into: str = "name",
                  mode: str = "none") -> DataFrame:
    """Add the dictionary name of a code; an unknown code is its own name.

    Meant for aggregated rows: grouping and filters keep the code. The dictionary is
    broadcast by Spark when it is small enough, and joined by shuffle when it is not.
    """
    entries = dictionary.select(F.col("code").alias("__code"), F.col("name").alias("__name"))
    joined = rows.join(entries, normalize_key(column, mode) == F.col("__code"), "left")
    return joined.withColumn(into, F.coalesce("__name", as_column(column).cast("string"))).drop("__code", "__name")


def level_nodes(df: DataFrame, level: str, path: Sequence[Filter] = (), ordered: bool = True) -> DataFrame:
    """Values of a hierarchy level under a path with their record counts, blanks left out."""
    counts = apply_filters(df, path).groupBy(as_column(level).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("record_count")
    )
    nodes = counts.select(trim_all("value").alias("value"), "record_count").where(filled("value"))
    return nodes.orderBy(natural_key("value"), "value") if ordered else nodes
