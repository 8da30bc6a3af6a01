"""From a report matrix to its flat leaf table and its hierarchy nodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyframe.operators.report import (
    Layout,
    ReportColumn,
    carry_keys,
    detect_columns,
    leaf_table,
    node_table,
    node_values,
    roll_up,
)
from tallyframe.session import stored


@dataclass(frozen=True)
class ReportImport:
    """The columns found and the frames a report gives."""

    columns: Sequence[ReportColumn]
    leaves: DataFrame
    nodes: DataFrame
    rolled: DataFrame


def import_report(matrix: DataFrame, layout: Layout) -> ReportImport:
    """Import the files of a matrix under one layout; nodes are valued and rolled up file by file.

    The matrix is read twice: once to find the columns, once to carry the keys. The
    carried rows are stored, and leaves and nodes are both taken from there.
    """
    columns = detect_columns(matrix, layout)
    carried = stored(carry_keys(matrix, layout))
    nodes = node_table(carried, layout, columns)
    rolled = roll_up(node_values(nodes, ["file_id"]), len(layout.key_columns), ["file_id"])
    return ReportImport(columns, leaf_table(carried, layout, columns), nodes, rolled)
