"""Metrics, breakdowns and report tables on PySpark DataFrames."""

from tallyframe.functions.display import Rule
from tallyframe.functions.formula import fx
from tallyframe.operators.breakdown import Axis, Breakdown
from tallyframe.operators.filters import Filter, Path
from tallyframe.operators.metrics import Agg, Metric, MetricGroup
from tallyframe.operators.report import Layout
from tallyframe.operators.views import Calc, DisplayRule
from tallyframe.plans.dashboard import Card, Dashboard, Template
from tallyframe.plans.group_view import GroupView
from tallyframe.plans.report_import import import_report

__all__ = [
    "Agg", "Axis", "Breakdown", "Calc", "Card", "Dashboard", "DisplayRule", "Filter", "GroupView",
    "Layout", "Metric", "MetricGroup", "Path", "Rule", "Template", "fx", "import_report",
]
