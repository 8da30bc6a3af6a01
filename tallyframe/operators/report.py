"""Report-style tables: leaf rows mixed with subtotal and total rows.

A matrix is ``file_id, row_idx, cells``: rows numbered from 0 within their file,
header rows first, cells as text. Key columns form a cascade; the right-most filled
key is a row's level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.numeric import as_column, finite, num
from tallyframe.functions.text import point_decimal, trim_all
from tallyframe.operators.metrics import Agg, Metric, MetricGroup
from tallyframe.operators.views import Calc

# Words that mark a total row.
TOTAL_KEYWORDS = ("итого", "всего", "total")
# Shapes of a plain number and of a code that only looks like one.
PLAIN_NUMBER = r"^-?\d+(?:[.,]\d+)?$"
CODE_LIKE = r"[:/]|^0\d"
# Shares that make a column a metric and a header row a sparse one, and the name for no group.
METRIC_SHARE = 0.6
SPARSE_HEADER_SHARE = 0.6
NO_GROUP = "(без группы)"
# Rows per block of the carry: the most that one task puts in order.
CARRY_BLOCK = 65_536
DELTA_EPSILON = 1e-9


@dataclass(frozen=True)
class Layout:
    """How a report is laid out."""

    key_columns: Sequence[int]
    header_rows: int = 1
    empty_tokens: Sequence[str] = ()
    total_keywords: Sequence[str] = TOTAL_KEYWORDS


def is_empty(c: Column, tokens: Sequence[str] = ()) -> Column:
    """No value, blank, or one of the tokens in any case; 0 is a value."""
    text = trim_all(c)
    empty = c.isNull() | (text == "")
    lowered = [t.strip().lower() for t in tokens]
    return empty | F.lower(text).isin(lowered) if lowered else empty


def parse_metric(c: Column, tokens: Sequence[str] = ()) -> Column:
    """Number of a metric cell (spaces between thousands, comma or point), else null."""
    text = point_decimal(trim_all(c))
    return F.when(~is_empty(c, tokens), finite(num(text)))


# ── detection, one row per file ──────────────────────────────────────────────


def _scored_cells(matrix: DataFrame, header_rows: int, tokens: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    cells = matrix.select("file_id", "row_idx", F.posexplode("cells").alias("pos", "cell"))
    text = trim_all("cell")
    filled = (F.col("row_idx") >= header_rows) & ~is_empty(F.col("cell"), tokens)
    number = filled & ~text.rlike(CODE_LIKE) & point_decimal(text).rlike(PLAIN_NUMBER)
    return cells, [F.count_if(filled).alias("filled"), F.count_if(number).alias("numbers")]


def is_metric() -> Column:
    return F.coalesce(F.try_divide("numbers", "filled"), F.lit(0.0)) > METRIC_SHARE


def column_scores(matrix: DataFrame, header_rows: int = 1, tokens: Sequence[str] = ()) -> DataFrame:
    """Per file and column: filled cells, plain numbers among them, and whether it is a metric."""
    cells, counts = _scored_cells(matrix, header_rows, tokens)
    return cells.groupBy("file_id", "pos").agg(*counts).withColumn("is_metric", is_metric())


def detect_columns(matrix: DataFrame, layout: Layout) -> list[ReportColumn]:
    """The columns of the files under one layout, with the headings of the first file.

    One aggregation; only a row per column reaches the driver.
    """
    cells, counts = _scored_cells(matrix, layout.header_rows, layout.empty_tokens)
    first = F.struct("file_id", "cell")
    headings = [F.min(F.when(F.col("row_idx") == h, first))["cell"].alias(f"h{h}") for h in range(layout.header_rows)]
    found = cells.groupBy("pos").agg(*counts, *headings).withColumn("is_metric", is_metric()).orderBy("pos").collect()
    header = [[r[f"h{h}"] for r in found] for h in range(layout.header_rows)]
    return report_columns(header or [[""] * len(found)], layout.key_columns, [r["pos"] for r in found if r["is_metric"]])


def detect_header_rows(matrix: DataFrame, tokens: Sequence[str] = ()) -> DataFrame:
    """Per file: 2 when a sparse row of group names stands over a dense row of column names, else 1."""
    filled = F.size(F.filter("cells", lambda c: ~is_empty(c, tokens)))
    rows = matrix.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("row_idx") == 0, filled)).alias("first"),
        F.max(F.when(F.col("row_idx") == 1, filled)).alias("second"),
    )
    two = (
        (F.col("n") >= 3)
        & (F.col("second") >= 3)
        & (F.col("first") > 0)
        & (F.col("first") <= F.col("second") * SPARSE_HEADER_SHARE)
    )
    return rows.select("file_id", F.when(two, 2).otherwise(1).alias("header_rows"))


def detect_key_columns(matrix: DataFrame, header_rows: int = 1, tokens: Sequence[str] = ()) -> DataFrame:
    """Per file: the leading columns up to the first metric, at least one."""
    scores = column_scores(matrix, header_rows, tokens)
    first_metric = F.min(F.when(F.col("is_metric"), F.col("pos")))
    count = F.greatest(F.lit(1), F.coalesce(first_metric, F.max("pos") + 1))
    return scores.groupBy("file_id").agg(count.alias("key_count"))


@dataclass(frozen=True)
class ReportColumn:
    """A column of the flat table: its header group, its own name and its role (key, metric, attribute)."""

    index: int
    group_name: str
    name: str
    role: str

    @property
    def full_name(self) -> str:
        return f"{self.group_name} · {self.name}" if self.group_name and self.group_name != self.name else self.name


def report_columns(header: Sequence[Sequence[str]], key_columns: Sequence[int], metric_columns: Iterable[int]) -> list[ReportColumn]:
    """Columns of a report from its one or two header rows; a group name runs on to the right."""
    names = [(n or "").strip() for n in header[-1]]
    groups = list(header[0]) if len(header) > 1 else []
    metrics, out, group = set(metric_columns), [], ""
    for i, name in enumerate(names):
        group = ((groups[i] if i < len(groups) else "") or "").strip() or group
        role = "key" if i in key_columns else "metric" if i in metrics else "attribute"
        out.append(ReportColumn(i, group, name, role))
    return out


# ── rows ─────────────────────────────────────────────────────────────────────


def classify_rows(matrix: DataFrame, layout: Layout) -> DataFrame:
    """Data rows with ``key0..`` (trimmed, null where empty), ``level``, ``kind`` and ``label``."""
    depth = len(layout.key_columns)
    deepest_first = [(i, F.col(f"key{i}")) for i in reversed(range(depth))]

    def key(i: int) -> Column:
        cell = F.get("cells", F.lit(i))
        return F.when(~is_empty(cell, layout.empty_tokens), trim_all(cell))

    def is_total(k: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.lower(k).contains(w.lower()) for w in layout.total_keywords], F.lit(False))

    rows = matrix.where(F.col("row_idx") >= layout.header_rows)
    rows = rows.withColumns({f"key{i}": key(c) for i, c in enumerate(layout.key_columns)})
    rows = rows.withColumns({
        "level": F.coalesce(*[F.when(k.isNotNull(), F.lit(i)) for i, k in deepest_first], F.lit(-1)),
        "__total": F.coalesce(*[F.when(is_total(k), k) for _, k in deepest_first], F.lit(None).cast("string")),
    })
    kind = F.when(F.col("__total").isNotNull(), "total").when(F.col("level") == depth - 1, "leaf").otherwise("node")
    label = F.coalesce("__total", *[k for _, k in deepest_first], F.lit(""))
    return rows.withColumns({"kind": kind, "label": label}).drop("__total")


def carry_forward(rows: DataFrame, events: Mapping[str, Column], block: int = CARRY_BLOCK) -> DataFrame:
    """Add, per event column, its last non-null value up to each row of its file.

    A file may hold a large part of all rows, so it is cut into blocks of consecutive
    rows: each block is carried on its own, what it ends with (reduced before any shuffle)
    is carried over the blocks, and the two are joined.
    """
    cut = rows.withColumns({"__block": F.floor(F.col("row_idx") / block), **{f"__e_{n}": c for n, c in events.items()}})
    inside = Window.partitionBy("file_id", "__block").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumns({f"__in_{n}": F.last(f"__e_{n}", ignorenulls=True).over(inside) for n in events})
    set_at = {n: F.when(F.col(f"__e_{n}").isNotNull(), F.col("row_idx")) for n in events}
    ends = cut.groupBy("file_id", "__block").agg(*[F.max_by(f"__e_{n}", at).alias(f"__end_{n}") for n, at in set_at.items()])
    earlier = Window.partitionBy("file_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(
        F.col("file_id").alias("__f"),
        F.col("__block").alias("__b"),
        *[F.last(f"__end_{n}", ignorenulls=True).over(earlier).alias(f"__before_{n}") for n in events],
    )
    joined = within.join(before, (F.col("file_id") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    carried = joined.withColumns({n: F.coalesce(f"__in_{n}", f"__before_{n}") for n in events})
    return carried.select(*rows.columns, *events)


def carry_keys(matrix: DataFrame, layout: Layout, block: int = CARRY_BLOCK, leaves: bool = True, nodes: bool = True) -> DataFrame:
    """Classified rows with the keys carried down to them: a filled key sets its level and clears the deeper ones.

    ``leaf0..`` are the ancestors as leaves see them: total rows and rows without a key do
    not move them. ``node0..`` are those that nodes see: there total rows do. Both are
    carried in one pass.
    """
    rows = classify_rows(matrix, layout)

    def event(i: int, moves: Column) -> Column:
        own = F.col(f"key{i}")
        return F.when(moves & own.isNotNull(), own).when(moves & (F.col("level") < i), F.lit(""))

    keyed = F.col("level") >= 0
    moves = ({"leaf": keyed & (F.col("kind") != "total")} if leaves else {}) | ({"node": keyed} if nodes else {})
    events = {f"{name}{i}": event(i, m) for name, m in moves.items() for i in range(len(layout.key_columns))}
    return carry_forward(rows, events, block)


def leaf_table(carried: DataFrame, layout: Layout, columns: Sequence[ReportColumn]) -> DataFrame:
    """Leaf rows as a flat table: ancestor keys filled in, metrics as numbers, the rest as text."""
    place = {c: i for i, c in enumerate(layout.key_columns)}

    def value(c: ReportColumn) -> Column:
        if c.index in place:
            return F.coalesce(f"leaf{place[c.index]}", F.lit(""))
        cell = F.get("cells", F.lit(c.index))
        return parse_metric(cell, layout.empty_tokens) if c.role == "metric" else F.coalesce(cell, F.lit(""))

    leaves = carried.where(F.col("kind") == "leaf")
    return leaves.select("file_id", "row_idx", *[value(c).alias(c.full_name) for c in columns])


def node_table(carried: DataFrame, layout: Layout, columns: Sequence[ReportColumn]) -> DataFrame:
    """Subtotal and total rows: ``path, level, label, is_total, values``; a row without any key has its label as path."""
    nodes = carried.where(F.col("kind") != "leaf")
    keys = F.array(*[F.coalesce(f"node{i}", F.lit("")) for i in range(len(layout.key_columns))])
    path = F.when(F.col("level") >= 0, F.slice(keys, 1, F.col("level") + 1)).otherwise(F.array("label"))
    entered = []
    for c in columns:
        if c.role == "metric":
            entered += [F.lit(c.full_name), parse_metric(F.get("cells", F.lit(c.index)), layout.empty_tokens)]
    return nodes.select(
        "file_id", "row_idx", path.alias("path"), "level", "label",
        (F.col("kind") == "total").alias("is_total"), F.create_map(*entered).alias("values"),
    )


def flatten_leaves(matrix: DataFrame, layout: Layout, columns: Sequence[ReportColumn], block: int = CARRY_BLOCK) -> DataFrame:
    """The flat leaf table of a matrix."""
    return leaf_table(carry_keys(matrix, layout, block, nodes=False), layout, columns)


def extract_nodes(matrix: DataFrame, layout: Layout, columns: Sequence[ReportColumn], block: int = CARRY_BLOCK) -> DataFrame:
    """The nodes of a matrix with their entered values."""
    return node_table(carry_keys(matrix, layout, block, leaves=False), layout, columns)


def hierarchy_preview(matrix: DataFrame, layout: Layout, max_nodes: int | None = None) -> DataFrame:
    """Distinct ancestor paths of the data rows, ``path, parent, label, level``, in order of appearance.

    Total rows are left out; a row's path ends at its first empty key.
    """
    rows = classify_rows(matrix, layout).where((F.col("kind") != "total") & (F.col("level") >= 0))
    keys = [F.col(f"key{i}") for i in range(len(layout.key_columns))]
    run = F.coalesce(*[F.when(k.isNull(), F.lit(i)) for i, k in enumerate(keys)], F.lit(len(keys)))
    rows = rows.withColumn("run", run).where(F.col("run") > 0)
    length = F.explode(F.sequence(F.lit(1), F.col("run")))
    parts = rows.select("file_id", "row_idx", F.array(*keys).alias("keys"), length.alias("length"))
    paths = parts.groupBy(F.slice("keys", 1, F.col("length")).alias("path")).agg(
        F.min(F.struct("file_id", "row_idx", "length")).alias("seen")
    )
    size = F.size("path")
    nodes = paths.select(
        "path",
        F.slice("path", 1, size - 1).alias("parent"),
        F.element_at("path", -1).alias("label"),
        (size - 1).alias("level"),
        "seen",
    )
    return (nodes if max_nodes is None else nodes.orderBy("seen").limit(max_nodes)).drop("seen")


# ── nodes ────────────────────────────────────────────────────────────────────


def node_values(nodes: DataFrame, by: Sequence[str] = (), order: str | None = "row_idx") -> DataFrame:
    """Nodes in long form ``path, is_total, column, own``; of rows with the same path the last wins."""
    long = nodes.select(*by, "path", "is_total", *([order] if order else []), F.explode("values").alias("column", "own"))
    if order is None:
        return long
    last = F.max_by(F.struct("is_total", "own"), order)
    return long.groupBy(*by, "path", "column").agg(last.alias("s")).select(*by, "path", "s.is_total", "column", "s.own")


def roll_up(values: DataFrame, depth: int, by: Sequence[str] = ()) -> DataFrame:
    """Rolled-up cells ``path, column, value, own, children_sum`` of nodes in long form.

    A node's value is its own where it has one, else the sum over its direct children,
    which take theirs from their own children; ``depth`` is the number of key columns. A
    synthetic root (empty path) sums the top nodes that are no totals, unless the file has
    a root of its own.

    One lazy plan for any depth: every own value is sent to its ancestors, up to and including the nearest one
    that has a value of its own or to the last before a missing row, and added up once.
    """
    names = [*by, "path", "column"]
    none = F.lit(None).cast("double")
    nodes = values.select(*names, "is_total", "own", F.size("path").alias("size")).where(F.col("size") <= depth)
    up = F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("to")
    sent = nodes.where(F.col("own").isNotNull() & (F.col("size") > 0)).select(*names, "own", "size", up)
    sent = sent.select(*[as_column(c).alias(f"__{c}") for c in by], F.col("path").alias("from"), "column", F.slice("path", 1, F.col("to")).alias("path"), F.col("own").alias("v"), "size", "to")
    same = [as_column(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    at = nodes.select(*by, F.col("path").alias("at"), F.col("column").alias("of"), F.col("own").alias("has"))
    met = sent.join(at, [*same, F.col("path") == F.col("at"), F.col("column") == F.col("of")])
    # an ancestor is reached if all nearer ones exist and none of them has a value of its own
    nearer = Window.partitionBy(*[f"__{c}" for c in by], "from", "column").orderBy(F.desc("to")).rowsBetween(Window.unboundedPreceding, -1)
    free = F.count_if(F.col("has").isNull()).over(nearer)
    reached = met.withColumn("free", free).where(F.col("free") == F.col("size") - 1 - F.col("to"))
    sums = reached.groupBy(*by, "path", "column").agg(F.sum("v").alias("children_sum"))
    back = sums.select(*[as_column(c).alias(f"__{c}") for c in by], F.col("path").alias("at"), F.col("column").alias("of"), "children_sum")
    whole = nodes.join(back, [*same, F.col("path") == F.col("at"), F.col("column") == F.col("of")], "left").select(
        *names, "is_total", "own", "size", "children_sum", F.coalesce("own", "children_sum").alias("value")
    )

    size = F.col("size")
    known = nodes.select(*by, F.col("path").alias("parent")).distinct()
    tops = whole.where((size > 0) & ~F.col("is_total")).withColumn("parent", F.slice("path", 1, size - 1))
    tops = tops.join(known, [*by, "parent"], "left_anti")
    root = tops.groupBy(*by, "column").agg(F.sum("value").alias("value"))
    root = root.select(
        *by, F.array().cast("array<string>").alias("path"), "column", "value", none.alias("own"),
        F.col("value").alias("children_sum"),
    )
    root = root.join(nodes.where(size == 0).select(*names), names, "left_anti")
    return whole.select(*names, "value", "own", "children_sum").unionByName(root)


def entered_values(rolled: DataFrame, columns: Mapping[str, str], calcs: Mapping[str, Calc] | None = None,
                   take: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Per node, its value of every metric: by the bound column, or by a formula over columns.

    A formula needs all its operand columns on the node; a null operand counts as 0.
    """
    calcs = calcs or {}
    used = list(dict.fromkeys([*columns.values(), *[c for k in calcs.values() for c in k.operands.values()]]))
    wide = rolled.groupBy(*by, "path").agg(
        *[F.max(F.when(F.col("column") == c, F.col(take))).alias(f"__v{i}") for i, c in enumerate(used)],
        *[(F.count_if(F.col("column") == c) > 0).alias(f"__has{i}") for i, c in enumerate(used)],
    )
    at = {c: i for i, c in enumerate(used)}
    metric_columns = [F.col(f"__v{at[c]}").alias(m) for m, c in columns.items()]
    for metric, calc in calcs.items():
        whole = reduce(lambda a, b: a & b, [F.col(f"__has{at[c]}") for c in calc.operands.values()])
        value = calc.column(lambda c: F.col(f"__v{at[c]}"))
        metric_columns.append(F.when(whole, value).alias(metric))
    return wide.select(*by, "path", *metric_columns)


def overlay(rows: DataFrame, entered: DataFrame, metrics: Sequence[str], path: Sequence[str] = ()) -> DataFrame:
    """Entered node values in place of computed ones where there are any, with ``<metric>_from_node``.

    A row belongs to the node at the current path followed by its label.
    """
    here = F.array(*[F.lit(v) for v in path], F.col("label"))
    nodes = entered.select(F.col("path").alias("__path"), *[as_column(m).alias(f"__e_{m}") for m in metrics])
    joined = rows.join(nodes, here == F.col("__path"), "left")
    flags = {f"{m}_from_node": as_column(f"__e_{m}").isNotNull() for m in metrics}
    merged = {m: F.coalesce(as_column(f"__e_{m}"), as_column(m)) for m in metrics}
    return joined.withColumns({**flags, **merged}).drop("__path", *[f"__e_{m}" for m in metrics])


def discrepancies(rolled: DataFrame, columns: Mapping[str, str], calcs: Mapping[str, Calc] | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """Nodes whose entered value differs from the sum of their children: ``path, metric, own, children_sum``.

    A calculated metric compares its formula over entered operands with the formula over
    the children's sums; every operand must have both.
    """
    calcs = calcs or {}
    used = list(dict.fromkeys([*columns.values(), *[c for k in calcs.values() for c in k.operands.values()]]))
    at = {c: i for i, c in enumerate(used)}
    both = F.col("own").isNotNull() & F.col("children_sum").isNotNull()
    wide = rolled.where(both).groupBy(*by, "path").agg(
        *[F.max(F.when(F.col("column") == c, F.struct("own", "children_sum"))).alias(f"__v{i}") for c, i in at.items()]
    )
    cells = []
    for metric, c in columns.items():
        v = F.col(f"__v{at[c]}")
        cells.append(F.struct(F.lit(metric).alias("metric"), v["own"].alias("own"), v["children_sum"].alias("children_sum")))
    for metric, calc in calcs.items():
        ready = reduce(lambda a, b: a & b, [F.col(f"__v{at[c]}").isNotNull() for c in calc.operands.values()])
        sides = [F.when(ready, calc.column(lambda c: F.col(f"__v{at[c]}")[s])).alias(s) for s in ("own", "children_sum")]  # noqa: B023
        cells.append(F.struct(F.lit(metric).alias("metric"), *sides))
    return wide.select(*by, "path", F.inline(F.array(*cells))).where(F.abs(F.col("own") - F.col("children_sum")) > DELTA_EPSILON)


# ── measures by header group ─────────────────────────────────────────────────


@dataclass(frozen=True)
class Indicator:
    """Settings of one indicator: its formula over ``value`` and how it is shown.

    A service indicator is only an operand of calculated ones.
    """

    name: str
    agg: str = "SUM"
    formula: Callable | None = None
    fmt: str = "number"
    decimals: int = 2
    unit: str | None = None
    service_only: bool = False


@dataclass(frozen=True)
class CalculatedIndicator:
    """A formula over indicators of the same header group: alias -> indicator name."""

    name: str
    formula: Callable
    operands: Mapping[str, str] = field(default_factory=dict)
    fmt: str = "number"
    decimals: int = 2


def groups_by_header(
    columns: Sequence[ReportColumn],
    indicators: Sequence[Indicator] = (),
    calculated: Sequence[CalculatedIndicator] = (),
    indicator_names: Mapping[str, str] | None = None,
    exclude: Iterable[str] = (),
    unassigned: bool = True,
) -> list[MetricGroup]:
    """One metric group per header group; its metrics are computed in one pass by a breakdown.

    A calculated indicator exists in the groups that have all its operands. An operand that
    is shown in the group is that metric's value, any other is the summed column.
    """
    names, skipped = indicator_names or {}, set(exclude)
    settings = {i.name: i for i in indicators}
    by_group: dict[str, list[ReportColumn]] = {}
    for c in columns:
        if c.role == "metric":
            by_group.setdefault(c.group_name or NO_GROUP, []).append(c)

    def indicator_of(c: ReportColumn) -> str:
        return names.get(c.full_name) or c.name or c.full_name

    groups = []
    for group, members in by_group.items():
        if group in skipped:
            continue
        first: dict[str, ReportColumn] = {}
        metrics: dict[str, Metric] = {}
        for c in members:
            name = indicator_of(c)
            first.setdefault(name, c)
            spec = settings.get(name, Indicator(name))
            if spec.service_only or not (unassigned or c.full_name in names):
                continue
            metric_id = name if name not in metrics else c.full_name
            metrics[metric_id] = Metric(
                metric_id, {"value": Agg(c.full_name, spec.agg)}, spec.formula, name=c.name or name,
                fmt=spec.fmt, decimals=spec.decimals, unit=spec.unit,
            )
        shown = set(metrics)
        for calc in calculated:
            if not all(o in shown or o in first for o in calc.operands.values()):
                continue
            bound = {a: Agg(first[o].full_name) for a, o in calc.operands.items() if o not in shown}
            on_metrics = {a: o for a, o in calc.operands.items() if o in shown}
            metrics[calc.name] = Metric(calc.name, bound, calc.formula, on_metrics, fmt=calc.fmt, decimals=calc.decimals)
        if metrics:
            groups.append(MetricGroup(group, list(metrics.values())))
    return groups
