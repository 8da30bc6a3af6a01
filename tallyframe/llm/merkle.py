"""A Merkle manifest of a table: a content-addressed DAG of digests, and inclusion proofs by descending it.

Every row is a leaf. Within a source, leaves ascend by id; every ``FANOUT`` consecutive nodes become one until one is
left, the subroot, and the subroots of all sources, in order, become the root in the same way. Each node is kept as a
record from its digest to the digests of its children. A proof descends from the root: the digits of a leaf's rank, in
base ``FANOUT``, choose a child at each node, the children not chosen are collected as a segment of the path, and at
the leaf the segments are reversed, so that they run from the leaf to the root.

Requests that share the digits read so far descend together: a node is opened once for all leaves below it, by a join
of its digest with the records of its level. So the joins have as many rows as the tree has inner nodes (a fifteenth of
the leaves), their keys are digests, and the leaves themselves meet their parents in the last step only. The hot source
is dealt out by rank like all others; nothing is gathered by source.

Digests are hexadecimal text, built by Spark's own functions throughout. Ranks come from sorted ranges and their
counts (``numbered``). The number of levels follows the largest source.

Defined cases: a null in any hashed column is ``-``; a null source is a source of its own and comes first; a null id
comes first in its source and is never tampered with; rows that repeat another are leaves of their own next to it; a
source of one row is its own subroot; empty and very long texts are hashed whole; an empty table gives no rows. Columns
beyond the five are not read, so their names may clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import stored
from tallyframe.llm.feistel import numbered

FANOUT = 16
#: The columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(framed, fields)))


@dataclass
class Manifest:
    """What is stored of a table.

    ``leaves``: group (the source behind ``=``, empty for none), rank, id, leaf and what else was asked for.
    ``subroots``: group, digest, height and place, the rank among all sources.
    ``trees`` and ``top``: for each level from 1, the nodes with group, rank, digest and children, of the sources and of
    the tree over their subroots. ``records`` are the same nodes by digest alone.
    """

    leaves: DataFrame
    subroots: DataFrame
    trees: list[DataFrame]
    top: list[DataFrame]

    def records(self, nodes: DataFrame) -> DataFrame:
        return nodes.groupBy("digest").agg(F.any_value("children").alias("children"))

    def root(self) -> DataFrame:
        """One row, or none for an empty table."""
        return (self.top[-1] if self.top else self.subroots).select("digest")


def _grown(nodes: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels over nodes (group, rank, digest, n of the group) and, for each height from 0, the last nodes of their groups."""
    levels, ends = [], [nodes.where("n = 1")]
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("rank", "digest")))["digest"].alias("children")
        parents = nodes.where("n > 1").groupBy("group", F.floor(F.col("rank") / FANOUT).alias("rank")).agg(run, F.ceil(F.first("n") / FANOUT).alias("n"))
        nodes = stored(parents.withColumn("digest", digest(F.array_join("children", ""))))
        levels.append(nodes)
        ends.append(nodes.where("n = 1"))
        most = -(-most // FANOUT)
    return levels, ends


def build(docs: DataFrame, leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: source, id, leaf and further columns, a row for each of the table."""
    light = leaves.withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    rows = stored(numbered(light, ["group", "id", "leaf"], "row"))
    groups = stored(rows.groupBy("group").agg(F.min("row").alias("first"), F.count("*").alias("n")))
    ranked = stored(rows.join(groups, "group").withColumn("rank", F.col("row") - F.col("first")).drop("row", "first"))
    most, n_groups = groups.agg(F.max("n"), F.count("*")).first()
    trees, ends = _grown(ranked.select("group", "rank", F.col("leaf").alias("digest"), "n"), most or 0)
    last = reduce(DataFrame.unionByName, [e.select("group", "digest", F.lit(height).alias("height")) for height, e in enumerate(ends)])
    subroots = stored(numbered(last, ["group"], "place"))
    top, _ = _grown(subroots.select(F.lit("").alias("group"), F.col("place").alias("rank"), "digest", F.lit(n_groups).cast("long").alias("n")), n_groups)
    return Manifest(ranked.drop("n"), subroots, trees, top)


def _segment(children: Column, at: Column) -> Column:
    """The children that were not chosen, before and after the one that was."""
    join = lambda part: F.array_join(part, "")
    return F.struct(join(F.slice(children, 1, at)).alias("left"), join(F.slice(children, at + 2, FANOUT)).alias("right"))


def _descended(manifest: Manifest, front: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted children of the front's nodes, each with its path; nodes are found by digest."""
    opened = front.join(manifest.records(nodes), "digest").select("group", "rank", "path", "children", *_carried(front), F.posexplode("children").alias("digit", "child"))
    below = opened.select(
        "group", (F.col("rank") * FANOUT + F.col("digit")).alias("rank"), F.col("child").alias("digest"),
        F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"), *_carried(front),
    )
    return below.join(wanted, ["group", "rank"], "left_semi")


def _carried(front: DataFrame) -> list[str]:
    return [c for c in front.columns if c == "subroot"]


def proofs(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The requested leaves (rows of ``manifest.leaves``) with ``known`` (the leaf that the descent arrived at),
    ``subroot`` and ``path``, the segments from the leaf to the root."""
    wanted = [requests.select("group", "rank")]  # by height: the ranks of the nodes above requested leaves
    for _ in manifest.trees:
        wanted.append(stored(wanted[-1].select("group", F.floor(F.col("rank") / FANOUT).alias("rank")).distinct()))
    places = requests.select("group").distinct().join(manifest.subroots, "group")
    of_top = [stored(places.select(F.lit("").alias("group"), F.col("place").alias("rank")))]
    for _ in manifest.top:
        of_top.append(of_top[-1].select("group", F.floor(F.col("rank") / FANOUT).alias("rank")).distinct())

    empty = F.array().cast("array<struct<left:string,right:string>>")
    front = manifest.root().select(F.lit("").alias("group"), F.lit(0).cast("long").alias("rank"), "digest", empty.alias("path"))
    for height in range(len(manifest.top), 0, -1):
        front = _descended(manifest, front, manifest.top[height - 1], of_top[height - 1])
    reached = stored(front.select(F.col("rank").alias("place"), "digest", "path").join(manifest.subroots.drop("digest"), "place"))

    entering = lambda height: reached.where(F.col("height") == height).select("group", F.lit(0).cast("long").alias("rank"), "digest", "path", F.col("digest").alias("subroot"))
    front = entering(len(manifest.trees))
    for height in range(len(manifest.trees), 1, -1):
        front = stored(_descended(manifest, front, manifest.trees[height - 1], wanted[height - 1]).unionByName(entering(height - 1)))

    asked = requests.withColumn("parent", F.floor(F.col("rank") / FANOUT)).withColumn("digit", (F.col("rank") % FANOUT).cast("int"))
    alone = entering(0).select("group", F.col("rank").alias("parent"), F.array("digest").alias("children"), "path", "subroot", F.lit(False).alias("run"))
    parents = alone
    if manifest.trees:
        opened = front.join(manifest.records(manifest.trees[0]), "digest")
        parents = alone.unionByName(opened.select("group", F.col("rank").alias("parent"), "children", "path", "subroot", F.lit(True).alias("run")))
    met = asked.join(parents, ["group", "parent"])
    path = F.when(F.col("run"), F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))).otherwise(F.col("path"))
    return met.withColumn("known", F.col("children")[F.col("digit")]).withColumn("path", F.reverse(path)).select(*requests.columns, "known", "subroot", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda now, s: digest(F.concat(s["left"], now, s["right"])))


def siblings(path: Column) -> Column:
    """The digest of all siblings, level by level from the leaf."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every row proven against its manifest, those where ``tampered`` holds with their letters lowered.

    ``columns`` name id, source, language, number of characters and text.
    """
    fields = [F.col(f"`{c}`") for c in columns]
    own = leaf(fields)
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf([*fields[:4], lowered(fields[4].cast("string"))])).otherwise(own)
    manifest = build(docs, docs.select(fields[1].alias("source"), fields[0].alias("id"), own.alias("leaf"), changed.alias("found")))
    shown = proofs(manifest, manifest.leaves)
    root = manifest.root().first()
    told = shown.withColumn("root", F.lit(root["digest"] if root else "")).withColumn("folded_root", folded(F.col("found"), F.col("path")))
    return told.select("id", F.col("known").alias("leaf"), "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
