"""MinHash near-duplicates: a chosen-path set-similarity join.

A document is its set of word shingles. Documents with equal sets are one vertex. In each of ``trees`` independent
random trees a vertex is branched ``depth`` times, each time to the child of a selected minwise token of its set. A leaf
that is small is compared exhaustively by signatures, and what looks similar is confirmed on the full sets. A pair at
the threshold stays together at a branching with probability ``threshold``, so two branchings and 20 trees miss it with
(1 - 0.75 ** 2) ** 20, under 1e-7; documents that only share a passage part at the second branching if not at the first.
The vertices of leaves of more than ``leaf``, where only passages and copies of very many documents can bring them, are
not branched at random again, which would lose pairs, but joined exactly: their paths are the prefixes of their full
sets, rare shingles first, one of which any pair at the threshold shares.

Links come in two passes. The first takes from every node the strongest edges that hold its similar vertices
together, a number linear in the node; they are confirmed and joined into components. The second looks in every node
for vertices that look like one of another component. Only these take their full sets to the node, once each, are
compared there exactly, and true links alone leave it, as many as hold the node's components together: groups of
documents that are nearly near copies make no rows. A pair is looked at in the first tree that it shares a leaf of.
Where more than ``leaf`` vertices share a shingle of their prefixes, the first pass looks at blocks with common
pivots, the second at every two blocks, spread over tasks, but for blocks of one component. Texts are read a second
time, once, for the full sets of all vertices that either way wants.

Nothing of data size reaches the driver; components are found by alternating large-star and small-star steps.

Defined cases: a null text or one without words has the empty set, is linked with nothing and is its own
component; a document of fewer words than a shingle has one shingle, its whole sequence; rows with a null id are
linked with nothing and have no component, and stay; repeated rows fall into one component; very long texts are
shingled whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import begin_memos, map_rows, stored, texts

EDGES_A_TASK = 200_000
EDGES_A_NODE = 100_000  # similar pairs of one node that are held at a time
SAMPLE = 5_000  # sets that tell which shingles are common
COMMON = 100_000
MARKS = 2**24  # hash values of ids, by which texts that are not wanted stay where they are
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@dataclass(frozen=True)
class Join:
    words: int = 5
    threshold: int = 75  # per cent of the union
    trees: int = 20
    depth: int = 2  # branchings of a tree
    signature: int = 192
    similar: float = 0.64  # 3.5 standard errors of the signature below the threshold
    leaf: int = 2500
    pivots: int = 32

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(75))
        odd = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return odd(self.words), odd(max(self.signature, self.trees * self.depth)).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, join: Join, odd: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < join.words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - join.words + 1
    total = h[:n] * odd[0]
    for k in range(1, join.words):
        total += h[k : k + n] * odd[k]
    return np.unique(_mix(total))


def signatures(docs: DataFrame, join: Join, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_id (a 128-bit fingerprint of the set), path (the 32-bit minwise tokens of all trees), signature
    (8 bits a hash)."""
    word_odd, sig_odd = join.multipliers()

    def rows(flow: Iterator[tuple]) -> Iterator[tuple]:
        begin_memos("chosen_path")
        for i, text in flow:
            s = shingles(text, join, word_odd)
            if not len(s):
                yield i, 0, None, None, None
                continue
            low = np.full(len(sig_odd), np.iinfo(np.uint32).max, np.uint32)
            for a in range(0, len(s), 1024):  # bounded work space for very long texts
                part = s[a : a + 1024]
                np.minimum(low, ((part >> np.uint64(32)).astype(np.uint32)[:, None] * sig_odd).min(axis=0), out=low)
            set_id = np.array([s.sum(), _mix(s + np.uint64(len(s))).sum()], np.uint64).tobytes()
            yield i, len(s), set_id, low[: join.trees * join.depth].tobytes(), low[: join.signature].astype("u1").tobytes()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(texts(docs, id_col, text_col), f"id {kind}, n_shingles long, set_id binary, path binary, signature binary", rows)


def _children(vertices: DataFrame, join: Join) -> DataFrame:
    """(set_id, node, tree) of the leaf that a vertex (set_id, path) comes to in every tree: at each branching it goes to
    the child of the tree's next minwise token."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            path = np.frombuffer(b"".join(b.column("path").to_pylist()), np.uint32).reshape(b.num_rows, join.trees, join.depth).astype(np.uint64)
            for t in range(join.trees):
                n = _mix(np.full(b.num_rows, 0x9E3779B97F4A7C15 * (t + 1) % 2**64, np.uint64))
                for level in range(join.depth):
                    n = _mix(n + path[:, t, level] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level + 1))
                yield pa.RecordBatch.from_arrays([b.column("set_id"), pa.array(n.view(np.int64)), pa.array(np.full(b.num_rows, t, np.int32))], names=["set_id", "node", "tree"])

    return vertices.select("set_id", "path").mapInArrow(step, "set_id binary, node long, tree int")


def leaves(vertices: DataFrame, join: Join) -> tuple[DataFrame, DataFrame | None]:
    """(set_id, node, tree) of all nodes of two vertices or more, ``leaf`` at most; the set_id of what larger nodes hold, if any."""
    level = _children(vertices, join)
    met = stored(level.join(level.groupBy("node").count().where("count > 1"), "node"))
    hot = met.where(F.col("count") > join.leaf)
    return met.where(F.col("count") <= join.leaf).select("set_id", "node", "tree"), None if hot.isEmpty() else stored(hot.select("set_id").distinct())


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of the sets has often, sorted, and how often; fewer than ``COMMON``."""
    part = sets.where(F.pmod(F.xxhash64("set_id"), F.lit(-(-sets.count() // SAMPLE) or 1)) == 0)
    total = part.agg(F.sum(F.size("shingles"))).first()[0] or 0
    counts = part.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") > max(3, total // COMMON)).toArrow()
    found, count = counts.column("s").to_numpy(), counts.column("count").to_numpy()
    order = np.argsort(found)
    return found[order], count[order]


def prefix_nodes(sets: DataFrame, join: Join) -> DataFrame:
    """(set_id, node, count) such that any two sets (set_id, shingles) that reach the threshold share a node.

    All sets are put in one order, what is common last; sets that overlap enough share one of their first
    ``n - ceil(threshold * n) + 1`` shingles. Any order will do, so the sample that it comes from loses nothing.
    Shingles with the same vertices are one node.
    """
    common, often = _common(sets)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in zip(b.column("set_id").to_pylist(), b.column("shingles")):
                s = s.values.to_numpy()
                count = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    count = np.where(common[at] == s, often[at], 0)
                first = s[np.lexsort((s, count))][: len(s) - -(-join.threshold * len(s) // 100) + 1]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(first), pa.binary()), pa.array(first)], names=["set_id", "shingle"])

    rows = sets.select("set_id", "shingles").mapInArrow(step, "set_id binary, shingle long")
    groups = rows.groupBy("shingle").agg(F.count("*").alias("count"), F.bit_xor(F.xxhash64("set_id")).alias("mark")).where("count > 1")
    return stored(rows.join(groups, "shingle").select("set_id", F.xxhash64("mark", "count", F.lit("prefix")).alias("node"), "count").distinct())


def _blocks(hot: DataFrame, join: Join) -> DataFrame:
    """(set_id, node) of random blocks that share pivots, from nodes (set_id, node, count) of more than ``leaf``: for the
    first pass, where what is missed between blocks costs no link."""
    blocks = F.ceil(F.col("count") / (join.leaf // 2)).cast("long")
    draw = F.xxhash64("set_id", "node")
    block = F.when(F.pmod(draw, F.col("count")) < join.pivots, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "set_id"), blocks)))
    return hot.select("set_id", "node", F.explode(block).alias("block")).select("set_id", F.xxhash64("node", "block", F.lit("block")).alias("node"))


def _block_pairs(hot: DataFrame, placed: DataFrame, join: Join) -> DataFrame:
    """(set_id, node, root): every two blocks of a node of more than ``leaf`` as a node of their own, but those of one
    component. A root of more than half a leaf has blocks of its own, the others share some."""
    half = join.leaf // 2
    at = stored(hot.join(placed, "set_id", "left").select("set_id", "node", F.coalesce("root", "set_id").alias("root")))
    sizes = at.groupBy("node", "root").agg(F.count("*").alias("of_root"))
    rest = sizes.where(F.col("of_root") <= half).groupBy("node").agg(F.sum("of_root").alias("of_rest"))
    own = F.when(F.col("of_root") > half, F.col("root"))
    number = F.ceil(F.when(own.isNotNull(), F.col("of_root")).otherwise(F.col("of_rest")) / half).cast("long")
    block = F.xxhash64("node", F.coalesce(own, F.lit(b"")), F.pmod(F.xxhash64("node", "set_id"), number))
    members = stored(at.join(sizes, ["node", "root"]).join(rest, "node", "left").select("set_id", "node", "root", own.alias("own"), block.alias("block")))
    one = members.select("node", "own", "block").distinct()
    two = one.select("node", F.col("own").alias("own_b"), F.col("block").alias("block_b"))
    pairs = one.join(two, "node").where(F.col("block") <= F.col("block_b")).where(F.coalesce(F.col("own") != F.col("own_b"), F.lit(True)))
    pairs = pairs.select(F.xxhash64("node", "block", "block_b").alias("pair"), F.explode(F.array_distinct(F.array("block", "block_b"))).alias("block"))
    return members.select("set_id", "root", "block").join(pairs, "block").select("set_id", F.col("pair").alias("node"), "root")


def _per_node(members: DataFrame, schema: str, group: Callable[[pa.Table], dict[str, list]]) -> DataFrame:
    """``group`` applied to the rows of every node of two rows or more; it gives the columns of its result."""
    names = [c.split()[0] for c in schema.split(", ")]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            made = group(t) if t.num_rows > 1 else {}
            if made and len(made[names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(made[n], pa.int64() if n == "node" else pa.binary()) for n in names], names=names)

        rest: pa.Table | None = None
        for b in batches:  # sorted by node; the last node of a batch may go on in the next
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
            if not t.num_rows:
                continue
            node = t.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:]):
                yield from out(t.slice(s, e - s))
            rest = t.slice(cuts[-1])
        if rest is not None:
            yield from out(rest)

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(nodes, schema)


def _bytes_of(t: pa.Table, name: str, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(t.num_rows, *shape)


def _alike(n: np.ndarray, sig: np.ndarray, join: Join, other: Callable[[int], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vertex x of a node, the later ones whose signatures agree well enough with it, and in how many hashes."""
    least = int(np.ceil(join.similar * join.signature))
    least_head = int(48 * (join.similar - 0.2))  # of the first 48, 4.7 standard errors below the threshold
    size_share, head = join.threshold / 100, np.ascontiguousarray(sig[:, :48])
    for x in range(len(n) - 1):
        ok = np.minimum(n[x + 1 :], n[x]) >= size_share * np.maximum(n[x + 1 :], n[x])
        if other is not None:
            ok &= other(x)
        y = np.flatnonzero(ok) + x + 1
        if len(y):
            y = y[(head[y] == head[x]).sum(axis=1) >= least_head]
            agree = (sig[y] == sig[x]).sum(axis=1)
            yield x, y[agree >= least], agree[agree >= least]


def spanning_pairs(members: DataFrame, join: Join) -> DataFrame:
    """Distinct pairs (a, b): of each node (set_id, node, n_shingles, signature) the strongest edges that hold its similar
    vertices together."""

    def group(t: pa.Table) -> dict[str, list]:
        ids = t.column("set_id").to_pylist()
        alike = _alike(t.column("n_shingles").to_numpy(), _bytes_of(t, "signature", "u1", join.signature), join)
        pairs = [sorted((ids[x], ids[y])) for x, y in _strongest(len(ids), alike)]
        return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

    return _per_node(members.select("node", "set_id", "n_shingles", "signature"), "a binary, b binary", group).distinct()


def _strongest(n: int, found: Iterator[tuple[int, np.ndarray, np.ndarray]], most: int | None = None) -> list[tuple[int, int]]:
    """Of the edges (x, later ends, strengths) between ``n`` vertices the strongest that hold together what they join,
    earlier ones first where they are equal.

    A node of near copies has an edge for nearly every pair, so ``most`` are held at a time, beside those of one vertex:
    what is not among the strongest of some edges is not among those of all.
    """
    most, held, met = max(most or EDGES_A_NODE, 4 * n), [], 0

    def reduced() -> list[tuple[np.ndarray, ...]]:
        x, y, strength = map(np.concatenate, zip(*held))
        order = np.lexsort((y, x, -strength))
        joined, kept = _Union(n), []
        for at, a, b in zip(order.tolist(), x[order].tolist(), y[order].tolist()):
            if joined.join(a, b):
                kept.append(at)
                if len(kept) == n - 1:
                    break
        return [(x[kept], y[kept], strength[kept])]

    for x, ys, strength in found:
        if len(ys):
            held.append((np.full(len(ys), x, np.int32), ys.astype(np.int32), strength.astype(np.int32)))
            met += len(ys)
        if met >= most:
            held = reduced()
            met = len(held[0][0])
    return [(x, y) for x, y in zip(*(c.tolist() for c in reduced()[0][:2]))] if held else []


class _Union:
    """Which of some numbers have been joined."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def top(self, v: int) -> int:
        parent = self.parent
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def join(self, a: int, b: int) -> bool:
        p, q = self.top(a), self.top(b)
        self.parent[p] = q
        return p != q


def contested(members: DataFrame, join: Join) -> DataFrame:
    """(set_id, node) of the vertices that look like one of another root in a node, from (set_id, node, tree, n_shingles,
    signature, path, root). A pair counts in the first tree that it shares a node of; nodes without a tree count always."""

    def group(t: pa.Table) -> dict[str, list]:
        root = np.unique(np.array(t.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
        if not root.any():
            return {}
        tree, mark = t.column("tree")[0].as_py(), np.zeros(t.num_rows, bool)
        before = _bytes_of(t, "path", "u4", join.trees, join.depth)[:, : tree or 0]
        for x, y, _ in _alike(t.column("n_shingles").to_numpy(), _bytes_of(t, "signature", "u1", join.signature), join, lambda x: root[x + 1 :] != root[x]):
            if tree:
                y = y[~(before[y] == before[x]).all(axis=2).any(axis=1)]
            mark[y] = True
            mark[x] |= len(y) > 0
        at = np.flatnonzero(mark).tolist()
        ids, node = t.column("set_id").to_pylist(), t.column("node")[0].as_py()
        return {"set_id": [ids[i] for i in at], "node": [node] * len(at)}

    columns = members.select("node", "tree", "set_id", "n_shingles", "signature", "path", "root")
    return _per_node(columns, "set_id binary, node long", group)


def exact_links(members: DataFrame, join: Join) -> DataFrame:
    """(a, b): links between different roots, confirmed on the full sets (set_id, node, root, shingles) that have come to a
    node; as many as hold together what is linked there. Pairs that are no links leave no trace."""

    def group(t: pa.Table) -> dict[str, list]:
        ids, roots = t.column("set_id").to_pylist(), t.column("root").to_pylist()
        code = np.unique(np.array(roots, dtype=object), return_inverse=True)[1]
        sets = t.column("shingles").combine_chunks()
        ends = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        n, every = np.diff(ends), sets.flatten().to_numpy()
        shingle = np.unique(every, return_inverse=True)[1]
        order = np.argsort(shingle, kind="stable")
        holder, starts = np.repeat(np.arange(len(n)), n)[order], np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
        joined, a, b = _Union(int(code.max()) + 1), [], []
        for x in range(len(ids) - 1):
            mine = shingle[ends[x] : ends[x + 1]]
            many = starts[mine + 1] - starts[mine]
            at = np.repeat(starts[mine] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            both = np.bincount(holder[at], minlength=len(n))[x + 1 :]
            linked = (100 * both >= join.threshold * (n[x + 1 :] + n[x] - both)) & (code[x + 1 :] != code[x])
            for y in (np.flatnonzero(linked) + x + 1).tolist():
                if joined.join(int(code[x]), int(code[y])):
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
        return {"a": a, "b": b}

    return _per_node(members.select("node", "set_id", "root", "shingles"), "a binary, b binary", group).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs whose full sets overlap enough."""
    a = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    counted = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).cast("long").alias("sum"))
    return counted.where(100 * F.col("both") >= join.threshold * (F.col("sum") - F.col("both"))).select("a", "b")


def _only_stars(edges: DataFrame) -> bool:
    """Whether every vertex is either the end of one edge or the centre of some."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("end"), F.lit(0).alias("centre"))
    centres = edges.select(F.col("b").alias("v"), F.lit(0).alias("end"), F.lit(1).alias("centre"))
    roles = ends.unionByName(centres).groupBy("v").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre"))
    return roles.where("ends > 1 OR ends + centre > 1").isEmpty()


def _stars(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """(v, smallest vertex) of the components within each ``most`` edges."""
    parent: dict[bytes, bytes] = {}

    def top(v: bytes) -> bytes:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent.setdefault(p, p)
            v = p
        return v

    def out() -> Iterator[pa.RecordBatch]:
        star = [(v, top(v)) for v in list(parent)]
        star = [(v, r) for v, r in star if v != r]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in star], pa.binary()) for i in (0, 1)], names=["a", "b"])
        parent.clear()

    met = 0
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            p, q = top(a), top(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
        met += batch.num_rows
        if met >= (most or 2 * EDGES_A_TASK):
            yield from out()
            met = 0
    yield from out()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of (a, b): the smallest vertex of its component, by large-star and small-star steps.

    Before the steps every task joins about ``EDGES_A_TASK`` edges to stars of their own, so few steps are left,
    and none where one task holds all edges.
    """
    edges = stored(edges.select("a", "b"))
    edges = stored(edges.coalesce(-(-edges.count() // EDGES_A_TASK) or 1).mapInArrow(_stars, "a binary, b binary"))
    while not _only_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable) and kept, one row a document."""
    own = stored(signatures(docs, join, id_col, text_col))
    vertices = stored(
        own.where("set_id IS NOT NULL AND id IS NOT NULL").groupBy("set_id")
        .agg(F.min("id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("path").alias("path"), F.any_value("signature").alias("signature"))
    )
    met, over = leaves(vertices, join)
    traits = vertices.select("set_id", "n_shingles", "signature")
    spanning = stored(spanning_pairs(met.select("set_id", "node").join(traits, "set_id"), join))
    touched = stored(_ends(spanning))
    # the texts are read and sent once, for what is to be confirmed and for what is to be joined exactly
    wanted = touched.withColumn("over", F.lit(False)) if over is None else _marked(touched, over)
    sets = stored(_full_sets(docs, wanted.join(vertices.select("set_id", "first_id"), "set_id"), join, id_col, text_col))
    hot = None
    if over is not None:
        exact = prefix_nodes(sets.where("over"), join)
        cold = exact.where(F.col("count") <= join.leaf).select("set_id", "node", F.lit(None).cast("int").alias("tree"))
        hot = exact.where(F.col("count") > join.leaf)
        hot = None if hot.isEmpty() else hot
        near = cold.select("set_id", "node") if hot is None else cold.select("set_id", "node").unionByName(_blocks(hot, join))
        spanning = stored(spanning.unionByName(spanning_pairs(near.join(traits, "set_id"), join)).distinct())
        touched, met = stored(_ends(spanning)), met.unionByName(cold)
    roots = components(confirmed(spanning, sets, join))
    placed = stored(touched.join(roots, F.col("set_id") == F.col("v"), "left").select("set_id", F.coalesce("root", "set_id").alias("root")))
    apart = met.join(placed, "set_id")
    if hot is not None:  # a vertex may have met none of its like in its block
        apart = apart.unionByName(_block_pairs(hot, placed, join).withColumn("tree", F.lit(None).cast("int")))
    doubtful = contested(apart.join(vertices.select("set_id", "n_shingles", "signature", "path"), "set_id"), join)
    rooted = sets.join(placed, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("root"), "shingles")
    more = exact_links(doubtful.join(rooted, "set_id"), join)
    final = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))
    first = vertices.join(final, F.col("set_id") == F.col("v"), "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root"))
    first = stored(first)
    label = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_set = first.join(label, "root").select(F.col("set_id").alias("of_set"), "component_id")
    out = own.select("id", "n_shingles", "set_id").join(by_set, F.col("set_id") == F.col("of_set"), "left")
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()


def _marked(touched: DataFrame, over: DataFrame) -> DataFrame:
    """(set_id, over) of the vertices of either, once each."""
    both = touched.withColumn("over", F.lit(False)).unionByName(over.withColumn("over", F.lit(True)))
    return both.groupBy("set_id").agg(F.bool_or("over").alias("over"))


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id has a hash that one of the ids has too: all that a join with them finds, and few others while
    the ids are few beside ``MARKS``. The broadcast words hold one bit a hash, so their number is bounded."""
    mark = F.expr(f"pmod(xxhash64(id), {MARKS}L)").alias("mark")
    marks = ids.select(mark).select(F.expr("mark DIV 64").alias("word"), F.expr("shiftleft(1L, CAST(mark % 64 AS int))").alias("bit"))
    words = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.select("id", "text", mark).join(F.broadcast(words), F.expr("mark DIV 64") == F.col("word"))
    return found.where("shiftright(bits, CAST(mark % 64 AS int)) & 1L = 1L").select("id", "text")


def _full_sets(docs: DataFrame, wanted: DataFrame, join: Join, id_col: str, text_col: str) -> DataFrame:
    """(set_id, shingles, over) of the wanted vertices (set_id, first_id, over), from the documents that stand for them."""
    word_odd, _ = join.multipliers()

    def rows(flow: Iterator[tuple]) -> Iterator[tuple]:
        for _, text in flow:
            s = shingles(text, join, word_odd)
            if len(s):
                yield np.array([s.sum(), _mix(s + np.uint64(len(s))).sum()], np.uint64).tobytes(), s.view(np.int64)

    wanted = stored(wanted)
    ids = wanted.select(F.col("first_id").alias("id"))
    chosen = _likely(texts(docs, id_col, text_col), ids).join(ids, "id", "left_semi")
    made = map_rows(chosen, "set_id binary, shingles array<bigint>", rows, batch=200)
    return made.join(wanted.select("set_id", "over"), "set_id").dropDuplicates(["set_id"])


def keep_one(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that another one of their component stands for, with their own columns.

    Of repeated rows with one id and text, one stays.
    """
    judged = stored(near_duplicates(docs, join, id_col, text_col))
    gone = judged.where("NOT kept").select(F.col("id").alias(id_col)).distinct()
    left = docs.join(gone, id_col, "left_anti")
    repeated = judged.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
    if repeated.isEmpty():
        return left
    twice = left.join(repeated.select(F.col("id").alias(id_col)), id_col, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeated.select(F.col("id").alias(id_col)), id_col, "left_anti").unionByName(twice)
