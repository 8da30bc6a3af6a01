"""Approximate nearest neighbours: an inverted multi-index.

The two halves of a vector are quantised apart, each by ``k`` centroids, so ``k * k`` cells hold the vectors. A
query walks the pairs of centroids by the sum of their squared distances, with a heap, until the cells it met hold
enough vectors, and their entries are ranked by the Euclidean distance of the original vectors.

The defaults are for vectors without structure, the hardest case: on random directions of 64 dimensions it takes
nearly half of all vectors to hold nine in ten of the nearest. Clustered vectors need far fewer.

The centroids are fitted on at most ``SAMPLE`` vectors, chosen by a hash of the id; every vector is indexed. A
query looks at ``candidates`` vectors or more, the whole of each cell it enters. Cells with the same first centroid
lie together, dealt into blocks of ``BLOCK`` vectors; a query goes once to each of these blocks, with the list of
the cells it enters, so a vector that very many rows share is no hot key.
What reaches the driver are the sample and the counts of at most ``K_MOST ** 2`` cells.

Defined cases: vectors that are null, zero, of another length than most of the sample, or hold a null or
non-finite part take no part; ties go to the smaller id; repeated vectors are entries of their own, and of rows
that share an id each is one; with fewer candidates than asked for, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.llm.common import stored

SAMPLE = 20_000
K_MOST = 256
BLOCK = 512
SHARE = 0.45


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite part, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, for the choice of cells only."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)


def walk(first: np.ndarray, second: np.ndarray, counts: dict[int, int], candidates: int) -> Iterator[int]:
    """Cells that hold vectors, by the sum of the two halves' distances, until enough are met."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    k, met = len(b), 0
    heap, seen = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap and met < candidates:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if n := counts.get(cell, 0):
            met += n
            yield cell
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < k and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (float(first[a[i2]] + second[b[j2]]), i2, j2))


def search(
    vectors: DataFrame, is_query: Column, neighbours: int = 10, candidates: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of every query's nearest found rows other than its own."""
    kind = vectors.schema[id_col].dataType.simpleString()
    clean = stored(
        vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .where(usable(F.col("v"))).withColumn("entry", F.monotonically_increasing_id())
    )
    rows = clean.count()
    share = int(1_000_000 * min(1.0, SAMPLE / max(rows, 1)))
    sample = [r["v"] for r in clean.where(F.pmod(F.xxhash64("vec_id", "entry"), F.lit(1_000_000)) < share).select("v").limit(2 * SAMPLE).collect()]
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    width = int(np.bincount([len(v) for v in sample]).argmax())
    x = np.array([v for v in sample if len(v) == width])
    half = max(1, width // 2)
    k = int(min(K_MOST, max(1, np.sqrt(rows / 4)), len(x)))
    centres = _kmeans(x[:, :half], k, 1), _kmeans(x[:, half:], k, 2) if width > half else np.zeros((1, 0))
    columns = len(centres[1])
    wanted = max(2_000, int(SHARE * rows)) if candidates is None else candidates

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(v[:, :half], centres[0]), _distances(v[:, half:], centres[1])

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.asarray(b.column("v").flatten()).reshape(b.num_rows, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d1, d2 = halves(matrix(b))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d1.argmin(1) * columns + d2.argmin(1), pa.int64())], names=[*b.schema.names, "cell"])

    fitting = clean.where(F.size("v") == width)
    index = stored(fitting.mapInArrow(assign, f"vec_id {kind}, v array<double>, is_query boolean, entry long, cell long"))
    counts = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    held: dict[int, int] = {}
    for cell, n in counts.items():
        held[cell // columns] = held.get(cell // columns, 0) + n

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d1, d2 = halves(matrix(b))
            at, firsts, blocks, cells = [], [], [], []
            for i in range(b.num_rows):
                entered: dict[int, list[int]] = {}
                for cell in walk(d1[i], d2[i], counts, wanted + 1):
                    entered.setdefault(cell // columns, []).append(cell)
                for first, own in entered.items():
                    for block in range(-(-held[first] // BLOCK)):
                        at.append(i)
                        firsts.append(first)
                        blocks.append(block)
                        cells.append(own)
            for s in range(0, len(at), 5_000):
                e = s + 5_000
                rows_at = pa.array(at[s:e], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(rows_at) for c in ("vec_id", "entry", "v")), pa.array(firsts[s:e], pa.int64()), pa.array(blocks[s:e], pa.int64()), pa.array(cells[s:e], pa.list_(pa.int64()))],
                    names=["query_id", "query_entry", "q", "first", "block", "cells"],
                )

    asked = index.where("is_query").select("vec_id", "entry", "v").mapInArrow(visits, f"query_id {kind}, query_entry long, q array<double>, first long, block long, cells array<long>")
    first = F.expr(f"cell div {columns}")
    sizes = F.broadcast(index.groupBy(first.alias("first")).count())  # at most K_MOST rows
    block = F.pmod(F.xxhash64("entry"), F.ceil(F.col("count") / BLOCK).cast("long")).alias("block")
    dealt = index.withColumn("first", first).join(sizes, "first").select("first", block, "cell", "vec_id", "entry", "v")

    def rank(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entries) and len(queries):
            v, ids, own, cell = np.stack(entries["v"].to_numpy()), entries["vec_id"].to_numpy(), entries["entry"].to_numpy(), entries["cell"].to_numpy()
            for query_id, entry, q, cells in zip(queries["query_id"], queries["query_entry"], queries["q"], queries["cells"]):
                look = np.flatnonzero(np.isin(cell, np.asarray(cells)) & (own != entry))
                score = np.sqrt(((v[look] - np.asarray(q)) ** 2).sum(axis=1))
                if len(look) > neighbours:  # all that tie with the last one stay for the order by id
                    near = score <= np.partition(score, neighbours - 1)[neighbours - 1]
                    look, score = look[near], score[near]
                found += [(query_id, entry, ids[look[i]], score[i]) for i in np.lexsort((ids[look], score))[:neighbours]]
        return pd.DataFrame(found, columns=["query_id", "query_entry", "vec_id", "score"])

    near = dealt.groupBy("first", "block").cogroup(asked.groupBy("first", "block")).applyInPandas(rank, f"query_id {kind}, query_entry long, vec_id {kind}, score double")
    order = Window.partitionBy("query_entry").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
