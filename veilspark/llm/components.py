"""Connected components over edges of longs: stars within each task's edges, and alternating stars across tasks."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Edges that a task joins at once; a graph of more goes to several.
EDGES = 200_000


def _joined(edges: np.ndarray) -> pa.RecordBatch:
    """For edges (rows of two nodes) the stars of their components: each node but the least, and the least."""
    nodes, at = np.unique(edges, return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in at.reshape(-1, 2).tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    ends = np.fromiter(map(find, range(len(nodes))), np.int64, len(nodes))
    moved = np.flatnonzero(ends != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[ends[moved]])], names=["a", "b"])


def _stars(batches, most: int):
    """Stars of a task's edges, up to `most` edges at once."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            if n + part.num_rows > most:
                yield _joined(np.concatenate(held))
                held, n = [], 0
            held.append(np.column_stack([c.to_numpy() for c in part.columns]))
            n += part.num_rows
    if n:
        yield _joined(np.concatenate(held))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours the least node that it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    larger = both.where("b > a").join(least, F.col("a") == F.col("k"))
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    others = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, task_edges: int = EDGES) -> DataFrame:
    """Rows (node, root) for every node on an edge (columns a, b): root is the least node that it reaches.

    Edges may repeat and go either way; loops are ignored. A hub's edges are never in one
    task as a group: minima are aggregated before the shuffle, and the join that hands
    them back can be split. Rounds grow as the logarithm of the longest path. Each round
    begins with the stars of what a task reads, task_edges at most; a graph that is no
    larger takes no further round, and no shuffle besides that of its distinct edges.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if told == before or not told.n:
            break
        before = told
        tasks = -(-told.n // task_edges)  # few edges are no work for as many tasks as the documents had
        now = cut(now.coalesce(tasks).mapInArrow(functools.partial(_stars, most=task_edges), "a long, b long"))
        if tasks == 1:
            break
        now = cut(_small_star(_large_star(now)))
    # A stable set of edges is stars: each node but the root once on the left.
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
