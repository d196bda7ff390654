"""SimHash near-duplicates by vantage-point trees.

Fingerprints that are equal are one point. A tree of vantage points, grown from a sample
of a fixed size, parts the points by Hamming distance: a node's inner side takes those
within its radius, the outer side the rest, and a point at most `bits` beyond the radius
is a guest of the inner side too. By the triangle inequality two points within `bits` of
each other then meet in at least one leaf. Leaves are shards; those with too many points
are parted again by trees of their own, in rounds, until none is. A shard grows its tree
the same way down to small sets that are compared outright, and gives a star for each
of its components in place of pairs. The stars of all shards make the components.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, documents, text_bytes
from .components import components

#: Bits that linked fingerprints may differ in, words of a shingle, seed of its hash.
BITS, SHINGLE, SEED = 3, 3, 42

#: Points that a tree is grown from, about, and points that a shard should have; one with more than CROWDED times as many is parted again.
SAMPLE, SHARD, CROWDED = 16_384, 2_048, 8

#: Vantage points that a node tries before it stays a leaf.
TRIES = 8

#: Points that a shard compares outright.
OUTRIGHT = 256


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digests = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    n = len(digests) // 8
    counts = np.zeros(64, np.int64)
    hashes = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for k in range(0, n, 65_536):
        counts += np.unpackbits(hashes[k : k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _radius(distances: np.ndarray, bits: int) -> int | None:
    """The radius that makes the larger side smallest; None if either side would keep nearly all."""
    counts = np.bincount(distances, minlength=65 + bits)
    within = np.cumsum(counts)
    inner, outer = within[bits : 65 + bits], len(distances) - within[:65]
    larger = np.maximum(inner, outer)
    best = int(larger.argmin())
    return best if larger[best] < 0.9 * len(distances) else None


def grow(sample: np.ndarray, levels: int, bits: int = BITS) -> list:
    """Tree as nested lists [vantage point, radius, inner, outer]; a leaf is its number."""
    leaves = 0

    def node(points: np.ndarray, level: int):
        nonlocal leaves
        if level and len(points) >= 8:
            for k in range(min(TRIES, len(points))):
                d = np.bitwise_count(points ^ points[k])
                radius = _radius(d, bits)
                if radius is not None:
                    rest = np.arange(len(points)) != k
                    return [int(points[k]), radius, node(points[rest & (d <= radius + bits)], level - 1), node(points[rest & (d > radius)], level - 1)]
        leaves += 1
        return leaves - 1

    return node(sample, levels)


def route(tree, points: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(shards, points): every point in each leaf that it is at home or a guest in."""
    shards, out, stack = [], [], [(tree, points)]
    while stack:
        node, points = stack.pop()
        if not len(points):
            continue
        if isinstance(node, int):
            shards.append(np.full(len(points), node, np.int64))
            out.append(points)
            continue
        d = np.bitwise_count(points ^ np.uint64(node[0]))
        stack.append((node[2], points[d <= node[1] + bits]))
        stack.append((node[3], points[d > node[1]]))
    return (np.concatenate(shards), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _near(points: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of distinct points, by search that drops what it has reached."""
    edges, rest = [], np.arange(len(points))
    if len(points) <= OUTRIGHT:
        close = (np.bitwise_count(points[:, None] ^ points[None, :]) <= bits).sum(axis=1) > 1
        rest = rest[close]
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = np.bitwise_count(points[rest] ^ points[i]) <= bits
            if hit.any():
                found = rest[hit].tolist()
                edges += [(i, j) for j in found]
                queue += found
                rest = rest[~hit]
    return edges


def link(points: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(point, least point of its component) for the points with a neighbour."""
    points = np.unique(points)
    edges: list[tuple[int, int]] = []
    stack = [np.arange(len(points))]
    while stack:
        mine = stack.pop()
        if len(mine) > OUTRIGHT:
            d = np.bitwise_count(points[mine] ^ points[mine[len(mine) // 2]])
            radius = _radius(d, bits)
            if radius is not None:
                stack.append(mine[d <= radius + bits])
                stack.append(mine[d > radius])
                continue
        edges += [(int(mine[i]), int(mine[j])) for i, j in _near(points[mine], bits)]
    root = list(range(len(points)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    some = sorted({i for e in edges for i in e})
    ends = [find(i) for i in some]
    moved = [(i, r) for i, r in zip(some, ends, strict=True) if i != r]
    return points[[i for i, _ in moved]], points[[r for _, r in moved]]


def _split(now: DataFrame, sizes: DataFrame, bits: int, shard: int) -> tuple[DataFrame, bool]:
    """(rows (shard, fp, whole) of crowded shards, parted by a tree each; whether there are any that could not be parted, which are whole).

    A shard's points go to several tasks, and its tree to each of them, ahead of the points.
    """
    told = sizes.limit(2).collect()
    # Points of a single shard, as all are at first, need not meet its size in a join.
    crowded = now.where(F.col("shard") == told[0].shard).withColumn("n", F.lit(told[0].n)) if len(told) == 1 else now.join(sizes, "shard")

    def plant(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        points = np.sort(table.column("fp").to_numpy().view(np.uint64))
        np.random.default_rng(len(points)).shuffle(points)
        tree = grow(points, max(1, int(np.ceil(np.log2(n / shard)))), bits)
        return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "parts": pa.array([-(-n // SAMPLE)], pa.int64()), "whole": pa.array([isinstance(tree, int)])})

    chance = F.pmod(F.xxhash64("fp", "shard"), F.col("n"))
    trees = cut(crowded.where(chance < SAMPLE).groupBy("shard").applyInArrow(plant, "shard string, tree binary, parts long, whole boolean"))
    copies = trees.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tree", F.lit(None).cast("long").alias("fp"))
    points = crowded.select("shard", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / SAMPLE)).cast("long").alias("part"), F.lit(None).cast("binary").alias("tree"), "fp")
    rows = copies.union(points).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("tree").isNull())

    def spread(batches):
        name, tree = None, None
        for batch in batches:
            shards, planted = batch.column(0), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            fps = batch.column(3).fill_null(0).to_numpy().view(np.uint64)
            starts = np.flatnonzero(planted).tolist()
            for a, b in zip([None, *starts], [*starts, batch.num_rows], strict=True):
                if a is not None:
                    name, tree = shards[a].as_py(), pickle.loads(batch.column(2)[a].as_py())
                leaves, there = route(tree, fps[0 if a is None else a + 1 : b], bits) if tree is not None else (np.zeros(0, np.int64), fps[:0])
                whole = isinstance(tree, int)
                names = pa.array([name if whole else f"{name}/{k}" for k in leaves.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(there.view(np.int64)), pa.array(np.full(len(there), whole))], names=["shard", "fp", "whole"])

    parted = cut(rows.select("shard", "part", "tree", "fp").mapInArrow(spread, "shard string, fp long, whole boolean"))
    return parted, not trees.where("whole").isEmpty()


def near_components(fps: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Rows (fp, component_id) for each distinct fingerprint; component_id is the least doc_id that it reaches."""
    points = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))

    def stars(table: pa.Table) -> pa.Table:
        a, b = link(table.column("fp").to_numpy().view(np.uint64), bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    stars_of = lambda rows: rows.groupBy("shard").applyInArrow(stars, "a long, b long")
    edges, most = [], shard
    now = points.select(F.lit("").alias("shard"), "fp")
    while True:
        sizes = cut(now.groupBy("shard").agg(F.count("*").alias("n")))
        told = sizes.agg(F.count_if(F.col("n") > most).alias("crowded"), F.count_if(F.col("n") <= most).alias("fit")).first()
        if not told.crowded:
            edges.append(stars_of(now))
            break
        if told.fit:
            edges.append(stars_of(now.join(sizes.where(F.col("n") <= most).drop("n"), "shard", "left_semi")))
        parted, any_whole = _split(now, sizes.where(F.col("n") > most), bits, shard)
        if any_whole:
            edges.append(stars_of(parted.where("whole")))
        now, most = parted.where("not whole").select("shard", "fp"), CROWDED * shard
    found = edges[0]
    for more in edges[1:]:
        found = found.union(more)
    roots = components(found)
    linked = cut(roots.join(points, F.col("node") == F.col("fp")).select("fp", "root", "least"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.select("fp", "root").join(least, "root").select(F.col("fp").alias("k"), "component_id")
    whole = points.join(linked, F.col("fp") == F.col("k"), "left")
    return cut(whole.select("fp", F.coalesce("component_id", "least").alias("component_id")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs; its other columns are left out, so that none can clash.

    Null texts count as empty; texts without words have fingerprint zero and link like
    any other. A text with fewer words than a shingle is one shingle. Rows that repeat
    are in one component. A component of null identifiers alone has a null id; else nulls
    are passed over. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    # Both sides are plain exchanges, so Spark can split the partition of a fingerprint that very many rows have.
    found = near_components(fps, bits, shard).withColumnRenamed("fp", "k")
    return fps.join(found, F.col("fp") == F.col("k")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark, sf_dir) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
