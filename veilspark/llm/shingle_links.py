"""Links between texts whose sets of word shingles are alike, found exactly: by prefixes of rare shingles.

Two sets of a similarity of `num`/`den` or more share a shingle among the first
n - ceil(n * num / den) + 1 of either one, in any order that is the same for all. The order
here puts shingles first whose bucket of hashes has few occurrences in all documents, so a
passage that very many documents have is in no prefix of a text with enough of its own.
Documents that share a shingle of their prefixes are candidates; from how many they share,
and where in the order, follows how many their sets can share at most, and where that is
enough their whole sets are compared. Links are wanted for components: documents that are linked already are not
compared again. In rounds, each shared shingle names one of its documents and the others
not linked to it are compared with that one, until the pairs left are few or a round links
little; those are all compared. So a group of thousands of near copies is linked without all its pairs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, one_array, split_words, stored, tidy
from .components import components
from .word_ids import slices

#: Words of a shingle, and the least similarity as a fraction.
WORDS, NUM, DEN = 5, 4, 5

#: Buckets of hashes whose occurrences order the shingles: so many sums reach the driver, and go to each task.
BUCKET_BITS = 18

#: Pairs for each row that shares a shingle up to which all pairs are compared, and rounds after which they are in any case.
PAIRS_A_ROW, ROUNDS = 4, 8

#: Part of the pairs that a round leaves, at least, to be the last one.
LITTLE = 0.8

#: Documents that the keys of one group name in a round, at most.
LEADERS = 4

_K, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending hashes of 64 bits: A-Z lowered; fewer words are one shingle, none have none."""
    from xxhash import xxh3_64_intdigest

    sizes, names, at = split_words(texts, lower=True)
    h = np.fromiter(map(xxh3_64_intdigest, names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))[at]
    ends = np.cumsum(sizes)

    def mixed(parts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            out = (out ^ p) * _K
            out ^= out >> np.uint64(29)
        out *= _MIX
        return out ^ (out >> np.uint64(32))

    whole = mixed([h[k : len(h) - words + 1 + k] for k in range(words)]) if len(h) >= words else h[:0]
    out = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        else:
            out.append(mixed([h[k : k + 1] for k in range(a, b)]) if b > a else h[:0])
    return out


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _sets(batches, text: int):
    """(batch, sets) of slices."""
    for part in (p for batch in batches for p in slices(batch, batch.schema.names[text])):
        yield part, shingle_sets(one_array(part.column(text)))


def _loads(batches, bits: int):
    """Occurrences of each bucket in a task's documents."""
    n = np.zeros(1 << bits, np.int64)
    for _, sets in _sets(batches, 1):
        for s in sets:
            np.add.at(n, _bucket(s, bits), 1)
    full = np.flatnonzero(n)
    for k in range(0, len(full), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(full[k : k + 65_536].astype(np.int32)), pa.array(n[full[k : k + 65_536]])], names=["bucket", "n"])
    tidy()


def _prefixes(batches, told, bits: int, num: int, den: int):
    """Rows (key, id, n, rest): the rarest shingles of each document, as many as a partner cannot all miss; n: shingles of its set, rest: those from this one on."""
    load = np.frombuffer(told.value, np.int64)
    for part, sets in _sets(batches, 1):
        keys = []
        for s in sets:
            p = len(s) + (-len(s) * num) // den + 1 if len(s) else 0
            keys.append(s[np.lexsort((s, load[_bucket(s, bits)]))[:p]])
        some = np.fromiter(map(len, keys), np.int64, len(keys))
        n = np.fromiter(map(len, sets), np.int32, len(sets))
        ids = part.column(0).to_numpy()
        sizes = np.repeat(n, some)
        rest = sizes - (np.arange(len(sizes)) - np.repeat(np.cumsum(some) - some, some)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, some)), pa.array(sizes), pa.array(rest)], names=["key", "id", "n", "rest"])
    tidy()


def _whole(batches):
    for part, sets in _sets(batches, 1):
        ends = np.cumsum([0, *map(len, sets)])
        values = pa.array(np.concatenate(sets).view(np.int64))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["id", "shingles"])
    tidy()


def _fits(a: str, b: str, num: int, den: int):
    """Sizes that a pair of that similarity may have."""
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def shingle_links(docs: DataFrame, id_col: str, text_col: str, linked: DataFrame | None = None, num: int = NUM, den: int = DEN, pairs_a_row: int = PAIRS_A_ROW, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) of distinct long identifiers: with them, and those of `linked`, any two documents of a similarity of num/den or more are in one component.

    Every edge is itself a pair that similar. linked: edges that are known already. Texts
    without words have no edges; null texts have no words. An empty table has no edges.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    load = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in texts.mapInArrow(functools.partial(_loads, bits=BUCKET_BITS), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        load[r.bucket] = r.n
    told = spark.sparkContext.broadcast(load.tobytes())
    rows = stored(texts.mapInArrow(functools.partial(_prefixes, told=told, bits=BUCKET_BITS, num=num, den=den), "key long, id long, n int, rest int"))
    # Most keys are in one document. Both sides of the join are stored, so that Spark can deal out the rows of a key that very many share.
    keys = stored(rows.groupBy("key").count().where("count > 1").select("key"))
    shared = stored(rows.join(keys.hint("shuffle_hash"), "key", "left_semi"))
    told_rows = shared.count()

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets are similar. Only documents of pairs have their sets made; which they are is a table, so where they are few Spark sends them to the texts."""
        pairs = cut(pairs.groupBy("a", "b").agg(F.max("root").alias("root"), F.max("of").alias("of")))
        ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sets = stored(texts.join(ids, "id", "left_semi").mapInArrow(_whole, "id long, shingles array<long>"))
        a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(a, "a").join(b, "b").where(both * (num + den) >= (F.size("x") + F.size("y")) * num).select("a", "b", "root", "of")

    found = spark.createDataFrame([], "a long, b long")
    label = components(linked.select("a", "b")) if linked is not None else spark.createDataFrame([], "node long, root long")
    now = shared.join(label.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", "n", "rest", F.coalesce("root", "id").alias("root"))
    before = float("inf")
    for turn in range(rounds + 1):
        groups = now.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("twice"))
        open_keys = cut(groups.where("twice > 0"))
        left = (open_keys.agg(F.sum(F.col("twice").cast("double")).alias("t")).first().t or 0) / 2
        if not left:
            break
        now = cut(now.join(open_keys.select("key"), "key", "left_semi"))
        # A round that links little says that the pairs left are unlike: all of them are met, and what their prefixes share rules most of them out.
        if left <= pairs_a_row * told_rows or turn == rounds or left > LITTLE * before:
            found = found.union(alike(_across(now, num, den)).select("a", "b"))
            break
        before = left
        # Keys of one group of documents name up to LEADERS of them: each further one halves, or better, what is not linked yet.
        lead = now.groupBy("key").agg(F.min_by(F.struct("id", "n", "root"), F.xxhash64("id", F.pmod("key", F.lit(LEADERS)), F.lit(turn))).alias("lead"))
        met = now.join(lead, "key").select(F.col("id").alias("a"), "n", "root", F.col("lead.id").alias("b"), F.col("lead.n").alias("m"), F.col("lead.root").alias("of"))
        more = cut(alike(met.where((F.col("root") != F.col("of")) & _fits("n", "m", num, den))))
        found = found.union(more.select("a", "b"))
        # Only components that the new links touch are joined, so a round's graph is small.
        moved = components(more.select(F.col("root").alias("a"), F.col("of").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
        now = now.join(moved, "root", "left").select("key", "id", "n", "rest", F.coalesce("to", "root").alias("root"))
    return cut(found)


def _across(now: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs of documents that share keys and are not linked: from pairs of components, so that no pair within one is made.

    Two sets so similar share `least` shingles; the first that they share has as many from
    it on in either set. So a shared key with fewer from it on says nothing of a pair. Those
    with enough are the first ones that the sets share, and behind the last of them both
    sets can share no more than the shorter rest: that bounds what they share in all.
    """
    least = lambda n, m: (F.col(n) + F.col(m)) * num  # noqa: E731  shingles shared at least, times num + den
    enough = lambda n, m, rest, left: F.least(rest, left) * (num + den) >= least(n, m)
    # The most that is left, and the smallest set, of a component's documents at a key: what they rule out, none of its documents needs to meet.
    of = now.groupBy("key", "root").agg(F.min("n").alias("n0"), F.max("rest").alias("rest0"))
    ways = of.join(of.select("key", F.col("root").alias("to"), F.col("n0").alias("m0"), F.col("rest0").alias("left0")), "key")
    ways = ways.where((F.col("root") < F.col("to")) & enough("n0", "m0", "rest0", "left0")).select("key", "root", "to", "m0", "left0")
    met = ways.join(now.select("key", "root", F.col("id").alias("a"), "n", "rest"), ["key", "root"]).where(enough("n", "m0", "rest", "left0")).drop("m0", "left0")
    met = met.join(now.select("key", F.col("root").alias("to"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("rest").alias("left")), ["key", "to"])
    met = met.where(_fits("n", "m", num, den) & enough("n", "m", "rest", "left"))
    met = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.min(F.least("rest", "left")).alias("behind"), F.max("n").alias("n"), F.max("m").alias("m"), F.max("root").alias("root"), F.max("to").alias("of"))
    return met.where((F.col("c") + F.col("behind") - 1) * (num + den) >= least("n", "m")).select("a", "b", "root", "of")
