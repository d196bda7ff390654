"""Language-model scoring by context-tree weighting.

A byte is eight binary decisions, each with a tree of byte contexts: a node is the last
d bytes and the bits of the byte so far, d from 0 to `depth`. A node holds how often
either bit followed in the training texts, the Krichevsky-Trofimov estimate of those
bits, and that estimate weighted half and half against what its children make of them.
The score of a bit mixes the estimates of all depths along its path by their weights
in the trained tree; a byte's is the product over its bits.

The tree is built over all executors. A chunk of documents sends each distinct gram
(context and next byte) once. Grams that share all but one byte of their context, at
most 65,536, make a subtree in one task; the levels above are sums by key. Weights go
down the same way, every gram gets its probability once, and chunks look theirs up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_chunk, chunked, cut, ddl, documents, free_name, one_array, split_words, stored, text_bytes, tidy, unpack_table

#: Bytes of context. A gram is one byte longer and has to fit 62 bits.
DEPTH = 4

#: Bytes of text in a chunk, positions that are looked at together.
CHUNK_BYTES, BLOCK = 16 << 20, 1 << 19

#: A byte that UTF-8 never has: before and after each text.
EDGE = 0xFF

#: Rows of whole subtrees that are worked on together, at least.
TOGETHER = 1 << 17

_LN2 = float(np.log(2.0))


# ---------------------------------------------------------------- estimates


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1/2) for whole n >= 0."""
    x = n + 0.5
    small = x < 10
    y = np.where(small, x + 10, x)
    r = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    if small.any():
        s = x[small]
        below = np.ones(len(s))
        for k in range(10):
            below *= s + k
        out[small] -= np.log(below)
    return out


def _lgamma_whole(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1) for whole n >= 0."""
    y = n + 11.0
    r = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    below = np.ones(len(y))
    for k in range(1, 11):
        below *= n + k
    return out - np.log(below)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(np.float64), n1.astype(np.float64)
    return _lgamma_half(n0) + _lgamma_half(n1) - _lgamma_whole(n0 + n1) - 1.1447298858494002


def weighted(own: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(ln of the weighted probability, weight of the node's own estimate); below: the children's product, None at full depth."""
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - _LN2
    return both, np.exp(own - _LN2 - both)


# ---------------------------------------------------------------- subtrees


class Level:
    """Nodes of one depth; a key is the context, the nearest byte first, and a byte of bits behind a leading one."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.total, self.weight = weighted(estimate(n0, n1), below)

    def mixed(self, a0: np.ndarray, a1: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probabilities of both bits so far, and the weight left, after this level."""
        n = self.n0 + self.n1 + 1.0
        share = rest * self.weight
        return a0 + share * (self.n0 + 0.5) / n, a1 + share * (self.n1 + 0.5) / n, rest * (1 - self.weight)


def parent_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> 16 << 8) | (keys & 255)


def subtree(grams: np.ndarray, n: np.ndarray, levels: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """(levels from full depth up, each level's places in the one above, places of each gram's eight bits at full depth)."""
    keys, zeros, ones, at = [], [], [], np.empty((8, len(grams)), np.int64)
    have = 0
    for k in range(8):
        prefix = grams >> (8 - k)
        head = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        bit = (grams >> (7 - k)) & 1
        one = np.add.reduceat(n * bit, head)
        keys.append((prefix[head] >> k << 8) | (1 << k) | (prefix[head] & ((1 << k) - 1)))
        ones.append(one)
        zeros.append(np.add.reduceat(n, head) - one)
        at[k] = np.repeat(np.arange(have, have + len(head)), np.diff(np.append(head, len(grams))))
        have += len(head)
    made, up = [Level(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones), None)], []
    for _ in range(levels - 1):
        last = made[-1]
        mine, where = np.unique(parent_of(last.keys), return_inverse=True)
        sums = [np.bincount(where, x, len(mine)) for x in (last.n0, last.n1, last.total)]
        made.append(Level(mine, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2]))
        up.append(where)
    return made, up, at


_NODES = "key long, n0 long, n1 long, total double"


def _whole_groups(batches, top: int):
    """Tables of sorted rows, each with all rows of the groups that it has; the first column is the group."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        groups = table.column(top).to_numpy()
        end = int(np.searchsorted(groups, groups[-1]))
        if end:
            yield table.slice(0, end)
            held, size = table.slice(end).combine_chunks().to_batches(), table.num_rows - end
    if size:
        yield pa.Table.from_batches(held)


def _lowest(batches):
    """Subtrees of two levels: the upper level's nodes."""
    for table in _whole_groups(batches, 0):
        level = subtree(table.column(1).to_numpy(), table.column(2).to_numpy(), 2)[0][1]
        yield pa.RecordBatch.from_arrays([pa.array(level.keys), pa.array(level.n0), pa.array(level.n1), pa.array(level.total)], names=["key", "n0", "n1", "total"])


def _weigh(batches):
    for batch in batches:
        level = Level(*(batch.column(i).to_numpy() for i in range(4)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(level.total), pa.array(level.weight)], names=["key", "n0", "n1", "total", "weight"])


def _score_grams(batches):
    """Rows (group, gram, n, a0, a1, rest), grams before nodes: each gram's log10 probability."""
    for table in _whole_groups(batches, 0):
        is_node = table.column("a0").is_valid().to_numpy()
        grams, n = (table.column(c).to_numpy()[~is_node] for c in ("gram", "n"))
        keys, a0, a1, rest = (table.column(c).to_numpy()[is_node] for c in ("gram", "a0", "a1", "rest"))
        order = np.argsort(keys)
        (low, high), (up,), at = subtree(grams, n, 2)
        given = order[np.searchsorted(keys[order], high.keys)]
        a0, a1, rest = high.mixed(a0[given], a1[given], rest[given])
        a0, a1, _ = low.mixed(a0[up], a1[up], rest[up])
        logs = np.log10(np.stack([a0, a1]))
        bits = np.stack([(grams >> (7 - k)) & 1 for k in range(8)])
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(logs[bits, at].sum(axis=0))], names=["gram", "log_p"])


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (gram, log_p) from rows (gram, n), one a gram; n: how often the training texts have it, 0 if only others do."""
    by_key = F.shiftright("key", 16) * 256 + F.col("key").bitwiseAND(255)
    rows = grams.select(F.shiftright("gram", 16).alias("group"), "gram", "n")
    ready = cut(rows.repartition("group").sortWithinPartitions("group", "gram").mapInArrow(_lowest, _NODES))
    above = []
    last = ready
    for _ in range(depth - 1):
        sums = last.groupBy(by_key.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("total").alias("total"))
        last = cut(sums.mapInArrow(_weigh, f"{_NODES}, weight double"))
        above.append(last)
    share, n = F.col("rest") * F.col("weight"), F.col("n0") + F.col("n1") + 1.0
    told = above[-1].withColumns({"a0": F.lit(0.0), "a1": F.lit(0.0), "rest": F.lit(1.0)})
    for below in [*above[-2::-1], ready]:
        mixed = told.select(
            F.col("key").alias("above"),
            (F.col("a0") + share * (F.col("n0") + 0.5) / n).alias("a0"),
            (F.col("a1") + share * (F.col("n1") + 0.5) / n).alias("a1"),
            (F.col("rest") * (1 - F.col("weight"))).alias("rest"),
        )
        told = below.join(mixed, by_key == F.col("above")).drop("above")
    nodes = told.select(F.shiftright("key", 8).alias("group"), F.col("key").alias("gram"), F.lit(0).cast("long").alias("n"), "a0", "a1", "rest")
    none = F.lit(None).cast("double")
    both = rows.select("group", "gram", "n", none.alias("a0"), none.alias("a1"), none.alias("rest")).union(nodes)
    both = both.repartition("group").sortWithinPartitions(F.col("group"), F.col("a0").isNotNull(), F.col("gram"))
    return both.mapInArrow(_score_grams, "gram long, log_p double")


# ---------------------------------------------------------------- chunks


class Texts:
    """The texts of a chunk end to end, with edges, for grams of depth + 1 bytes."""

    def __init__(self, texts: list[bytes], depth: int):
        self.depth, edge = depth, bytes([EDGE])
        before = edge * depth
        self.data = np.frombuffer(before + before.join([t + edge for t in texts]), np.uint8)
        #: Bytes to predict of each text, and where they start.
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.cumsum(self.sizes + depth) - self.sizes

    def blocks(self, flags: np.ndarray):
        """(places, grams, flags) of the bytes to predict, a block at a time; flags: one for each text."""
        stop = self.starts + self.sizes
        for at in range(self.depth, len(self.data), BLOCK):
            end = min(at + BLOCK, len(self.data))
            # Texts in this block, and which places are theirs.
            a, b = np.searchsorted(stop, at, "right"), np.searchsorted(self.starts, end)
            low, high = np.maximum(self.starts[a:b], at), np.minimum(stop[a:b], end)
            ok = np.zeros(end - at + 1, np.int8)
            np.add.at(ok, low - at, 1)
            np.add.at(ok, high - at, -1)
            ok = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
            grams = np.zeros(end - at, np.int64)
            for j in [*range(1, self.depth + 1), 0]:  # the nearest byte first, the byte itself last
                grams <<= 8
                grams |= self.data[at - j : end - j]
            yield ok + at, grams[ok], np.repeat(flags[a:b], high - low)


def _gram_counts(texts: Texts, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how often texts that are learned from have them: a block's are merged with those before it."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, mine, flag in texts.blocks(learn):
        if not len(mine):
            continue
        mine <<= 1
        mine |= flag
        mine.sort()
        g = mine >> 1
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        mine &= 1
        n = np.add.reduceat(mine, head)
        both = np.concatenate([grams, g[head]])
        order = np.argsort(both, kind="stable")  # two ascending runs
        both, n = both[order], np.concatenate([counts, n])[order]
        head = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        grams, counts = both[head], np.add.reduceat(n, head)
    return grams, counts


def _sums(texts: Texts, known: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    order = np.argsort(known)
    known, log_p = known[order], log_p[order]
    out = np.zeros(len(texts.sizes))
    index = np.arange(len(texts.sizes))
    for _, mine, text in texts.blocks(index):
        if not len(mine):
            continue
        bits = int(len(mine) - 1).bit_length()
        packed = np.sort(mine << bits | np.arange(len(mine)))  # a gram and its place fit 62 bits
        g = packed >> bits
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        values = np.empty(len(mine))
        values[packed & ((1 << bits) - 1)] = np.repeat(log_p[np.searchsorted(known, g[head])], np.diff(np.append(head, len(g))))
        out += np.bincount(text, values, len(out))
    return out


#: Longer words travel as a space and their XXH3 of 128 bits: no word has a space. Two such words that
#: share all 128 bits would count as one word.
LONG_WORD = 64


def _keys(words: pa.Array) -> pa.Array:
    words = words.cast(pa.large_binary())
    long = pc.greater(pc.binary_length(words), LONG_WORD)
    if not pc.any(long, min_count=0).as_py():
        return words.cast(pa.binary())
    from xxhash import xxh3_128_digest

    return pa.array([b" " + xxh3_128_digest(w) if len(w) > LONG_WORD else w for w in words.to_pylist()], pa.binary())


def lm_scores(docs: DataFrame, learn: str, text_col: str = "text", depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte after its own columns.

    learn names a boolean column: texts where it is true are learned from, all are scored.
    score is the log10 probability of the text's bytes and its end; bits_per_byte its code
    length over the bytes and the end. Null texts count as empty and have the end alone.
    Rows that repeat all count. Without a text to learn from every bit has one half. An
    empty table stays empty; clashing names take underscores.
    """
    if not 2 <= depth <= 4:
        raise ValueError("depth is 2 to 4 bytes")
    chunks = chunked(docs, text_col, chunk_bytes)
    names = [free_name(docs, n) for n in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")]

    def gather(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = unpack_table(blob)
                flags = table.column(learn).fill_null(False).to_numpy().astype(np.int64)
                grams, n = _gram_counts(Texts(text_bytes(table.column(text_col)), depth), flags)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), number)), pa.array(grams), pa.nulls(len(grams), pa.binary()), pa.array(n)], names=["chunk", "gram", "word", "n"])
                some, words, at = split_words(one_array(table.column(text_col)), lower=True)
                counts = np.bincount(at, np.repeat(flags, some), len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), pa.nulls(len(words), pa.int64()), _keys(words), pa.array(counts)], names=["chunk", "gram", "word", "n"])
                del table, grams, n, some, words, at, counts
                tidy()

    told = stored(chunks.select("chunk", "blob").mapInArrow(gather, "chunk long, gram long, word binary, n long"))
    of_grams, of_words = told.where("gram is not null").select("chunk", "gram", "n"), told.where("word is not null").select("chunk", "word", "n")
    scored = gram_scores(cut(of_grams.groupBy("gram").agg(F.sum("n").alias("n"))), depth)
    # Sums are made before a shuffle, and Spark can split the join's partition of a word that every chunk has.
    counts = cut(of_words.groupBy("word").agg(F.sum("n").alias("c")))
    ends = docs.where(F.col(learn)).count()
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    train, distinct = (total.n or 0) + ends, total.v + (ends > 0)

    back = of_grams.select("chunk", "gram").join(scored, "gram").select("chunk", "gram", F.lit(None).cast("binary").alias("word"), F.col("log_p").alias("value"))
    back = back.union(of_words.select("chunk", "word").join(counts, "word").select("chunk", F.lit(None).cast("long").alias("gram"), "word", F.col("c").cast("double").alias("value")))

    def finish(_: int, table: pa.Table, told: pa.Table) -> pa.Table:
        is_gram = told.column("gram").is_valid()
        mine = told.filter(is_gram)
        texts = Texts(text_bytes(table.column(text_col)), depth)
        score = _sums(texts, mine.column("gram").to_numpy(), mine.column("value").to_numpy())
        some, words, at = split_words(one_array(table.column(text_col)), lower=True)
        others = told.filter(pc.invert(is_gram))
        where = pc.index_in(_keys(words), value_set=others.column("word").combine_chunks()).to_numpy(zero_copy_only=False)
        c = others.column("value").to_numpy()[where] if len(words) else np.zeros(0)
        text = np.repeat(np.arange(len(some)), some)
        per_word, end = np.log10((c + 0.1) / (train + 0.1 * (distinct + 1))), float(np.log10((ends + 0.1) / (train + 0.1 * (distinct + 1))))
        base = np.bincount(text, per_word[at], len(some)) + end
        known = np.bincount(text, (c > 0)[at], len(some)).astype(np.int64) + (ends > 0)
        added = [pa.array(some.astype(np.int64) + 1), pa.array(known), pa.array(np.full(len(some), train, np.int64)), pa.array(base), pa.array(score), pa.array(-score / np.log10(2.0) / texts.sizes)]
        tidy()
        return pa.table([*table.columns, *added], names=[*table.column_names, *names])

    kinds = ("bigint", "bigint", "bigint", "double", "double", "double")
    return by_chunk(chunks, back, finish, ddl(docs, *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))))


def op8_lm_scoring(spark, sf_dir) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    docs = documents(spark, sf_dir).select("doc_id", "text", held.alias("held_out"), (~held).alias("learn"))
    out = lm_scores(docs, "learn")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
