"""Suffix-array deduplication: removes every byte of a string of `length` bytes that starts anywhere else too.

A full suffix array of a corpus is many times its size, so the suffixes are sampled by
their content: each window of `length` bytes has one anchor, its least hash of a few
bytes, and equal windows have equal anchors at equal places. A window holds half its
length before or behind its anchor, so a suffix is only needed where the half behind the
anchor, or the half before it, is repeated; hashes of halves are counted first.

The remaining suffixes are range-partitioned by their leading bytes with sampled
splitters. A bucket sorts its suffixes, and what stands before them read backwards, by
three-way multikey quicksort over words of eight bytes. Neighbours' common prefixes give
classes of suffixes equal to any depth; two windows are equal when the parts behind and
before the suffix's start are. Suffixes with equal leading halves stay in one bucket as
long as one holds them. Of a half with more than `bucket_rows` suffixes each window is a
suffix of its own: these are range-partitioned and sorted the same way, but their buckets
end anywhere, also among equal ones, and a bucket's first and last windows are compared
with those of its neighbours. Both ways compare bytes, so the bound changes no result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_chunk, chunked, ddl, documents, free_name, stored, text_bytes, tidy, unpack_table
from .ranges import ascending, bits_of, heard, planes, ranges_for, spans, unascending, unplanes

LENGTH = 200

#: Suffixes with the same leading half that one bucket takes at most; beyond, their windows are sorted each by itself.
BUCKET_ROWS = 1 << 16

#: Window starts that are looked at together.
BLOCK = 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_HALF_WORD = np.uint64(32)


class Corpus:
    """The texts of a chunk, end to end."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = b"".join(texts)

    def valid(self, length: int) -> np.ndarray:
        """Whether a window of `length` bytes that starts here ends in the same text."""
        step = np.zeros(len(self.data) + 1, np.int32)
        has = self.sizes >= length
        np.add.at(step, self.starts[has], 1)
        np.add.at(step, self.ends[has] - length + 1, -1)
        return np.cumsum(step[:-1]) > 0


def _words(data: bytes, count: int) -> np.ndarray:
    """Little-endian words of eight bytes that start at each of the first `count` places."""
    out = np.empty(count, np.uint64)
    padded = data.ljust(count + 16, b"\0")
    for k in range(min(8, count)):
        part = out[k::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), k)
    return out


def _gram_width(length: int) -> int:
    return max(1, min(16, length // 4))


def anchors(corpus: Corpus, length: int) -> np.ndarray:
    """Rows (anchor, least, most): windows that start `least` to `most` bytes before the anchor have it as theirs."""
    gram = _gram_width(length)
    width = length - gram + 1
    low = np.uint64((1 << (8 * min(gram, 8))) - 1)
    high = np.uint64((1 << (8 * max(gram - 8, 0))) - 1)
    valid = corpus.valid(length)
    found = []
    for at in range(0, len(valid), BLOCK):
        ok = np.flatnonzero(valid[at : at + BLOCK])
        if not len(ok):
            continue
        count = min(BLOCK, len(valid) - at) + width - 1
        words = _words(corpus.data[at : at + count + 16], count + 8)
        h = (((words[:count] & low) * _M1) ^ ((words[8 : count + 8] & high) * _M2)) * _M3
        h ^= h >> np.uint64(29)
        h *= _M1
        least = (h >> _HALF_WORD << _HALF_WORD) | np.arange(count, dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        mine = (least[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.ones(len(ok), bool)
        first[1:] = (mine[1:] != mine[:-1]) | (ok[1:] != ok[:-1] + 1)
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(ok)) - 1
        found.append(np.stack([mine[heads] + at, mine[heads] - ok[tails], mine[heads] - ok[heads]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    width = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, width)))).view("<u8")
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * _M1
        h ^= h >> np.uint64(31)
    h *= _M2
    return h ^ (h >> np.uint64(29))


def _slices_at(corpus: Corpus, starts: np.ndarray, width: int) -> np.ndarray:
    data = np.frombuffer(corpus.data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, width)[starts] if len(starts) else np.zeros((0, width), np.uint8)


def suffixes(corpus: Corpus, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows (start, least, most), hashes of their leading halves): windows that start `least` to `most` bytes before a suffix's start."""
    half, gram = length // 2, _gram_width(length)
    a = anchors(corpus, length)
    behind = a[a[:, 1] <= half]
    behind = np.stack([behind[:, 0], behind[:, 1], np.minimum(behind[:, 2], half)], axis=1)
    before = a[a[:, 2] > half]
    before = np.stack([before[:, 0] - half, np.maximum(before[:, 1], half + 1) - half, before[:, 2] - half], axis=1)
    # A window with its anchor at most half its length behind its start has length - half bytes from there on.
    one = _hash_rows(_slices_at(corpus, behind[:, 0], length - half))
    two = _hash_rows(_slices_at(corpus, before[:, 0], half + gram))
    return np.concatenate([behind, before]), np.concatenate([one << np.uint64(1), two << np.uint64(1) | np.uint64(1)]).view(np.int64)


#: Rows that multikey quicksort hands to a plain sort of their bytes.
FEW = 24


def multikey_sort(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of the rows of words, ties by size: three-way quicksort on one word; equal rows go on with the next word."""
    words = words.astype(np.uint64)
    order, width = np.arange(len(words)), words.shape[1]
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        mine = order[low:high]
        if high - low <= FEW:
            rows = words[mine, depth:].tolist()
            order[low:high] = mine[sorted(range(len(rows)), key=lambda i: (rows[i], sizes[mine[i]]))]
            continue
        if depth == width:
            order[low:high] = mine[np.argsort(sizes[mine], kind="stable")]
            continue
        column = words[mine, depth]
        pivot = np.sort(column[:: max(1, len(column) // 9)])[min(4, (len(column) - 1) // 2)]
        less, more = column < pivot, column > pivot
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate([mine[less], mine[~(less | more)], mine[more]])
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


class SortedSide:
    """Strings in multikey order with the common prefixes of neighbours."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        width = max(8, int(-(-self.sizes.max(initial=0) // 8) * 8))
        flat = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(-1, width)
        self.order = multikey_sort(flat.view(">u8"), self.sizes)
        rows = flat[self.order]
        common = np.empty(max(0, len(rows) - 1), np.int64)
        for k in range(0, len(common), 8192):
            differ = rows[k + 1 : k + 8193] != rows[k : k + len(rows[k + 1 : k + 8193])]
            common[k : k + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        sizes = self.sizes[self.order]
        self.common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))

    def classes(self, depth: int) -> np.ndarray:
        """A number for each string; strings of `depth` bytes at least have the same if equal so far."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.append(0, np.cumsum(self.common < depth)) if len(self.order) else 0
        return out


def repeated_spans(right: list[bytes], left: list[bytes], least: np.ndarray, most: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, low, high): in the row's text, start+low to start+high is covered by repeated windows.

    All windows of a row hold the first bytes of its suffix, so that what they cover has no gap.
    """
    behind, before = SortedSide(right), SortedSide([s[::-1] for s in left])
    n = len(right)
    first, last = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    for e in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        mine = np.flatnonzero((least <= e) & (e <= most))
        if not len(mine):
            continue
        key = before.classes(e)[mine] * n + behind.classes(length - e)[mine]
        _, where = np.unique(key, return_inverse=True)
        hit = mine[np.bincount(where, weight[mine])[where] >= 2]
        first[hit] = np.minimum(first[hit], e)
        last[hit] = e
    rows = np.flatnonzero(last >= 0)
    return rows, -last[rows], length - first[rows]


def _texts(table: pa.Table, text: str) -> Corpus:
    return Corpus(text_bytes(table.column(text)))


def repeats(chunks: DataFrame, text: str, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (chunk, start, stop): parts of the chunk's texts, end to end, that repeated windows cover."""
    ranges = ranges_for(chunks)

    def halves(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, n = np.unique(suffixes(_texts(unpack_table(blob), text), length)[1].view(np.uint64), return_counts=True)
                full = spans(hashes, ranges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in full], pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array([b - a for _, a, b in full], pa.int32()),
                     pa.array([ascending(hashes[a:b]) for _, a, b in full], pa.binary()), pa.array([planes(n[a:b]) for _, a, b in full], pa.binary())],
                    names=["range", "chunk", "n", "hashes", "times"],
                )
                tidy()

    def total(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        hashes, times = (np.concatenate([f(b, k) for b, k in zip(table.column(c).to_pylist(), sizes.tolist(), strict=True)]) for c, f in (("hashes", unascending), ("times", unplanes)))
        order = np.argsort(hashes, kind="stable")
        head = np.flatnonzero(np.append(True, hashes[order[1:]] != hashes[order[:-1]]))
        sums = np.empty(len(hashes), np.uint64)
        sums[order] = np.repeat(np.add.reduceat(times[order], head), np.diff(np.append(head, len(hashes))))
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "bits": bits_of(sums > 1, sizes), "hot": bits_of(sums > bucket_rows, sizes)})

    sent = chunks.select("chunk", "blob").mapInArrow(halves, "range int, chunk long, n int, hashes binary, times binary")
    counted = sent.groupBy("range").applyInArrow(total, "chunk long, range int, bits binary, hot binary")

    def contexts(number: int, docs: pa.Table, told: pa.Table) -> pa.Table:
        corpus = _texts(docs, text)
        rows, hashes = suffixes(corpus, length)
        known, of = np.unique(hashes.view(np.uint64), return_inverse=True)
        hit, hot = (heard(known, told, ranges, c)[of] for c in ("bits", "hot"))
        data = corpus.data
        alike: dict[tuple, list[int]] = {}
        for s, a, b in rows[hit & ~hot].tolist():
            alike.setdefault((data[s : s + length - a], data[s - b : s], a, b), []).append(s)
        out = [(number, r, f, a, b, None, places) for (r, f, a, b), places in alike.items()]
        windows: dict[bytes, list[int]] = {}
        for s, a, b in rows[hot].tolist():
            for p in range(s - b, s - a + 1):
                windows.setdefault(data[p : p + length], []).append(p)
        out += [(number, None, None, 0, 0, w, places) for w, places in windows.items()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        made = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "right", "left", "least", "most", "window", "places"])
        tidy()
        return made

    schema = "chunk long, right binary, left binary, least int, most int, window binary, places array<bigint>"
    found = stored(by_chunk(chunks, counted, contexts, schema))  # range partitioning reads it twice
    spark = chunks.sparkSession

    def bucket(batches):
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        places = held.column("places").to_pylist()
        weight = np.fromiter(map(len, places), np.float64, len(places))
        least, most = (held.column(c).to_numpy().astype(np.int64) for c in ("least", "most"))
        rows, low, high = repeated_spans(held.column("right").to_pylist(), held.column("left").to_pylist(), least, most, weight, length)
        numbers = held.column("chunk").to_numpy()
        at = [places[r] for r in rows.tolist()]
        times = np.fromiter(map(len, at), np.int64, len(at))
        start = np.array([p for x in at for p in x], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers[rows], times)), pa.array(start + np.repeat(low, times)), pa.array(start + np.repeat(high, times))], names=["chunk", "start", "stop"])

    n = found.agg(F.count("right").alias("some"), F.count("window").alias("hot")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = found.where("window is null").repartitionByRange(max(parts, -(-n.some // bucket_rows)), F.substring("right", 1, length - length // 2))
    covered = some.select("chunk", "right", "left", "least", "most", "places").mapInArrow(bucket, "chunk long, start long, stop long")
    if not n.hot:
        return covered
    hot = found.where("window is not null").select("window", "chunk", "places").repartitionByRange(max(parts, -(-n.hot // bucket_rows)), "window", "chunk")
    return covered.union(_across(hot.mapInArrow(functools.partial(sorted_windows, length=length), _SORTED)))


_SORTED = "chunk long, start long, stop long, edge binary, n long"


def sorted_windows(batches, length: int):
    """A bucket of windows in multikey order: places of those that repeat in it, and its first and last window with their numbers of places."""
    held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if held is None:
        return
    windows, places, numbers = held.column("window").to_pylist(), held.column("places").to_pylist(), held.column("chunk").to_numpy()
    width = -(-length // 8) * 8
    words = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in windows]), ">u8").reshape(-1, width // 8)
    order = multikey_sort(words, np.zeros(len(words), np.int64))
    same = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    head = np.flatnonzero(np.append(True, ~same))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    times = np.fromiter(map(len, places), np.int64, len(places))[order]
    total = np.bincount(group, times).astype(np.int64)
    rows: list[tuple] = []
    for i in np.flatnonzero(total[group] > 1).tolist():
        rows += [(numbers[order[i]], p, p + length, None, None) for p in places[order[i]]]
    for g in {0, len(head) - 1}:
        i = order[head[g]]
        p = places[i][0] if total[g] == 1 else None
        rows.append((numbers[i], p, None if p is None else p + length, windows[i], total[g]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "start", "stop", "edge", "n"])


def _across(buckets: DataFrame) -> DataFrame:
    """Places of repeated windows of all buckets: a window that is alone in its bucket and stands at its edge may go on in the next one."""
    made = stored(buckets)
    edges = made.where("edge is not null")  # two rows a bucket at most
    totals = edges.groupBy("edge").agg(F.sum("n").alias("all")).where("all > 1")
    alone = edges.where("n = 1").join(totals, "edge").select("chunk", "start", "stop")
    return made.where("edge is null").select("chunk", "start", "stop").union(alone)


def _cut_texts(corpus: Corpus, spans: pa.Table):
    """(kept bytes, bytes removed, runs removed) of each text."""
    step = np.zeros(len(corpus.data) + 1, np.int64)
    np.add.at(step, spans.column("start").to_numpy(), 1)
    np.add.at(step, spans.column("stop").to_numpy(), -1)
    gone = np.cumsum(step[:-1]) > 0
    data = np.frombuffer(corpus.data, np.uint8)
    for a, b in zip(corpus.starts.tolist(), corpus.ends.tolist(), strict=True):
        mine = gone[a:b]
        n = int(mine.sum())
        if n:
            yield data[a:b][~mine].tobytes(), n, int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
        else:
            yield corpus.data[a:b], 0, 0


def _removed(docs: DataFrame, text_col: str, length: int, bucket_rows: int, kept: tuple) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept = (name, Spark type, Arrow type, function of the kept bytes)."""
    chunks = chunked(docs, text_col)
    names = [free_name(docs, n) for n in ("n_bytes", "n_removed", "n_spans", kept[0])]

    def finish(_: int, table: pa.Table, spans: pa.Table) -> pa.Table:
        corpus = _texts(table, text_col)
        left, n, runs = zip(*_cut_texts(corpus, spans), strict=True)
        added = [pa.array(corpus.sizes), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array([kept[3](x) for x in left], kept[2])]
        tidy()
        return pa.table([*table.columns, *added], names=[*table.column_names, *names])

    schema = ddl(docs, f"`{names[0]}` bigint", f"`{names[1]}` bigint", f"`{names[2]}` bigint", f"`{names[3]}` {kept[1]}")
    return by_chunk(chunks, repeats(chunks, text_col, length, bucket_rows), finish, schema)


def suffix_dedup(docs: DataFrame, text_col: str = "text", length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_bytes (binary) after its own columns.

    Bytes are those of UTF-8; null texts count as empty. Matches never cross documents;
    rows that repeat a text of `length` bytes or more lose all of it. Texts shorter than
    `length` lose nothing. What is removed is judged on the input alone. An empty table
    stays empty; clashing names take underscores.
    """
    return _removed(docs, text_col, length, bucket_rows, ("kept_bytes", "binary", pa.binary(), bytes))


def suffix_dedup_text(docs: DataFrame, text_col: str = "text", length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """As suffix_dedup(), with kept_text (string) in place of the bytes; what a cut leaves of a character is dropped."""
    return _removed(docs, text_col, length, bucket_rows, ("kept_text", "string", pa.string(), lambda x: bytes(x).decode("utf-8", "ignore")))


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = _removed(docs, "text", LENGTH, BUCKET_ROWS, ("kept_sha256", "string", pa.string(), lambda x: hashlib.sha256(x).hexdigest()))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
