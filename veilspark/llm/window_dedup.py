"""Substring deduplication over words, by level-wise doubling.

A window can only be repeated if its parts are. Short windows come first: of those in
each window of full length one is chosen by its content alone, so that equal windows
choose equal ones. Only where the short window stands in two documents is it extended,
behind and before, to twice its length, and so on up to the full length.

At each level a chunk of documents sends the hashes of its windows once each, sorted, cut
into ranges of hashes, and packed as differences, a range a row; what meets in a range is
compared, and a chunk gets back one bit for each hash that it sent. Nothing is keyed by a
window, so a passage that every document has is one hash of a chunk like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import by_chunk, chunked, cut, ddl, documents, free_name, one_array, split_words, tidy, unpack_table
from .ranges import RANGE_BYTES, ascending, at_level, bits_of, heard, planes, ranges_for, spans, unascending, unplanes

WINDOW = 13

#: Words of the shortest windows.
SHORTEST = 4

_K = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: A null identifier: no document is behind it.
LAST = np.iinfo(np.int64).max


def levels(window: int, shortest: int = 7) -> list[int]:
    """Lengths, each at most twice the one before, the first at most `shortest`; the last is the window's."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


class Words:
    """The words of a chunk, end to end, and windows over them."""

    def __init__(self, texts: pa.Array, idents: np.ndarray, window: int):
        from xxhash import xxh3_128_digest

        sizes, self.names, self.index = split_words(texts)
        self.sizes = sizes.astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.doc = np.repeat(idents, self.sizes)
        digests = np.frombuffer(b"".join(map(xxh3_128_digest, self.names.cast(pa.large_binary()).to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)
        #: Both halves of each word's hash of 128 bits.
        self.halves = [digests[self.index, i] for i in range(2)]
        step = np.zeros(len(self.index) + 1, np.int32)
        has = self.sizes >= window
        np.add.at(step, self.starts[has], 1)
        np.add.at(step, self.ends[has] - window + 1, -1)
        #: Places where a window of full length starts that ends in the same document.
        self.valid = np.cumsum(step[:-1]) > 0
        self.window = window

    def windows(self, length: int, half: int = 0) -> np.ndarray:
        """Hash of the `length` words from each place on; what runs over the chunk's end is of no use."""
        n = len(self.index)
        power, have, out, done = self.halves[half], 1, None, 0
        while True:
            if length & have:
                out = power if out is None else _joined(out, _from(power, done, n))
                done += have
            have *= 2
            if have > length:
                return out
            power = _joined(power, _from(power, have // 2, n))

    def chosen(self, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, first, last, hash): windows that start at first..last have the short window at place."""
        h = self.windows(base)
        width = self.window - base + 1
        ok = np.flatnonzero(self.valid)
        if not len(ok):
            return ok, ok, ok, h[:0]
        least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        least = np.append(least, np.full(width, ~np.uint64(0)))
        have = 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        mine = (least[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = np.ones(len(ok), bool)
        head[1:] = (mine[1:] != mine[:-1]) | (ok[1:] != ok[:-1] + 1)
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(ok)) - 1
        return mine[heads], ok[heads], ok[tails], h[mine[heads]]


def _from(values: np.ndarray, k: int, n: int) -> np.ndarray:
    return np.append(values[k:], np.zeros(min(k, n), np.uint64))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * _K + right) * _MIX
    return h ^ (h >> np.uint64(32))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is among the known ones, which ascend."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


# ---------------------------------------------------------------- what a chunk sends


class Sent:
    """The distinct hashes of some windows, ascending, with the least and largest document that has each."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, more: np.ndarray | None = None):
        order = np.argsort(hashes, kind="stable") if more is None else np.lexsort((more, hashes))
        h = hashes[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        if more is not None:
            m = more[order]
            new[1:] |= m[1:] != m[:-1]
        head = np.flatnonzero(new)
        self.hashes, self.more = h[head], None if more is None else m[head]
        d = docs[order]
        self.lo = np.minimum.reduceat(d, head) if len(head) else d
        self.hi = np.maximum.reduceat(d, head) if len(head) else d
        #: The hash that each window has.
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def rows(self, number: int, ranges: int) -> pa.Table:
        """A row for each range that has hashes: all of the chunk's in it."""
        full = spans(self.hashes, ranges)
        columns = {
            "range": pa.array([r for r, _, _ in full], pa.int32()),
            "chunk": pa.array([number] * len(full), pa.int64()),
            "n": pa.array([b - a for _, a, b in full], pa.int32()),
            "hashes": pa.array([ascending(self.hashes[a:b]) for _, a, b in full], pa.binary()),
            "twice": pa.array([np.packbits(self.lo[a:b] < self.hi[a:b]).tobytes() for _, a, b in full], pa.binary()),
            "more": pa.array([None if self.more is None else self.more[a:b].tobytes() for _, a, b in full], pa.binary()),
            "lo": pa.array([None if self.more is None else self._least(a, b) for _, a, b in full], pa.binary()),
        }
        return pa.table(columns)

    def _least(self, a: int, b: int) -> bytes:
        mine = self.lo[a:b].view(np.uint64)
        return mine.min().tobytes() + planes(mine - mine.min())


_SENT = "range int, chunk long, n int, hashes binary, twice binary, more binary, lo binary"
_TOLD = "chunk long, level int, range int, bits binary"


def _answer(level: int, last: bool):
    """All that chunks sent in a range: a bit for each hash, whether two documents have it; at the last level, whether a document before the chunk's own has."""

    def answer(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        hashes = np.concatenate([unascending(b, k) for b, k in zip(table.column("hashes").to_pylist(), n.tolist(), strict=True)])
        if last:
            more = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("more").to_pylist()])
            packed = table.column("lo").to_pylist()
            lo = np.concatenate([unplanes(b[8:], k) + np.frombuffer(b, np.uint64, 1) for b, k in zip(packed, n.tolist(), strict=True)]).view(np.int64)
            order = np.lexsort((more, hashes))
            h, m = hashes[order], more[order]
            head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])))
            least = np.minimum.reduceat(lo[order], head)
            yes = np.empty(len(h), bool)
            yes[order] = np.repeat(least, np.diff(np.append(head, len(h)))) < lo[order]
        else:
            order = np.argsort(hashes, kind="stable")
            same = np.append(False, hashes[order[1:]] == hashes[order[:-1]])
            yes = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(table.column("twice").to_pylist(), n.tolist(), strict=True)]).view(bool)
            yes[order] |= same | np.append(same[1:], False)
        out = pa.table({"chunk": table.column("chunk"), "level": pa.array(np.full(len(n), level, np.int32)), "range": table.column("range"), "bits": bits_of(yes, n)})
        tidy()
        return out

    return answer


class Doubling:
    """A chunk's way up the levels: what it sends at each, from what it was told at those below."""

    def __init__(self, words: Words, lengths: list[int], ranges: int):
        self.words, self.lengths, self.ranges = words, lengths, ranges
        self.place, self.first, self.last, self.short = words.chosen(lengths[0])

    def sent(self, level: int, told: pa.Table | None) -> tuple[Sent, np.ndarray]:
        """(what the chunk sends, where its windows start); told has the levels below."""
        words, base, place = self.words, self.lengths[0], self.place
        now, starts = self._final(self.first, self.last, base) if len(self.lengths) == 1 else (Sent(self.short, words.doc[place]), place)
        for k in range(1, level + 1):
            known = now.hashes[heard(now.hashes, at_level(told, k - 1), self.ranges)]
            reach, length = self.lengths[k - 1], self.lengths[k]
            if k == 1:
                behind = before = _among(self.short, known)
            else:  # what is known are windows of the level before, from the place on or up to its end
                old = words.windows(reach)
                behind, before = _among(old[place], known), _among(old[np.maximum(place + base - reach, 0)], known)
            if length < words.window:
                starts = np.concatenate([place[behind], np.maximum(place[before] + base - length, 0)])
                now = Sent(words.windows(length)[starts], words.doc[starts])
            else:
                low = np.maximum(self.first, np.where(before, place + base - length, place + reach - length))
                high = np.minimum(self.last, np.where(behind, place, place + base - reach))
                some = (behind | before) & (low <= high)
                now, starts = self._final(low[some], high[some], length)
        return now, starts

    def _final(self, low: np.ndarray, high: np.ndarray, length: int) -> tuple[Sent, np.ndarray]:
        """Windows of full length that start at low..high, with 32 bits more of hash."""
        times = high - low + 1
        starts = np.repeat(low - np.append(0, np.cumsum(times)[:-1])[: len(times)], times) + np.arange(int(times.sum()))
        more = (self.words.windows(length, 1)[starts] >> np.uint64(32)).astype(np.uint32)
        return Sent(self.words.windows(length)[starts], self.words.doc[starts], more), starts


def _read(table: pa.Table, id_col: str, text: str, window: int) -> Words:
    idents = table.column(id_col).cast(pa.int64()).fill_null(LAST).to_numpy()
    return Words(one_array(table.column(text)), idents, window)


def repeated_windows(chunks: DataFrame, id_col: str, text: str, lengths: list[int], ranges: int) -> DataFrame:
    """Rows (chunk, level, range, bits): for each level, which of the hashes that a chunk sent are repeated."""

    def begin(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _read(unpack_table(blob), id_col, text, lengths[-1])
                yield from Doubling(words, lengths, ranges).sent(0, None)[0].rows(number, ranges).to_batches()
                del words
                tidy()

    def extend(level: int):
        def sends(number: int, docs: pa.Table, told: pa.Table) -> pa.Table:
            out = Doubling(_read(docs, id_col, text, lengths[-1]), lengths, ranges).sent(level, told)[0].rows(number, ranges)
            tidy()
            return out

        return sends

    told = None
    for k in range(len(lengths)):
        sent = chunks.select("chunk", "blob").mapInArrow(begin, _SENT) if told is None else by_chunk(chunks, told, extend(k), _SENT)
        now = cut(sent.groupBy("range").applyInArrow(_answer(k, k == len(lengths) - 1), _TOLD))  # bits alone
        told = now if told is None else told.union(now)
    return told


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shortest: int = SHORTEST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with n_words, n_removed and kept_text after its own columns.

    Words are runs without white space (space, U+0009 to U+000D). A word is removed if a
    window over it also starts in a document with a smaller identifier; kept words are
    joined by one space. Null texts have no words. A null identifier is larger than any
    other. Rows that repeat an identifier are one document as to order: neither takes
    from the other. Documents shorter than a window lose nothing. An empty table stays
    empty; clashing names take underscores.

    Windows count as equal when 96 bits of hash are, 64 and 32 from two hashes that share
    no bits of their words' hashes: of 10^13 distinct windows two differ and count as
    equal with a chance below one in a thousand.
    """
    return _removed(docs, id_col, text_col, window, shortest, range_bytes, ("kept_text", "string", lambda texts: texts.cast(pa.string())))


def _removed(docs: DataFrame, id_col: str, text_col: str, window: int, shortest: int, range_bytes: int, kept: tuple) -> DataFrame:
    chunks = chunked(docs, text_col)
    names = [free_name(docs, n) for n in ("n_words", "n_removed", kept[0])]
    lengths = levels(window, shortest)
    ranges = ranges_for(chunks, range_bytes)

    def finish(_: int, table: pa.Table, told: pa.Table) -> pa.Table:
        words = _read(table, id_col, text_col, window)
        sent, starts = Doubling(words, lengths, ranges).sent(len(lengths) - 1, told)
        taken = heard(sent.hashes, at_level(told, len(lengths) - 1), ranges)[sent.of] | (sent.lo[sent.of] < words.doc[starts])
        gone = np.zeros(len(words.index) + 1, np.int64)
        np.add.at(gone, starts[taken], 1)
        np.add.at(gone, starts[taken] + window, -1)
        left = np.cumsum(gone[:-1]) == 0
        stay = np.append(0, np.cumsum(left))
        stay = np.append(0, stay[words.ends])
        texts = pa.ListArray.from_arrays(pa.array(stay, pa.int32()), words.names.take(pa.array(words.index[left])))
        added = [pa.array(words.sizes), pa.array(words.sizes - np.diff(stay)), kept[2](pc.binary_join(texts, pa.scalar(" ", words.names.type)))]
        out = pa.table([*table.columns, *added], names=[*table.column_names, *names])
        tidy()
        return out

    told = repeated_windows(chunks, id_col, text_col, lengths, ranges)
    return by_chunk(chunks, told, finish, ddl(docs, f"`{names[0]}` bigint", f"`{names[1]}` bigint", f"`{names[2]}` {kept[1]}"))


def op6_window_dedup(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    digest = ("kept_sha256", "string", lambda texts: pa.array([hashlib.sha256(x).hexdigest() for x in texts.cast(pa.large_binary()).to_pylist()], pa.string()))
    out = _removed(docs, "doc_id", "text", WINDOW, SHORTEST, RANGE_BYTES, digest)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM g) WHERE first < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
k AS (
  SELECT a.doc_id, count(*) AS n_words, count(p.i) AS n_removed, string_agg(a.word, ' ' ORDER BY a.i) FILTER (WHERE p.i IS NULL) AS kept
  FROM a LEFT JOIN p ON a.doc_id = p.doc_id AND a.i = p.i GROUP BY a.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
