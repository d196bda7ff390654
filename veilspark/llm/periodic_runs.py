r"""Periodic runs of words, in linear time over any ordered alphabet.

For two opposite orders of a text's words, the Lyndon array is computed: for each place
the next place whose suffix is smaller, with the words that the two suffixes share. Words
are compared one by one and nothing else is looked up, no suffix structure and no hash;
a stretch that was matched once is never matched again: the match that reaches farthest
tells what the same comparison gave one match earlier, and where that does not settle it,
comparing goes on behind the farthest place seen. A run of at least three periods begins
within a period before its first Lyndon root, whose match gives its end.

A word of a run of `times` periods stands in it that often, so rarer words of a text cut
it: stretches between them are looked at each for itself.
"""

from __future__ import annotations

from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ddl, documents, free_name, one_array, split_words, text_bytes, tidy
from .word_ids import slices

#: Words that a run has at least, and periods.
LEAST_LENGTH, TIMES = 24, 3

#: Words from which numbers are kept in plain arrays: slower than lists, and a fifth of their memory.
MANY = 1 << 16

RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon(s) -> tuple:
    """(next smaller suffix of each place, words shared with it): s holds positive letters and a zero at its end, which is no place."""
    n = len(s) - 1
    blank = (lambda v: [v] * n) if n < MANY else (lambda v: array("q", [v]) * n)
    nss, shared, pss, before, beside = blank(n), blank(0), blank(-1), blank(0), blank(0)
    # The match that reaches farthest: s[here:far] is s[here - back:far - back], and s[far] is not s[far - back].
    here = back = far = 0
    for r in range(1, n):
        at = r - 1
        m = 0
        scan = True
        if r < far:
            m = beside[r - back]  # the same two neighbours, one match earlier
            scan = m >= far - r
            if scan:
                m = far - r
        if scan:
            while s[at + m] == s[r + m]:
                m += 1
            here, back, far = r, 1, r + m
        beside[r] = m
        while True:
            if s[r + m] > s[at + m]:
                pss[r], before[r] = at, m
                break
            nss[at], shared[at] = r, m
            up, known = pss[at], before[at]
            if up < 0:
                break
            if m > known:  # the suffix at `up` leaves that at `at` before r's does
                pss[r], before[r] = up, known
                break
            if m == known:
                scan = True
                if here < r and r + m < far:
                    if up >= here:  # both places lie in the match: what they gave one match earlier
                        a, b = up - back, r - back
                        e = shared[a] if nss[a] == b else before[b] if pss[b] == a else n
                        scan = e >= far - r
                        m = far - r if scan else e
                if scan:
                    while s[up + m] == s[r + m]:
                        m += 1
                    here, back, far = r, r - up, r + m
            at = up
    return nss, shared


def runs_of(letters: np.ndarray, least_length: int = LEAST_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of positive letters, in order."""
    n = len(letters)
    found = set()
    for s in (letters, letters.max(initial=0) + 1 - letters):
        ended = np.append(s, 0)
        ended = ended.tolist() if n < MANY else array("q", ended.astype(np.int64).tobytes())
        nss, shared = lyndon(ended)
        after, match = np.array(nss, np.int64), np.array(shared, np.int64)
        for i in np.flatnonzero(match > after - np.arange(n)).tolist():
            p, end = nss[i] - i, nss[i] + shared[i]
            if i >= p and nss[i - p] == i and i + shared[i - p] == end:
                continue  # not its run's first root
            start = i
            while start and ended[start - 1] == ended[start - 1 + p]:
                start -= 1
            if end - start >= max(least_length, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def runs_in(words: np.ndarray, least_length: int = LEAST_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs of a text's words, given as numbers: words that are too rare for a run cut it."""
    if len(words) < least_length:
        return []
    _, letters, counts = np.unique(words, return_inverse=True, return_counts=True)
    edges = np.diff(np.concatenate([[0], (counts[letters] >= times).astype(np.int8), [0]]))
    found = []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        if b - a >= least_length:
            found += [(a + start, length, p) for start, length, p in runs_of(letters[a:b] + 1, least_length, times)]
    return found


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places that no run holds behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        steps[start + p] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def _found(column: pa.Array, least_length: int, times: int) -> list[pa.Array]:
    """n_words, runs and collapsed text of each text of a column."""
    counts, names, at = split_words(column)
    runs, kept, sizes = [], [], []
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        mine = runs_in(at[a:b], least_length, times)
        stay = _kept(b - a, mine) if mine else np.ones(b - a, bool)
        runs.append(mine)
        kept.append(stay)
        sizes.append(int(stay.sum()))
    flat = np.array([r for mine in runs for r in mine], np.int64).reshape(-1, 3)
    each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), each)
    stays = np.concatenate(kept) if kept else np.zeros(0, bool)
    words = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int64()), names.take(pa.array(at[stays])))
    return [pa.array(counts, pa.int64()), listed, pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())]


def periodic_runs(docs: DataFrame, text_col: str = "text", least_length: int = LEAST_LENGTH, times: int = TIMES) -> DataFrame:
    """docs with n_words, runs (start word, length, smallest period; by start, then period) and collapsed_text.

    A run is a stretch of words of at least least_length and of at least `times` periods
    (3 or more) that no neighbouring word extends. collapsed_text keeps each run's first
    period: words joined by one space, without those that a run holds behind it. Null and
    empty texts have no words and no runs. Rows are looked at each for itself, repeated
    ones too, in no order; texts are taken whole however long, in memory of some hundred
    bytes a word. Other columns stay; added ones take underscores if docs has their names.
    """
    if times < 3:
        raise ValueError("times is 3 at least: runs of fewer periods need not have two roots beside each other")
    names = [free_name(docs, c) for c in ("n_words", "runs", "collapsed_text")]
    place = docs.columns.index(text_col)

    def run(batches):
        for part in (p for batch in batches for p in slices(batch, text_col)):
            columns = _found(one_array(part.column(place)), least_length, times)
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])
        tidy()

    return docs.mapInArrow(run, ddl(docs, *(f"{c} {t}" for c, t in zip(names, ("long", RUNS, "string"), strict=True))))


def with_periods(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text); for a tenth of all identifiers (by crc32) words repeat from some place of the text on: cases that are known to have runs."""

    def repeat(ident: int, text: bytes) -> bytes:
        h = crc32(str(ident).encode())
        words = text.split() if h % 10 == 0 else []
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        period = words[a : a + 1 + (n - a) // (3 + g % 8)]
        return b" ".join(words[:a] + (period * (-(-(n - a) // len(period))))[: n - a])

    def run(batches):
        for part in (p for batch in batches for p in slices(batch, "text")):
            texts = [text if ident is None else repeat(ident, text) for ident, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, text string")


def op12_periodic_runs(spark, sf_dir) -> DataFrame:
    docs = with_periods(documents(spark, sf_dir).select("doc_id", "text"))
    out = periodic_runs(docs)
    none = F.get("runs", F.lit(0))
    best = F.aggregate("runs", none, lambda b, x: F.when(x["length"] * b["period"] > b["length"] * x["period"], x).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed_text")).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
