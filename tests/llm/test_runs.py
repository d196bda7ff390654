"""Periodic runs against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from veilspark.llm.periodic_runs import lyndon, op12_periodic_runs, periodic_runs, runs_in, runs_of, with_periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(s, least=24, times=3):
    """All maximal runs: for each period the maximal stretches, unless a smaller one has the period of the whole."""
    found = {}
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((i, n, p) for (i, n), p in found.items()), key=lambda x: (x[0], x[2]))


class Watched(list):
    """A list that counts what is read."""

    reads = 0

    def __getitem__(self, i):
        self.reads += 1
        return list.__getitem__(self, i)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def strings():
    draw = random.Random(3)
    yield from ("".join(x) for n in range(1, 8) for x in itertools.product("ab", repeat=n))
    yield from ("".join(x) for x in itertools.product("abc", repeat=6))
    for k in range(400):
        n = draw.randrange(1, 80)
        yield "".join(draw.choices("abc"[: 1 + k % 3], k=n))
    for _ in range(300):
        s = ""
        while len(s) < 60:
            s += draw.choice(["".join(draw.choices("ab", k=draw.randrange(1, 5))) * draw.randrange(1, 6), s[-draw.randrange(1, 12) :] * 2])
        yield s
    yield from (fibonacci(200), "ab" * 60, "a" * 90, "aab" * 30 + "aaa", "abcabcabd" * 9)


def test_lyndon_array_and_runs():
    for text in strings():
        s = [ord(c) - 96 for c in text]
        nss, shared = lyndon([*s, 0])
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
            m = next(m for m in range(len(s) - j + 1) if j + m == len(s) or s[i + m] != s[j + m])
            assert (nss[i], shared[i]) == (j, m), (text, i)
        for least, times in ((1, 3), (6, 3), (4, 4)):
            assert runs_of(np.array(s), least, times) == plain(s, least, times), text
            assert runs_in(np.array(s) * 7, least, times) == plain(s, least, times), text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, fibonacci(20_000), "aab" * 3000 + "aaab" * 3000, "".join(random.Random(1).choices("ab", k=20_000)), "".join(bin(k).count("1") % 2 * "b" or "a" for k in range(20_000)), ("a" * 50 + "b") * 400, ("abc" * 40 + "d") * 160])
def test_reads_grow_with_the_length(text):
    """Nothing that was matched is matched again: some reads a place, also of very periodic texts, in either order."""
    for turn in (1, -1):
        s = Watched([*(98 + turn * (ord(c) - 97) for c in text), 0])
        lyndon(s)
        assert s.reads < 8 * len(text)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len((r.text or "").split()) < 3000]
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and len(rows) > 190
    for r in rows:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
    assert sum(g[1] for g in got.values()) > 10


def test_odd_rows(spark):
    nested = ("a b " * 20 + "c ") * 5
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, nested), (4, nested), (None, "x y z\x1c " * 30), (5, "one\x0btwo\r\n" * 12 + "one"), (6, "Eé " * 23), (7, "E " * 24), (8, "l m n " * 400_000 + "end"), (9, " ".join(f"w{k % 997}" for k in range(3500)))]
    docs = spark.createDataFrame([(i, 0, t) for i, t in rows], "doc_id long, RUNS int, text string").repartition(3)
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "RUNS", "text", "n_words", "runs_", "collapsed_text"]
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r["runs_"]], r.collapsed_text) for r in out.collect()))
    inner = [(41 * k, 40, 2) for k in range(5)]
    whole = sorted([*inner, (0, 205, 41)], key=lambda x: (x[0], x[2]))
    assert got == [
        (0, 90, [(0, 90, 3)], "x y z\x1c"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 205, whole, "a b c"), (4, 205, whole, "a b c"), (5, 25, [(0, 25, 2)], "one two"),
        (6, 23, [], " ".join(["Eé"] * 23)), (7, 24, [(0, 24, 1)], "E"), (8, 1_200_001, [(0, 1_200_000, 3)], "l m n end"), (9, 3500, [(0, 3500, 997)], " ".join(f"w{k}" for k in range(997))),
    ]
    assert periodic_runs(docs.limit(0)).count() == 0


def test_planted_words(spark):
    rows = [(k, "one two three four " * 5000) for k in range(40)] + [(None, "a b")] + [(k, t) for k in range(100, 140) for t in ("", None, "a", "a  b\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.text) for r in with_periods(docs).collect()}
    want = set()
    for i, t in rows:
        words, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if i is None or h % 10 or not n:
            want.add((i, t or ""))
            continue
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        want.add((i, " ".join(w if k < a else words[a + (k - a) % p] for k, w in enumerate(words))))
    assert got == want
