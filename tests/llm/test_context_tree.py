import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from veilspark.llm.context_tree import estimate, lm_scores


def brute(texts, learn, depth):
    """log10 probability of each text by the definition: every node of every tree by recursion."""
    counts = Counter()
    streams = [[(tuple(reversed((b"\xff" * depth + t)[i : i + depth])), (t + b"\xff")[i]) for i in range(len(t) + 1)] for t in texts]
    for stream, use in zip(streams, learn, strict=True):
        for ctx, b in stream if use else ():
            for k in range(8):
                for d in range(depth + 1):
                    counts[ctx[:d], k, b >> (8 - k), (b >> (7 - k)) & 1] += 1
    every = {ctx for stream in streams for ctx, _ in stream}
    children = {}
    for ctx in every:
        for d in range(depth):
            children.setdefault(ctx[:d], set()).add(ctx[: d + 1])

    @lru_cache(None)
    def own(ctx, k, prefix):
        n0, n1 = counts[ctx, k, prefix, 0], counts[ctx, k, prefix, 1]
        return sum(math.log((i + 0.5)) for i in range(n0)) + sum(math.log(i + 0.5) for i in range(n1)) - sum(math.log(i + 1) for i in range(n0 + n1))

    @lru_cache(None)
    def total(ctx, k, prefix):
        if len(ctx) == depth:
            return own(ctx, k, prefix)
        return np.logaddexp(own(ctx, k, prefix), sum(total(c, k, prefix) for c in children[ctx])) - math.log(2)

    def bit(ctx, k, prefix, value, d):
        n = [counts[ctx[:d], k, prefix, v] for v in (0, 1)]
        p = (n[value] + 0.5) / (sum(n) + 1)
        if d == depth:
            return p
        w = math.exp(own(ctx[:d], k, prefix) - math.log(2) - total(ctx[:d], k, prefix))
        return w * p + (1 - w) * bit(ctx, k, prefix, value, d + 1)

    return [sum(math.log10(bit(ctx, k, b >> (8 - k), (b >> (7 - k)) & 1, 0)) for ctx, b in stream for k in range(8)) for stream in streams]


def base(texts, learn):
    tokens = [[*t.lower().split(), None] for t in texts]
    counts = Counter(w for ws, use in zip(tokens, learn, strict=True) if use for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws in tokens]


def test_estimate():
    got = estimate(np.array([0, 1, 3, 200]), np.array([0, 0, 2, 7]))
    want = [sum(math.log(i + 0.5) for n in ab for i in range(n)) - sum(math.log(i + 1) for i in range(sum(ab))) for ab in ((0, 0), (1, 0), (3, 2), (200, 7))]
    assert np.allclose(got, want)


TEXTS = ["the cat sat on the mat", "The cat sat", None, "", "  ", "the dog sat on a log\nthe end", "żółć the cat", "the cat sat on the mat", "w" * 100 + " x", "\x00a b " * 40]


@pytest.mark.parametrize(("depth", "chunk_bytes"), [(2, 1 << 20), (3, 30), (4, 200)])
def test_against_definition(spark, depth, chunk_bytes):
    learn = [zlib.crc32(str(i).encode()) % 3 != 0 for i in range(len(TEXTS))]
    docs = spark.createDataFrame([(i, t, u, "x") for i, (t, u) in enumerate(zip(TEXTS, learn, strict=True))], "doc_id long, text string, learn boolean, Score string")
    got = {r.doc_id: r for r in lm_scores(docs, "learn", depth=depth, chunk_bytes=chunk_bytes).collect()}
    raw = [(t or "").encode() for t in TEXTS]
    for i, (want, (n, known, train, b)) in enumerate(zip(brute(raw, learn, depth), base(raw, learn), strict=True)):
        row = got[i]
        assert row["score_"] == pytest.approx(want, rel=1e-9)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, train)
        assert row.base_score == pytest.approx(b, rel=1e-9)
        assert row.bits_per_byte == pytest.approx(-want / math.log10(2) / (len(raw[i]) + 1))


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab", False), (None, None, None)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in lm_scores(docs, "learn").collect()}
    assert got[1].score == pytest.approx(-24 * math.log10(2)) and got[None].score == pytest.approx(-8 * math.log10(2))
    assert got[1].n_known == 0 and got[1].train_tokens == 0
    assert lm_scores(docs.limit(0), "learn").count() == 0


def test_learns(spark):
    """Held-out texts like those learned from take fewer bits than others."""
    words = ["alpha", "beta", "gamma", "delta"]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words, 40)), i < 80) for i in range(100)] + [(100, "".join(map(chr, rng.integers(97, 122, 240))), False)]
    got = {r.doc_id: r.bits_per_byte for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "learn").collect()}
    assert max(got[i] for i in range(80, 100)) < 1 < got[100]
