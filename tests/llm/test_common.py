"""Words of columns and packed hashes."""

import random

import numpy as np
import pyarrow as pa

from veilspark.llm import ranges as G
from veilspark.llm._common import split_words


def test_words_of_long_and_sliced_columns():
    draw = random.Random(1)
    words = ["Éa", "b", "ÇA", "Dd", "é", "日本", "x" * 90]
    texts = [None, "", " \t\n", "\x1c a"] + [draw.choice([" ", "\n\t ", "  "]).join(draw.choices(words, k=9000)) + draw.choice(["", " "]) for _ in range(90)]
    column = pa.array(["skipped"] * 3 + texts).slice(3)
    for lower in (False, True):
        some, names, at = split_words(column, lower)
        names = names.to_pylist()
        got = [names[i] for i in at.tolist()]
        low = {i: i + 32 for i in range(65, 91)} if lower else {}
        want = [[w.decode() for w in (t or "").translate(low).encode().split()] for t in texts]
        assert some.tolist() == list(map(len, want)) and got == [w for ws in want for w in ws] and len(set(names)) == len(names)


def test_packed_hashes_round_trip():
    draw = np.random.default_rng(3)
    for n, ranges in ((0, 1), (1, 7), (5000, 3), (5000, 700)):
        hashes = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        yes = draw.integers(0, 2, len(hashes)).astype(bool)
        spans = G.spans(hashes, ranges)
        assert sum(b - a for _, a, b in spans) == len(hashes)
        back = [G.unascending(G.ascending(hashes[a:b]), b - a) for _, a, b in spans]
        assert (np.concatenate(back) == hashes).all() if spans else not n
        sizes = np.array([b - a for _, a, b in spans], np.int64)
        told = pa.table({"range": pa.array([r for r, _, _ in spans], pa.int32()), "bits": G.bits_of(yes, sizes)})
        assert (G.heard(hashes, told, ranges) == yes).all()
        assert all((hashes[a:b].astype(object) * ranges // 2**64 == r).all() for r, a, b in spans)
