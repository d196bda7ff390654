import random

import numpy as np
import pytest
import xxhash

from veilspark.llm import simhash as S

SF = "/root/testdata/sf0.001"


def plain(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_force(fps, bits=3):
    """Component numbers of the points."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(draw, n, spread):
    out = []
    while len(out) < n:
        base = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 2, 40])):
            out.append(base)
            for b in draw.sample(range(64), draw.randrange(spread)):
                base ^= 1 << b
    return list(dict.fromkeys(out[:n]))


@pytest.mark.parametrize("seed", range(3))
def test_routing_brings_neighbours_together(seed):
    draw = random.Random(seed)
    fps = np.array(clustered(draw, 1500, 5), np.uint64)
    tree = S.grow(fps[::2], 6)
    shards, there = S.route(tree, fps)
    homes = {}
    for s, p in zip(shards.tolist(), there.tolist(), strict=True):
        homes.setdefault(p, set()).add(s)
    assert len(set(shards.tolist())) > 4
    close = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert len(close) > 50
    for i, j in close:
        assert homes[int(fps[i])] & homes[int(fps[j])]


@pytest.mark.parametrize("spread", [2, 4, 7])
def test_link(spread):
    fps = clustered(random.Random(spread), 1200, spread)
    a, b = S.link(np.array(fps, np.uint64))
    ends = dict(zip(a.tolist(), b.tolist(), strict=True))
    order = sorted(fps)
    roots = by_force(order)
    assert [ends.get(p, p) for p in order] == [order[r] for r in roots]


def test_components(spark):
    from veilspark.llm.components import components

    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)] + [(500, 500), (-5, -9)]
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fixture(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 16)
    monkeypatch.setattr(S, "OUTRIGHT", 8)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    texts += [None, "", " \n", "One", "one two", "ONE two\tthree", "one two three", "x " * 20_000, "\x1c a b"]
    docs = spark.createDataFrame([(1000 - i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.simhash_components(docs).collect()}
    order = sorted(got)
    fps = [plain(texts[1000 - i]) for i in order]
    assert [got[i][0] for i in order] == fps
    assert [got[i][1] for i in order] == [order[r] for r in by_force(fps)]
    assert S.simhash_components(docs.limit(0)).count() == 0
    assert S.simhash_components(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")).where("component_id = 1").count() == 3


@pytest.mark.parametrize("shard", [4, 40, 1 << 20])
def test_shards_of_any_size_give_the_same(spark, shard):
    """Crowded shards are parted in rounds, dense ones stay whole; components do not depend on it."""
    draw = random.Random(shard)
    fps = clustered(draw, 700, 5)
    rows = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    rows += [(1000 + k, rows[3][1]) for k in range(200)]
    got = {r.fp: r.component_id for r in S.near_components(spark.createDataFrame(rows, "doc_id long, fp long").repartition(5), 3, shard).collect()}
    roots = by_force(fps)
    least = {}
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, k), k)
    assert got == {f: least[r] for (_, f), r in zip(rows[: len(fps)], roots, strict=True)}
