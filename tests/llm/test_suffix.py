import random

import numpy as np
import pytest

from veilspark.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    """(kept, removed, runs) of each text, by a table of all windows."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((kept, sum(gone), len([x for x in bytes(gone).split(b"\0") if x])))
    return out


def drawn(draw, n):
    passages = ["".join(draw.choice("abcd é") for _ in range(draw.randrange(10, 200))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(60))) for _ in range(draw.randrange(4))]
        for p in draw.sample(passages, draw.randrange(3)):
            a = draw.randrange(len(p))
            parts.insert(draw.randrange(len(parts) + 1), p[a : a + draw.randrange(200)])
        texts.append("".join(parts))
    return texts + draw.sample(texts, n // 6)


@pytest.mark.parametrize("length,rows", [(24, 1 << 16), (24, 3), (41, 5), (7, 4)])
def test_drawn_texts(spark, length, rows):
    draw = random.Random(length * rows)
    texts = [*drawn(draw, 60), None, "", "a", "x" * 500, "xy" * 300, "\0" * 90, "é" * 100]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(5)
    got = {r.doc_id: (bytes(r.kept_bytes), r.n_removed, r.n_spans) for r in S.suffix_dedup(docs, length=length, bucket_rows=rows).collect()}
    want = plain([(t or "").encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(n for _, n, _ in want) > 500


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    got = {r.doc_id: (bytes(r.kept_bytes), r.n_removed, r.n_spans, r.n_bytes) for r in S.suffix_dedup(docs).collect()}
    want = plain([t.encode() for t in texts], 200)
    assert [got[i][:3] for i in range(len(texts))] == want
    assert S.suffix_dedup(docs.limit(0)).count() == 0


def test_multikey_sort():
    draw = np.random.default_rng(4)
    for n in (1, 2, 500):
        strings = [bytes(draw.integers(97, 99, draw.integers(0, 40)).astype(np.uint8)) for _ in range(n)]
        side = S.SortedSide(strings)
        assert [strings[i] for i in side.order] == sorted(strings)
        for depth in (1, 5, 9):
            classes = side.classes(depth)
            long = [i for i in range(n) if len(strings[i]) >= depth]
            assert len({(int(classes[i]), strings[i][:depth]) for i in long}) == len({int(classes[i]) for i in long}) == len({strings[i][:depth] for i in long})


def test_buckets_that_end_among_equal_windows():
    """Without the comparison of neighbours a window alone at each side of a cut is lost."""
    import pyarrow as pa

    window = lambda c: c.encode() * 24
    table = lambda rows: [pa.record_batch({"window": pa.array([window(w) for w, _, _ in rows], pa.binary()), "chunk": pa.array([c for _, c, _ in rows]), "places": pa.array([p for _, _, p in rows], pa.list_(pa.int64()))})]
    one = next(S.sorted_windows(table([("b", 1, [5]), ("a", 1, [0, 9]), ("c", 1, [7])]), 24)).to_pylist()
    two = next(S.sorted_windows(table([("c", 2, [3]), ("d", 2, [1])]), 24)).to_pylist()
    assert sorted((r["chunk"], r["start"]) for r in one + two if r["edge"] is None) == [(1, 0), (1, 9)]
    assert sorted((r["chunk"], r["start"], r["edge"][:1], r["n"]) for r in one + two if r["edge"] and r["n"] == 1) == [(1, 7, b"c", 1), (2, 1, b"d", 1), (2, 3, b"c", 1)]


def test_cuts_among_copies(spark):
    """A passage that many documents share, each of its windows once a chunk, in buckets of two rows."""
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(90))
    texts = ["".join(draw.choice("ijklmnop ") for _ in range(40)) + passage + str(i) for i in range(40)] + [passage[:30], "q" * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
    want = plain([t.encode() for t in texts], 24)
    for rows in (2, 7, 1 << 16):
        got = {r.doc_id: (bytes(r.kept_bytes), r.n_removed, r.n_spans) for r in S.suffix_dedup(docs, length=24, bucket_rows=rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_multikey_sort_of_large_and_equal_rows():
    draw = np.random.default_rng(8)
    words = draw.integers(0, 3, (3000, 4)).astype(np.uint64)
    words[:500] = 1
    sizes = draw.integers(0, 4, 3000)
    order = S.multikey_sort(words, sizes)
    rows = [(*words[i].tolist(), int(sizes[i])) for i in order]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(3000))
