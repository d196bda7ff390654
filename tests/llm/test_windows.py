import random

import pytest

from veilspark.llm.window_dedup import levels, window_dedup


def plain(rows, window):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_levels():
    assert levels(13) == [7, 13]
    assert levels(50) == [7, 13, 25, 50]
    assert levels(5) == [5]


@pytest.mark.parametrize("window,shortest", [(13, 7), (13, 3), (24, 4), (5, 7), (3, 1)])
def test_drawn_texts(spark, window, shortest):
    draw = random.Random(window)
    passages = [[draw.choice("abcdefg") * draw.randrange(1, 3) for _ in range(draw.randrange(5, 70))] for _ in range(8)]
    texts = [None, "", " \n", "a b c", "x " * 400, "x " * 90, "y z " * 60]
    for _ in range(90):
        out = []
        for p in draw.sample(passages, draw.randrange(4)):
            a = draw.randrange(len(p))
            out += [str(draw.randrange(10**6)) for _ in range(draw.randrange(20))] + p[a : a + draw.randrange(60)]
        texts.append(draw.choice([" ", "\n", "\t "]).join(out))
    texts += draw.sample(texts, 15)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int").repartition(6)
    got = {r.doc_id: (r.n_words_, r.n_removed, r.kept_text) for r in window_dedup(docs, window=window, shortest=shortest).collect()}
    want = plain(rows, window)
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 300


def test_odd_tables(spark):
    text = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in window_dedup(docs).collect()) == [(0, 20), (5, 0), (5, 0)]
    assert window_dedup(docs.limit(0)).count() == 0


def test_levels_of_the_query():
    from veilspark.llm.window_dedup import SHORTEST, WINDOW

    assert levels(WINDOW, SHORTEST) == [4, 7, 13]


@pytest.mark.parametrize("range_bytes", [200, 1 << 30])
def test_any_number_of_ranges_gives_the_same(spark, range_bytes):
    draw = random.Random(11)
    shared = [" ".join(draw.choice("abcdefghij") + draw.choice("klmn") for _ in range(40)) for _ in range(5)]
    rows = [(i - 20, " ".join([str(i), draw.choice(shared), str(-i), draw.choice(shared)])) for i in range(60)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in window_dedup(docs, range_bytes=range_bytes).collect()}
    assert got == plain(rows, 13)


def test_hashes_that_are_alike_in_the_first_half(spark, monkeypatch):
    """The further bits of hash decide where 64 are not enough."""
    from veilspark.llm import window_dedup as D

    joined = D.Words.windows
    monkeypatch.setattr(D.Words, "windows", lambda self, length, half=0: joined(self, length, half) & D.np.uint64(0xF00000000000000F) if not half else joined(self, length, half))
    draw = random.Random(5)
    texts = [" ".join(str(draw.randrange(30)) for _ in range(40)) for _ in range(12)]
    texts += [texts[0], texts[1] + " more"]
    words = [D.Words(D.pa.array([t]), D.np.array([i]), 13) for i, t in enumerate(texts)]
    sent = [D.Doubling(w, [13], 1).sent(0, None)[0].rows(i, 1) for i, w in enumerate(words)]
    told = D._answer(0, True)(D.pa.concat_tables(sent))
    hit = {c: any(b) for c, b in zip(told.column("chunk").to_pylist(), told.column("bits").to_pylist(), strict=True)}
    assert [c for c, b in sorted(hit.items()) if b] == [12, 13]
