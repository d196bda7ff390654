"""Links by shingles against brute force."""

import random
import re

import pyarrow as pa
import pytest

from veilspark.llm.components import components
from veilspark.llm.shingle_links import shingle_links, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def alike(x, y):
    return bool(x) and bool(y) and 5 * len(x & y) >= 4 * len(x | y)


def similar_pairs(texts):
    """Pairs (i, j) of a similarity of 0.8 or more; all of them."""
    sets = [shingles(t) for t in texts]
    return {(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])}


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def corpus():
    draw = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [None, "", " \n", "One two", "one TWO", "one two three", "é a b c d", "É a b c d"]
    passage = draw.choices(vocabulary, k=60)
    for _ in range(60):
        words = draw.choices(vocabulary, k=draw.randrange(5, 160))
        if draw.random() < 0.6:
            words[3:3] = passage  # a passage of most documents: no link by itself
        texts.append(" ".join(words))
        for _ in range(draw.choice([0, 1, 4])):  # chains of edits, so that links form paths
            words = list(words)
            for _ in range(draw.randrange(1, 6)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts.append(" ".join(words))
    base = draw.choices(vocabulary, k=200)
    for _ in range(120):  # a large group of near copies of which not all pairs are alike
        words = list(base)
        for _ in range(draw.randrange(0, 5)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("pairs_a_row", "rounds"), [(4, 8), (0, 2), (1000, 0)])
def test_components_are_those_of_all_pairs(spark, pairs_a_row, rounds):
    texts = corpus()
    want = similar_pairs(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(5)
    got = {tuple(sorted((r.a, r.b))) for r in shingle_links(docs, "k", "t", pairs_a_row=pairs_a_row, rounds=rounds).collect()}
    assert got <= want
    assert roots(len(texts), got) == roots(len(texts), want) and len(want) > 1000


def test_known_links_are_not_made_again(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h i j " + str(k % 2)) for k in range(6)], "k long, t string")
    known = spark.createDataFrame([(k, 0) for k in range(1, 6)], "a long, b long")
    assert shingle_links(docs, "k", "t", known).count() == 0
    assert shingle_links(docs.limit(0), "k", "t").count() == 0
    found = components(shingle_links(docs.where("k % 2 = 0"), "k", "t"))
    assert {(r.node, r.root) for r in found.collect()} == {(0, 0), (2, 0), (4, 0)}


def test_sets_of_hashes_have_the_sizes_of_sets_of_words():
    texts = corpus()
    sets = [set(s.tolist()) for s in shingle_sets(pa.array(texts, pa.string()))]
    want = [shingles(t) for t in texts]
    assert list(map(len, sets)) == list(map(len, want))
    assert all(len(sets[i] & sets[j]) == len(want[i] & want[j]) for i in range(0, len(texts), 7) for j in range(len(texts)))


def test_shared_keys_with_too_little_behind_them_make_no_pair(spark):
    from veilspark.llm.shingle_links import DEN, NUM, _across

    rows = [(1, 1, 10, 10, 1), (1, 2, 10, 8, 2), (2, 1, 10, 9, 1), (2, 2, 10, 7, 2)]  # 8 are left at most, 9 must be shared
    rows += [(3, 5, 10, 10, 5), (3, 6, 10, 9, 6), (4, 5, 10, 9, 5), (4, 6, 10, 8, 6)]  # 9 may be shared
    rows += [(5, 7, 90, 80, 7), (5, 8, 90, 85, 7), (5, 9, 72, 72, 9)]  # of a component of two, each document has its own place
    now = spark.createDataFrame(rows, "key long, id long, n int, rest int, root long")
    assert {(r.a, r.b, r.root, r.of) for r in _across(now, NUM, DEN).collect()} == {(5, 6, 5, 6), (7, 9, 7, 9), (8, 9, 7, 9)}
