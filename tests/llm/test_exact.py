import hashlib
import random
import re

import pytest

from veilspark.llm.exact_dedup import Patricia, exact_dedup

WS = re.compile(r"[\x20\x09-\x0D]+")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WS.sub(" ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        norm = WS.sub(" ", t or "")
        ids = groups[norm]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def taken(df):
    return sorted(((r.doc_id, r["keep_id_"], r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("trie_bytes", [12 << 20, 3000, 1])
def test_drawn_tables(spark, trie_bytes):
    """Nulls, empty and white texts, repeated rows and ids, one huge group, long shared prefixes, a clashing name; tries of any size."""
    draw = random.Random(trie_bytes)
    head = "the same long beginning " * 40
    texts = [None, "", " ", "\n\t ", "a", "a b", "a  b", "a\nb", "é", "日本 語", "x" * 50_000] + [head + str(k) for k in range(30)] + [head[:k] for k in range(0, 200, 7)]
    rows = [(k, draw.choice(texts)) for k in range(300)] + [(1000 + k, "copies of one  text") for k in range(200)]
    rows += [(None, "a"), (None, "only null"), (None, "only null"), (5, "twice"), (5, "twice"), (-7, "copies of one text")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, KEEP_id string").repartition(6)
    assert taken(exact_dedup(docs, trie_bytes=trie_bytes)) == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = exact_dedup(docs)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "text_sha256", "keep_id", "group_size", "kept"]


def held(trie):
    total, stack = 0, list(trie.root[1].values())
    while stack:
        node = stack.pop()
        total += len(node[0]) + 200
        stack.extend(node[1].values())
    return total


def test_spills_by_subtree_keep_count_of_bytes():
    draw = random.Random(2)
    trie, given, got = Patricia(), {}, {}
    prefix = b"p" * 1500
    for k in range(800):
        key = draw.choice([prefix, b"", b"q"]) + bytes(draw.choice(b"abc") for _ in range(draw.randrange(40)))
        given.setdefault(key, []).append(k)
        trie.insert(key, k, 1)
        assert trie.size == held(trie)
        if trie.size > 9000:
            for text, least, n, _ in trie.spill(4000, key):
                assert text != key
                got.setdefault(text, []).append((least, n))
            assert trie.size == held(trie)
            assert any(text == key for text, *_ in trie.items())
    for text, least, n, _ in trie.items():
        got.setdefault(text, []).append((least, n))
    assert {k: (min(a for a, _ in v), sum(n for _, n in v)) for k, v in got.items()} == {k: (min(v), len(v)) for k, v in given.items()}


def test_an_owner_holds_one_trie_of_all_its_strings():
    """Strings of a partition share their prefixes in one trie: far fewer bytes than the strings have."""
    trie = Patricia()
    for k in range(500):
        trie.insert(b"shared beginning " * 60 + str(k).encode(), k, 1)
    assert trie.size < 500 * 500
