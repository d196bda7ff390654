"""Divergence of sources against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from veilspark.llm.divergence import _counted, _pieces, _shares, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=10):
    """Rows of the report for (text, lang, source)."""
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in langs.items():
        words = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, words=words):
            of = sum(c[t] for t in words) + 2 * len(words)
            return {t: 1 + 10**9 * (c[t] + 2) // of for t in words}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in words), o) for o in sources if o != s]
            found = [(-f(p[s][t], q[t]), t) for t in words if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", found)):
                items = sorted(items, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else top]
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(items, 1)}
    return out


def got(df):
    rows = df.collect()
    out = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed, n=400):
    draw = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["É", "É\x1cx", "日本", "a\x7fb", "A", "zz\nzz"]
    rows = []
    for _ in range(n):
        lang = draw.choice(["en", "en", "en", "de", None])
        source = draw.choice(["s0", "s0", "s0", *(f"s{k}" for k in range(12)), "é", "Z", "z", None, ""])
        rows.append((" ".join(draw.choices(words, [1 / (k + 1) for k in range(len(words))], k=draw.randrange(60))), lang, source))
    return [*rows, (None, "en", "only nulls"), (None, "fr", "x"), ("", "fr", "y"), ("rare words here", "fr", "z"), ("alone", "it", "one"), ("long " * 400_000 + "Ending", "en", "s1"), ("x" * 3_000_000, "en", "s2")]


def test_equals_brute_force_in_any_tiling(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "text string, lang string, source string, VALUE int").repartition(6)
    want = plain(rows)
    assert {("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "z", 0, 2)} <= want and len(want) > 500
    assert got(source_divergence(docs)) == want
    assert got(source_divergence(docs, block=3, chunk=16, slab=1)) == want
    assert got(source_divergence(docs, block=1, chunk=5, slab=4)) == want
    assert got(source_divergence(docs, least_docs=1, top=3, block=5, chunk=50)) == plain(rows, 1, 3)


def test_no_rows_and_repeated_rows(spark):
    docs = spark.createDataFrame([("same words", "en", s) for s in "ab" for _ in range(6)], "text string, lang string, source string")
    assert got(source_divergence(docs.limit(0))) == set()
    assert got(source_divergence(docs)) == plain([("same words", "en", s) for s in "ab" for _ in range(6)]) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_pieces_and_spilled_counts():
    text = ("Ab1cd " * 1000 + "É" * 50 + " tail").encode()
    assert b"".join(_pieces(text, 64)).split() == ["ab", "cd"] * 0 + [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]
    import pyarrow as pa

    texts = [f"t{chr(97 + k)} common".encode() for k in range(26)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 26), pa.array(["s"] * 26), pa.array(texts, pa.binary())], names=["lang", "source", "text"])
    sums = Counter()
    parts = list(_counted(iter([batch, batch]), 5))
    for p in parts:
        for term, n in zip(p.column(2).to_pylist(), p.column(3).to_pylist(), strict=True):
            sums[term] += n
    assert len(parts) > 1 and sums["common"] == 52 and sums["ta"] == 2 and sums[""] == 0


def test_shares_are_exact_for_large_counts():
    draw = random.Random(5)
    for _ in range(200):
        of = draw.randrange(2, 8 * 10**15)
        n = draw.randrange(0, of - 1)
        assert _shares(np.array([n]), of)[0] == 1 + 10**9 * (n + 2) // of
