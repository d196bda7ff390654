import re

import pytest

import corpus_pipeline as P
from tests.llm.test_shingles import roots, similar_pairs
from tests.llm.test_simhash import by_force
from tests.llm.test_simhash import plain as fingerprint
from tests.llm.test_suffix import plain as cut_repeats
from tests.llm.test_tokens import check_packed
from veilspark.llm import quality as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_fails(line):
    words, letters = WORD.findall(line), sum(c.isalpha() or __import__("unicodedata").category(c)[0] == "M" for c in line)
    seps, syms = sum(c in Q.SEPARATOR_CLASS[1:-1] for c in line), sum(c in Q.SYMBOL_CLASS[1:-1] for c in line)
    filled = sum(map(len, words))
    low = line.lower()
    return (
        (seps >= Q.SEPARATORS and len(words) <= Q.WORDS_PER_SEPARATOR * (seps + 1)) or 0 < len(words) <= Q.WORDS_PER_PHRASE * sum(low.count(p) for p in Q.BOILERPLATE)
        or 2 * letters < filled or (syms >= Q.LEAST_SYMBOLS and 100 * syms > Q.SYMBOL_PERCENT * len(words))
    )


def cleaned(text):
    """Text without failing lines; None if the document goes."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(set(windows)) < len(windows) else set()
    if len(words) < 10 or 100 * len(repeated) > 20 * len(words):
        return None
    lines = text.split("\n")
    kept = [x for x in lines if not (WORD.search(x) and line_fails(x))]
    chars = lambda xs: sum(len(w) for x in xs for w in WORD.findall(x))
    return None if 100 * (chars(lines) - chars(kept)) > 50 * chars(lines) else "\n".join(kept)


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in rows}
    long = max(texts.values(), key=len)
    more = {10_000: None, 10_001: "", 10_002: texts[0], 10_003: texts[0].replace(" ", "  "), 10_004: long + " " + long[:3000], 10_005: texts[0]}
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    extra = spark.createDataFrame([(i, t, "en", "s") for i, t in more.items()], docs.schema)
    from pyspark.sql import functions as F

    return docs.union(extra).withColumn("n_chars", F.length("text").cast("long"))


def test_stages_against_brute_force(spark, documents):
    docs, now = documents, {r.doc_id: r.text for r in documents.collect()}
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = P.stored(stage(spark, docs, SF))
        assert out.columns == docs.columns
        got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
        if k == 0:
            now = {i: c for i, t in now.items() if (c := cleaned(t)) is not None}
        elif k == 1:
            first = {}
            for i in sorted(now):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", now[i]), i)
            now = {i: now[i] for i in first.values()}
        elif k == 2:
            ids = sorted(now)
            by_print = list(enumerate(by_force([fingerprint(now[i]) for i in ids])))
            by_words = similar_pairs([now[i] for i in ids])
            assert any(dict(by_print)[i] != dict(by_print)[j] for i, j in by_words)  # some that fingerprints do not link
            now = {ids[i]: now[ids[i]] for i in sorted(set(roots(len(ids), [*by_print, *by_words])))}
        else:
            ids = sorted(now)
            now = {i: kept.decode("utf-8", "ignore") for i, (kept, _, _) in zip(ids, cut_repeats([now[i].encode() for i in ids], 200), strict=True)}
        assert got == {i: (t, len(t)) for i, t in now.items()}, name
        docs = out
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    check_packed(rows, 2048)
    assert {r.doc_id for r in rows} == set(now)


def test_run_and_empty(spark, documents):
    assert P.run(spark, SF).count() > 50
    docs = documents.limit(0)
    for _, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, SF))
    assert docs.count() == 0


def test_repeated_rows_and_null_ids_leave_one_whole_copy(spark):
    """Rows that repeat an identifier, or have none, must not meet their own copies in the substring stage."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    near = words(4) + " " + words(5) + " " + words(6)
    rows = [
        (7, words(0)), (7, words(0)), (7, words(0)),  # a replayed row
        (None, words(1)), (None, words(1)),  # null ids alone
        (None, words(2)), (9, words(2)), (9, words(2).replace(" ", "  ")), (8, words(2)),  # the smallest of all
        (11, words(3)), (11, words(7)),  # one id, two texts
        (None, near), (None, near.upper()),  # linked by fingerprints, unequal
        (13, words(8)), (13, words(8).upper()),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for stage in (P.exact, P.near, P.substrings):
        docs = P.stored(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted((r.doc_id or 0, r.text.lower()) for r in docs.collect())
    assert got == sorted([(7, words(0)), (0, words(1)), (8, words(2)), (11, words(3)), (11, words(7)), (0, near), (13, words(8))])


def test_clashing_names_and_a_very_long_text(spark):
    """Columns named as the stages name their own stay; a text of 30,000 lines goes through whole."""
    long = "\n".join(f"Entry number {k} gives result {k * k} and remainder {k * 31} for place p{k}." for k in range(30_000))
    rows = [(1, long, 1), (2, long.upper(), 2), (3, "A plain text of more than ten words that stays as it is here.", 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), k, k, k, k, k) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, __row int, KEPT_TEXT int, cleaned_text int, a int")
    for _, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "__row", "KEPT_TEXT", "cleaned_text", "a"]
    got = {r.doc_id: (r.text, r.n_chars, r.kept, r["__row"], r.KEPT_TEXT, r.cleaned_text, r.a) for r in docs.collect()}
    assert got == {i: (t, len(t), k, k, k, k, k) for i, t, k in (rows[0], rows[2])}
    pieces = P.STAGES[-1][1](spark, docs, SF).collect()
    check_packed(pieces, 2048)
    assert sum(r.length for r in pieces if r.doc_id == 1) > 400_000
