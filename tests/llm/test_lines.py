"""Line dedup against brute force."""

import hashlib

from veilspark.llm.line_dedup import line_dedup, op13_line_dedup

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, chars=20, docs=3):
    """(number of lines, dropped, text) of each (id, text); ids that repeat are one document, those that are None another."""
    key = lambda x: x.strip(BLANK).translate(LOWER)
    split = [(t or "").split("\n") for _, t in rows]
    held = {}
    for (i, _), lines in zip(rows, split, strict=True):
        for x in lines:
            if len(key(x)) >= chars:
                held.setdefault(key(x), set()).add(-1 if i is None else i)
    common = {k: max(ids) for k, ids in held.items() if len(ids) >= docs}
    out = []
    for (i, _), lines in zip(rows, split, strict=True):
        kept = [x for x in lines if common.get(key(x), i if i is not None else -1) == (-1 if i is None else i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got(df, last="kept_text"):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "", r.n_lines, r.n_dropped, r[last]) for r in df.collect()))


def test_odd_rows(spark):
    a, b, c = "A line that is long enough", "ÉCOLE normale supérieure là", "twenty code points.."
    assert len(c) == 20
    rows = [
        (1, f"{a}\n{b}\nshort\n{a}"), (2, f"  {a.upper()}\t\r\n{c}"), (3, f"{a}\n{c}\n{a}"), (4, f"{c}\n"), (5, f"{c[:-1]}\n{b}"), (6, b.replace("É", "é")),
        (7, None), (8, ""), (9, "\n\n"), (2, f"  {a.upper()}\t\r\n{c}"), (2, f"{b}\nanother text of the same id"), (None, f"{a}\n{b}"), (None, f"{a}\n{b}"), (10, b + "\x0b"),
        (11, "\n".join([b, *(f"own line of the long text {k}" for k in range(30_000)), b])), (12, a + "\x1c"), (13, "　" + a),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted((-1 if i is None else i, t or "", *p) for (i, t), p in zip(rows, plain(rows), strict=True))
    assert got(line_dedup(docs)) == want
    assert sum(w[3] for w in want) > 8
    for chars, few in ((1, 2), (5, 4), (20, 1)):
        want = sorted((-1 if i is None else i, t or "", *p) for (i, t), p in zip(rows, plain(rows, chars, few), strict=True))
        assert got(line_dedup(docs, least_chars=chars, least_docs=few)) == want


def test_clashing_names_and_no_rows(spark):
    docs = spark.createDataFrame([(k, "one and the same long line\nand its own", k) for k in range(4)], "doc_id long, text string, KEPT_TEXT int").withColumnRenamed("text", "__lines")
    out = line_dedup(docs, text_col="__lines")
    assert out.columns == ["doc_id", "__lines", "KEPT_TEXT", "n_lines", "n_dropped", "kept_text_"]
    assert sorted((r.doc_id, r.n_dropped, r["kept_text_"]) for r in out.collect()) == [(k, 1, "and its own") for k in range(3)] + [(3, 0, "one and the same long line\nand its own")]
    assert line_dedup(docs.limit(0), text_col="__lines").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, d, t) in zip(rows, plain(rows), strict=True))
    assert sorted(map(tuple, op13_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want


def test_plan_has_no_python(spark):
    plan = op13_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
