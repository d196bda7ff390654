"""Odd tables for the quality rules and the byte-level encoder: clashing names, repeated rows, very long texts, nulls, no rows."""

from pyspark.sql import functions as F

from veilspark.llm.byte_bpe import encoded
from veilspark.llm.quality import line_fails, quality_rules


def test_odd_tables(spark):
    prose = "Ordinary words follow each other here in one plain line of text number"
    long = "\n".join(f"{prose} {k} and {k * k} more {k + 7} things {k * 31}." for k in range(4000))
    rows = [(1, None, 5), (2, "", 5), (3, prose, 5), (3, prose, 5), (None, prose, 5), (4, long, 5), (5, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT int").repartition(3)
    out = quality_rules(docs)
    assert out.columns[:3] == ["doc_id", "text", "KEPT"] and "kept_" in out.columns
    got = sorted(((r.doc_id or 0, r.n_words, r["kept_"], r.base_failed) for r in out.collect()))
    n = len(long.split())
    assert got == [(0, 13, True, False), (1, 0, False, True), (2, 0, False, True), (3, 13, True, False), (3, 13, True, False), (4, n, False, True), (5, 2, False, True)]
    assert quality_rules(docs.limit(0)).count() == 0


def test_boilerplate_of_four_languages(spark):
    lines = ["© 2020 Firma, alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados", "All rights reserved.", "Click here. Click here. " + "more words " * 10, "Ein Satz über das Recht", "Une phrase sur le droit", "Una frase sobre el derecho", "Whoever wants to know how the tool is powered by the wind may click here, and in running prose of this length, which goes on for quite some more words than a notice would, neither is boilerplate"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").withColumn("bad", line_fails(F.col("line")))
    assert [r.bad for r in df.orderBy("i").collect()] == [True] * 5 + [False] * 4


def test_encoder_takes_clashing_names_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "ab", 0), (1, "ab", 0), (None, None, 1)], "doc_id long, text string, IDS int")
    got = sorted(((r.doc_id or 0, bytes(r.decoded), r["ids_"] == []) for r in encoded(docs).collect()))
    assert got == [(0, b"", True), (1, b"ab", False), (1, b"ab", False)]
