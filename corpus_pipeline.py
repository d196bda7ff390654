"""A training corpus from raw documents: quality rules, exact, near and substring dedup, packing.

Each stage reads what the one before has written and decides on all of it. Stages but
the last return the columns of `documents`; the last one the packed pieces. In every
stage a null text counts as empty, texts are taken whole however long, an empty table
gives an empty one, and further columns of the table are kept as they are; names that a
stage adds for itself give way to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm._common import documents, free_name, stored
from veilspark.llm.components import components
from veilspark.llm.exact_dedup import exact_dedup
from veilspark.llm.packing import pack
from veilspark.llm.quality import quality_rules
from veilspark.llm.shingle_links import shingle_links
from veilspark.llm.simhash import simhash_components
from veilspark.llm.suffix_dedup import suffix_dedup_text
from veilspark.shipping import ship


def _with_text(docs: DataFrame, new: str, columns: list[str]) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return docs.select(*(F.col(new).alias("text") if c == "text" else F.length(new).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail. Null and empty texts do not pass; repeated rows are judged each for itself."""
    ship(spark)
    kept, cleaned = free_name(docs, "kept"), free_name(docs, "cleaned_text")
    # A number of the row holds the filter above the rules: moved below, it would copy all their expressions.
    row = free_name(docs, "__row")
    judged = quality_rules(docs).withColumn(row, F.monotonically_increasing_id())
    return _with_text(judged.where(F.col(kept) & (F.col(row) >= 0)), cleaned, docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table with a number for each row, and its column: identifiers may be null or repeat."""
    row = free_name(docs, "__row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id())), row


def _first_rows(numbered: DataFrame, row: str, groups: DataFrame, columns: list[str]) -> DataFrame:
    """Of each group (rows group_of, doc_id, row), the one row with the smallest doc_id; nulls are larger, ties go to the first row."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    stay = groups.groupBy("group_of").agg(F.min(place).alias("first")).select(F.col("first.row").alias("stays"))
    return numbered.join(stay, F.col(row) == F.col("stays"), "left_semi").select(*columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the smallest doc_id; null ones are larger, and of ties any one row stays."""
    ship(spark)
    numbered, row = _numbered(docs)
    found = exact_dedup(numbered.select(row, "doc_id", "text")).where("kept")
    return _first_rows(numbered, row, found.select(F.col("text_sha256").alias("group_of"), "doc_id", row), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, one row: that with the smallest doc_id; nulls and ties as in exact().

    Links are fingerprints within three bits (texts without words are linked by theirs)
    and sets of five-word shingles of a Jaccard similarity of 0.8 or more, all of them.
    """
    ship(spark)
    numbered, row = _numbered(docs)
    by_print = stored(simhash_components(numbered, id_col=row)).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    linked = components(by_print.union(shingle_links(numbered, row, "text", by_print))).select(F.col("node").alias("k"), F.col("root").alias("group_of"))
    found = numbered.select(row, "doc_id").join(linked, F.col(row) == F.col("k"), "left").withColumn("group_of", F.coalesce("group_of", row))
    return _first_rows(numbered, row, found.select("group_of", "doc_id", row), docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated passages; what a cut leaves of a character goes too. Documents that lose all their text stay, empty."""
    ship(spark)
    return _with_text(suffix_dedup_text(docs), free_name(docs, "kept_text"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences; rows that repeat a doc_id, or have none, are packed each for itself."""
    ship(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("suffix-array dedup", substrings),
    ("best-fit packing", packing),
]

#: Fingerprints, suffixes and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
