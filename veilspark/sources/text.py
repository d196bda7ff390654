"""Text in and out: files of lines, columns of text, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source, block, row, line): lines end at \\n alone, \\r stays; bytes that are no UTF-8 become U+FFFD. Splits are aligned to lines by Spark.

    The order of (source, block, row) is that of the lines in their files.
    """
    rows = spark.read.text(path, lineSep="\n")
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.make_valid_utf8("value").alias("line"))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.make_valid_utf8("value").alias("line"))


def lines_of(text: Column) -> Column:
    """Array of the lines of a text; one that ends in \\n has no empty last line, an empty text has none."""
    parts = F.split(text, "\n")
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(df: DataFrame, text: str = "text", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """A row a line, numbered from 0, with the other columns of df."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(lines_of(F.col(text))).alias(line_no, line))


def rejoin_lines(df: DataFrame, by: list[str], line_no: str = "line_no", line: str = "line", text: str = "text") -> DataFrame:
    """A text a group, of its lines in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(line_no, line))), lambda r: r[line])
    return df.groupBy(*by).agg(F.array_join(rows, "\n").alias(text))


def write_lines(df: DataFrame, path: str, line: str = "line", mode: str = "overwrite") -> None:
    df.select(F.col(line).alias("value")).write.mode(mode).text(path, lineSep="\n")


def discard(df: DataFrame) -> None:
    """Runs df and keeps nothing: for a report alone."""
    df.write.format("noop").mode("overwrite").save()
