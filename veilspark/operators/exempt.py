"""Values that a table exempts, however many they are: joined, not carried along.

Lines are scanned once as if nothing were exempt. The distinct values found meet the
table; those in it come back to the lines that have them, and these lines alone are
scanned again, each with its own few exempt values. An exempt value takes its span all
the same, so the result is that of a list given to the scan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .redact import RESULT, Once, Scanner, Settings, _column, once, redacted


def _again(settings: Settings):
    """Struct (output, is_json, matches) of (line, its exempt values); a null line has none."""
    scanner = Once(Scanner, settings)

    @F.arrow_udf(RESULT)
    def run(lines: pa.Array, exempt: pa.Array) -> pa.Array:
        one, rows = scanner(), []
        always = one.allowed
        try:
            for line, values in zip(lines.to_pylist(), exempt.to_pylist(), strict=True):
                own = frozenset(values or ())
                one.allowed = lambda rule, value, own=own: value in own or always(rule, value)
                rows.append((None, False, []) if line is None else one.line(line))
        finally:
            one.allowed = always
        return _column(rows)

    return run


def redact_except(df: DataFrame, column: str, settings: Settings, exempt: DataFrame, value: str = "value", into: str = "redacted") -> DataFrame:
    """df with a struct (output, is_json, matches) of its column, without what the table's values exempt.

    Null values of the table say nothing, repeated ones as much as one. The rows of df are
    kept in the shared folder with what they become.
    """
    row = "__row"
    while row in df.columns:
        row += "_"
    first = cut(once(df.withColumn(row, F.monotonically_increasing_id()), redacted(F.col(column), settings), into))
    found = first.select(row, F.explode(F.array_distinct(F.transform(f"{into}.matches", lambda m: m["original"]))).alias("__original"))
    # Distinct values first: of one that very many lines have, each task sends one row to the table.
    named = cut(found.select("__original").distinct().join(exempt.select(F.col(value).alias("__original")).where(F.col(value).isNotNull()).distinct(), "__original", "left_semi"))
    of_row = found.join(named, "__original").groupBy(F.col(row).alias("__of")).agg(F.collect_list("__original").alias("__exempt"))
    met = first.join(of_row, F.col(row) == F.col("__of"), "left")
    text = F.when(F.col("__exempt").isNotNull(), F.make_valid_utf8(column))
    met = once(met, _again(settings)(text, F.col("__exempt")), "__again")
    return met.withColumn(into, F.when(F.col("__exempt").isNotNull(), F.col("__again")).otherwise(F.col(into))).drop(row, "__of", "__exempt", "__again")
