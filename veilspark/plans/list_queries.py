"""Queries with large lists of values, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..sources.text import explode_lines
from .queries import _IPS, KEY, _token, table
from .sanitizer import Sanitizer

#: Values of the list: so many names of customers, and a shorter value that begins all of them.
NAMES, SHORT = 100_000, "Customer#"


def always_list(spark, sf_dir):
    """Lines with customers' names, by a list of 100,000 of them: the longest value at a place counts, what follows it stays."""
    line = F.concat(F.lit("for "), F.col("c_name"), F.lit("7, not Customer_"), F.col("c_name"), F.lit("."))
    values = [SHORT, *(f"{SHORT}{k:09d}" for k in range(NAMES))]
    s = Sanitizer(KEY, rules=[], always_values=values, json=False)
    made = table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    return s.transform(made).select("c_custkey", F.col("redacted.output").alias("output"), F.size("redacted.matches").cast("long").alias("n"))


def exempt_addresses(spark, sf_dir):
    """Addresses that are left when those of documents with even numbers are exempt, by a table of a column of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = explode_lines(docs, "text")
    s = Sanitizer(KEY, rules=["ips"])
    known = R.matches_of(s.transform(lines.where("doc_id % 2 = 0")), ["doc_id", "line_no"]).select(F.col("original").alias("address"))
    found = R.matches_of(s.transform_except(lines, known, value="address"), ["doc_id", "line_no"])
    return found.groupBy("original", "replacement").agg(F.count("*").alias("n"))


QUERIES = {"always_list": always_list, "exempt_addresses": exempt_addresses}

_FOUND = f"CASE WHEN c_custkey < {NAMES} THEN {_token('custom', 'CUSTOM', 'c_name')} ELSE {_token('custom', 'CUSTOM', repr(SHORT))} || c_name[{len(SHORT) + 1}:] END"
ORACLES = {
    "always_list": f"SELECT c_custkey, 'for ' || {_FOUND} || '7, not Customer_' || {_FOUND} || '.' AS output, 2::BIGINT AS n FROM customer",
    "exempt_addresses": f"{_IPS} SELECT ip AS original, {_token('ips', 'IP', 'ip')} AS replacement, count(*) AS n FROM m WHERE ip NOT IN (SELECT ip FROM m WHERE doc_id % 2 = 0) GROUP BY ip",
}
