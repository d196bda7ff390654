"""Queries over JSON lines made of keys, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from .queries import KEY, _token, table
from .sanitizer import Sanitizer

#: Characters of context.
CONTEXT = 9

#: A line in parts: plain ones, and keys as texts in between. It has keys with parents, an array, escapes, an integer beyond a double's, and values inside texts.
PARTS = (
    '{"id": 90071992547409', "two", ', "user":{"name":"u\\"', "name", '\\u00e9"}, "tags" : ["10.', "byte", '.0.1", null], "lat":', "degree", '.25, "max_tokens":', "byte",
    ', "note":"a\\tb\\\\ from 10.0.', "host", '.7 \\ud83d\\ude00", "source":{"address":"192.168.', "byte", '.9", "name":"-"}}',
)
KEYS = {"two": "o_orderkey % 90 + 10", "name": "o_orderkey % 97", "byte": "o_orderkey % 256", "degree": "o_orderkey % 90 + 1", "host": "o_orderkey % 250 + 1"}


def _matches(spark, sf_dir):
    line = F.concat(*(F.expr(KEYS[p]).cast("string") if p in KEYS else F.lit(p) for p in PARTS))
    made = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return Sanitizer(KEY, rules=["users", "ips", "geoLocation"], context_chars=CONTEXT).transform(made)


def json_matches(spark, sf_dir):
    """What keys of JSON lines ask for, and values inside their texts: tokens, places in the line, contexts."""
    rows = _matches(spark, sf_dir).select("o_orderkey", F.explode("redacted.matches").alias("m")).select("o_orderkey", "m.*")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("index", "length", "seq")})


def json_outputs(spark, sf_dir):
    """JSON lines after redaction, and what previews mark in them."""
    rows = R.highlighted(_matches(spark, sf_dir).select("o_orderkey", "line", "redacted"))
    marked = lambda c: F.array_join(F.transform(F.filter(c, lambda x: x["changed"]), lambda x: x["text"]), "|")
    return rows.select("o_orderkey", F.col("redacted.output").alias("output"), marked("before_segments").alias("marked"), marked("after_segments").alias("marked_after"))


QUERIES = {f.__name__: f for f in (json_matches, json_outputs)}

# ---------------------------------------------------------------- SQL


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _before(k: int) -> str:
    """The line up to part k."""
    return " || ".join(f"({KEYS[p]})::VARCHAR" if p in KEYS else _literal(p) for p in PARTS[:k]) or "''"


_MADE = ", ".join(f"({e})::VARCHAR AS {n}" for n, e in KEYS.items())

#: (part of the line that the value begins in, characters of that part ahead of it, value as it stands, value, rule, prefix).
_FOUND = (
    (2, len(', "user":{"name":"'), "'u\\\"' || name || '\\u00e9'", "'u\"' || name || 'é'", "users", "USER"),
    (4, len('\\u00e9"}, "tags" : ["'), "'10.' || byte || '.0.1'", None, "ips", "IP"),
    (7, 0, "degree || '.25'", None, "geoLocation", "GEO"),
    (10, len(', "note":"a\\tb\\\\ from '), "'10.0.' || host || '.7'", None, "ips", "IP"),
    (12, len('.7 \\ud83d\\ude00", "source":{"address":"'), "'192.168.' || byte || '.9'", None, "ips", "IP"),
)
_ROWS = " UNION ALL ".join(
    f"SELECT o_orderkey, {k} AS place, {_literal(rule)} AS rule_id, {value or raw} AS original, {_token(rule, prefix, value or raw)} AS replacement, (length({_before(part)}) + {ahead})::BIGINT AS index, length({raw})::BIGINT AS length, line, {raw} AS raw FROM l"
    for k, (part, ahead, raw, value, rule, prefix) in enumerate(_FOUND)
)
_WITH = f"WITH l AS (SELECT *, {_before(len(PARTS))} AS line FROM (SELECT o_orderkey, {_MADE} FROM orders)), m AS ({_ROWS})"

ORACLES = {
    "json_matches": f"""{_WITH}
SELECT o_orderkey, rule_id, original, replacement, index, length, row_number() OVER (PARTITION BY o_orderkey ORDER BY index) - 1 AS seq,
       substr(line, (index - {CONTEXT} + 1)::INT, {CONTEXT}) AS context_before, substr(line, (index + length + 1)::INT, {CONTEXT}) AS context_after FROM m""",
    "json_outputs": f"""{_WITH},
t AS (SELECT o_orderkey, any_value(line) AS line, string_agg(raw, '|' ORDER BY place) AS marked, string_agg(replacement, '|' ORDER BY place) AS marked_after, list(replacement ORDER BY place) AS r FROM m GROUP BY o_orderkey)
SELECT o_orderkey, '{{"id":90071992547409' || two || ',"user":{{"name":"' || r[1] || '"}},"tags":["' || r[2] || '",null],"lat":"' || r[3] || '","max_tokens":' || byte || ',"note":"a\\tb\\\\ from ' || r[4] || ' 😀","source":{{"address":"' || r[5] || '","name":"-"}}}}' AS output, marked, marked_after
FROM t JOIN l USING (o_orderkey)""",
}
