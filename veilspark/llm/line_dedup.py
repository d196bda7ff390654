r"""Line dedup over documents, in DataFrame functions alone.

Lines are exploded with their place, normalised to a key (white space at both ends off,
A-Z lowered) and hashed to 128 bits. Distinct documents are counted a hash; a hash with
enough of them hands its largest document back, and its lines go in every other one.
Places of such lines come back to their documents, which are put together again from
what lies between them. Texts move once, to meet those places; all else that moves are
hashes. Two keys share a hash by chance once among some 10^19 distinct lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents, free_name, stored, whole_text

#: Code points that a key has at least, and documents that have to hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3

#: White space that is stripped from lines: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lowered(text: Column) -> Column:
    """A-Z lowered, nothing else: where every character is one byte, lower() does just that."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return _lowered(F.btrim(line, F.lit(BLANKS)))


def _without(lines: Column, gone: Column) -> Column:
    """Lines without those at the ascending places `gone`: the slices between them, in order."""
    n = F.size(lines)
    return F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(n)), lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    r"""docs with n_lines (before), n_dropped and kept_text.

    Lines end at \n alone. A key of at least least_chars code points that at least
    least_docs documents hold loses all its lines but those in the largest identifier
    that holds it, where all of them stay. Documents are identifiers: rows that repeat
    one count once and keep or lose the same lines; rows without one are together one
    document, smaller than any other. Null and empty texts are one empty line, which is
    too short to go. Texts are taken whole however long; an empty table gives an empty
    table; added columns take underscores if docs has their names.
    """
    names = {c: free_name(docs, c) for c in ("n_lines", "n_dropped", "kept_text")}
    whole, own_row, met_id, met_row, lost, lines = (free_name(docs, n) for n in ("__whole", "__own", "__id", "__row", "__lost", "__lines"))
    ident, text = F.col(id_col).cast("long"), whole_text(text_col)
    # Which row a place belongs to: rows of one identifier may have different texts.
    row = F.xxhash64(text)
    each = docs.select(ident.alias("id"), row.alias("row"), F.posexplode(F.split(text, "\n")).alias("place", "line")).where(F.length("line") >= least_chars)
    each = each.select("id", "row", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    each = stored(each.select("id", "row", "place", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")))

    held = each.groupBy("h", "g").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"), F.max(F.col("id").isNull().cast("int")).alias("nameless"))
    # Stored, so that both sides of the join are plain exchanges: a line that a third of all rows have is then dealt over tasks by Spark (adaptive execution, on by default).
    common = stored(held.where(F.col("n") + F.col("nameless") >= least_docs).select("h", "g", "last"))
    gone = each.join(common.hint("shuffle_hash"), ["h", "g"]).where(~F.col("id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("id").alias(met_id), F.col("row").alias(met_row)).agg(F.sort_array(F.collect_set("place")).alias(lost))
    met = docs.withColumns({whole: text, own_row: row}).join(gone.hint("shuffle_hash"), ident.eqNullSafe(F.col(met_id)) & (F.col(own_row) == F.col(met_row)), "left")
    met = met.withColumns({lost: F.coalesce(lost, F.array().cast("array<int>")), lines: F.split(F.col(whole), "\n")})
    kept = F.when(F.size(lost) == 0, F.col(whole)).otherwise(F.array_join(_without(F.col(lines), F.col(lost)), "\n"))
    return met.select(*docs.columns, F.size(lines).cast("long").alias(names["n_lines"]), F.size(lost).cast("long").alias(names["n_dropped"]), kept.alias(names["kept_text"]))


def op13_line_dedup(spark, sf_dir) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT k.rid, k.i, k.line, c.last IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c USING (key)),
s AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN s USING (rid)
"""
