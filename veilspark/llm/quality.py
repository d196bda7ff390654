r"""Quality rules, line first, in DataFrame functions alone.

Each line is judged by itself: punctuation, navigation, boilerplate. Lines that fail are
removed; a document that loses too much of its text is rejected, as is one that fails
the base rules (too few words, or too many words in repeated five-word windows).

Repeated windows are found within a row: hashes of windows by three pairwise
combinations of the array of word hashes; only a document whose hashes are not all
distinct has them sorted with their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS, documents, free_name, whole_text

MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20

#: A line is navigation if it has at least so many separators and at most so many words for each.
SEPARATORS, WORDS_PER_SEPARATOR = 3, 3

#: A line that has phrases of boilerplate fails if it has at most so many words for each: in longer ones they are prose.
WORDS_PER_PHRASE = 15

#: A document is rejected if it loses more than this percentage of the characters in its words.
LOST_PERCENT = 50

#: Characters that part the entries of a menu.
SEPARATOR_CLASS = "[|»›·•>]"

#: Phrases of boilerplate lines in English, French, German and Spanish, in lower case. Their first letters are few.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "uses cookies",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "click here",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "powered by",
    "copyright ©",
    "copyright (c)",
    "skip to content",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions générales",
    "cliquez ici",
    "utilise des cookies",
    "activer javascript",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "unsere datenschutzerklärung",
    "cookies akzeptieren",
    "javascript aktivieren",
    "todos los derechos reservados",
    "política de privacidad",
    "términos y condiciones",
    "aviso legal",
    "utiliza cookies",
    "clic aquí",
)

#: Punctuation that counts as symbols in the base columns and in lines.
SYMBOL_CLASS = "[#*$%&|<>]"

#: A line fails with at least so many symbols if they are more than this percentage of its words.
LEAST_SYMBOLS, SYMBOL_PERCENT = 3, 50

#: The class of first letters spares most places the choice.
FIRST_LETTERS = "(?=[" + "".join(sorted({p[0] for p in BOILERPLATE})) + "])"

BOILERPLATE_PATTERN = "(" + "|".join(p.replace("(", "[(]").replace(")", "[)]") for p in BOILERPLATE) + ")"

PHRASES = FIRST_LETTERS + BOILERPLATE_PATTERN

#: Runs of letters with their marks, and characters that are not white space: a line with fewer letters than other such characters is punctuation.
LETTERS, FILLED = r"[a-zA-Z\p{L}\p{M}]+", r"[^\x20\x09-\x0D]"


def _words_of(text: Column) -> Column:
    """Text with each run of white space as one space and none at the ends."""
    return F.btrim(F.regexp_replace(text, WS, " "), F.lit(" "))


def line_fails(line: Column) -> Column:
    """The verdict on one line with a word."""
    words = _words_of(line)
    n = F.length(words) - F.length(F.translate(words, " ", "")) + 1
    separators = F.regexp_count(line, F.lit(SEPARATOR_CLASS))
    navigation = (separators >= SEPARATORS) & (n <= WORDS_PER_SEPARATOR * (separators + 1))
    low = F.lower(line)
    boilerplate = low.rlike(PHRASES) & (n <= WORDS_PER_PHRASE * F.regexp_count(low, F.lit(PHRASES)))
    letters, filled = F.length(line) - F.length(F.regexp_replace(line, LETTERS, "")), F.length(F.regexp_replace(line, WS, ""))
    punctuation = 2 * letters < filled
    symbols = F.regexp_count(line, F.lit(SYMBOL_CLASS))
    noisy = (symbols >= LEAST_SYMBOLS) & (100 * symbols > SYMBOL_PERCENT * n)
    return navigation | boilerplate | punctuation | noisy


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed and cleaned_text.

    Null and empty texts have no words, fail the base rules and are not kept. White space
    is space and U+0009 to U+000D; other spaces are characters of words. Lines end at \\n
    alone. Rows stay as they are, repeated ones too; texts of any length are judged whole;
    an empty table stays empty; clashing names take underscores.
    """
    names = {c: free_name(docs, c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "cleaned_text")}
    t = {c: free_name(docs, f"__{c}") for c in ("text", "norm", "hashes", "two", "four", "win", "lines", "bad", "pos")}
    zero = F.lit(0).cast("long")

    df = docs.withColumn(t["text"], whole_text(text_col))
    df = df.withColumn(t["norm"], _words_of(F.col(t["text"])))
    norm = F.col(t["norm"])
    df = df.withColumn(t["hashes"], F.when(norm == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))))
    h = F.col(t["hashes"])
    n = F.size(h)
    df = df.withColumn(t["two"], F.zip_with(h, F.slice(h, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    two = F.col(t["two"])
    df = df.withColumn(t["four"], F.zip_with(two, F.slice(two, 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    four = F.slice(F.col(t["four"]), 1, F.greatest(n - 4, F.lit(0)))
    df = df.withColumn(t["win"], F.zip_with(four, F.slice(h, 5, F.greatest(n - 4, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    win = F.col(t["win"])
    placed = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(t["pos"], F.when(F.size(F.array_distinct(win)) < F.size(win), placed))
    pos = F.col(t["pos"])
    same = F.zip_with(F.slice(pos, 1, F.size(pos) - 1), F.slice(pos, 2, F.size(pos) - 1), lambda a, b: a["h"] == b["h"])
    df = df.withColumn(t["bad"], F.when(pos.isNotNull(), same))
    same = F.col(t["bad"])
    either = F.zip_with(F.concat(same, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), same), lambda a, b: a | b)
    starts = F.sort_array(F.filter(F.zip_with(pos, either, lambda p, e: F.when(e, p["i"])), lambda x: x.isNotNull()))
    df = df.withColumn(t["pos"], F.when(pos.isNotNull(), starts))
    starts = F.col(t["pos"])
    steps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), b - a))
    repeats = F.coalesce(F.aggregate(steps, zero, lambda s, x: s + x), zero)

    df = df.withColumn(t["lines"], F.split(F.col(t["text"]), "\n"))
    lines = F.filter(F.col(t["lines"]), lambda x: x.rlike(FILLED))
    df = df.withColumn(t["bad"], F.transform(F.col(t["lines"]), lambda x: x.rlike(FILLED) & line_fails(x)))
    removed = F.aggregate(F.col(t["bad"]), F.lit(0), lambda s, x: s + x.cast("int"))
    kept_lines = F.when(
        F.array_contains(F.col(t["bad"]), True),
        F.array_join(F.filter(F.zip_with(F.col(t["lines"]), F.col(t["bad"]), lambda x, b: F.when(~b, x)), lambda x: x.isNotNull()), "\n"),
    ).otherwise(F.col(t["text"]))
    spaces = F.length(norm) - F.length(F.translate(norm, " ", ""))
    df = df.withColumns(
        {
            names["n_words"]: n.cast("long"),
            names["word_chars"]: (F.length(norm) - spaces).cast("long"),
            names["n_symbols"]: F.regexp_count(F.col(t["text"]), F.lit(SYMBOL_CLASS)).cast("long"),
            names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            names["n_repeat_words"]: repeats,
            names["n_lines_removed"]: removed.cast("long"),
            names["cleaned_text"]: kept_lines,
        }
    )
    chars = F.col(names["word_chars"])
    left = F.length(F.regexp_replace(F.col(names["cleaned_text"]), WS, "")).cast("long")
    df = df.withColumn(names["base_failed"], (F.col(names["n_words"]) < MIN_WORDS) | (100 * F.col(names["n_repeat_words"]) > REPEAT_PERCENT * F.col(names["n_words"])))
    lost = F.when(F.col(names["n_lines_removed"]) == 0, zero).otherwise(chars - left)
    df = df.withColumn(names["kept"], ~F.col(names["base_failed"]) & (100 * lost <= LOST_PERCENT * chars))
    return df.select(*docs.columns, *names.values())


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    docs = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (
  SELECT rid, i, list_slice(ws, i, i + 4) AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM r) GROUP BY rid),
l AS (
  SELECT rid, line, len(regexp_extract_all(line, '{SEPARATOR_CLASS}')) AS seps, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
         len(regexp_extract_all(line, '[\p{{L}}\p{{M}}]')) AS letters, len(regexp_extract_all(line, '{SYMBOL_CLASS}')) AS syms, len(regexp_extract_all(lower(line), '{BOILERPLATE_PATTERN}')) AS phrases, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS filled
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
),
v AS (
  SELECT *, (seps >= {SEPARATORS} AND nw <= {WORDS_PER_SEPARATOR} * (seps + 1)) OR (phrases > 0 AND nw <= {WORDS_PER_PHRASE} * phrases) OR 2 * letters < filled
         OR (syms >= {LEAST_SYMBOLS} AND 100 * syms > {SYMBOL_PERCENT} * nw) AS bad
  FROM l WHERE nw > 0
),
k AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(filled) FILTER (WHERE bad), 0) AS lost, count(*) FILTER (WHERE bad) AS removed
  FROM v GROUP BY rid
),
b AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '{SYMBOL_CLASS}'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(removed, 0)::BIGINT AS n_lines_removed
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN k USING (rid)
),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {LOST_PERCENT} * word_chars AS kept, n_lines_removed
FROM f
"""
