"""The sanitizer: options once, then tables, texts, files and streams."""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import INVALID_KEY, INVALID_OPTION, INVALID_RULE, SanitizerError
from ..functions.builtin_rules import BUILTIN
from ..functions.rules import AllowList, KeyResolver, Rule, always_rule, compiled, resolve_rules, with_patterns
from ..operators import nested as N
from ..operators import report as R
from ..operators.exempt import redact_except
from ..operators.redact import MAX_LINE_CHARS, OVERLAP_CHARS, Once, Settings, Tokens, once, redact, redacted
from ..sources import text as T
from ..sources.bounded import RANGE_BYTES, read_bounded, write_files
from ..sources.shared import cut
from .runs import Run


#: Distinct values of a rule that a report on the driver has at most; R.replacements() gives tables of any size.
MOST_ON_DRIVER = 100_000


def generate_key(n_bytes: int = 32) -> str:
    """Random key in hexadecimal, made once on the driver."""
    if n_bytes < 16:
        raise SanitizerError(INVALID_KEY, "a key has 16 bytes at least")
    return secrets.token_hex(n_bytes)


def key_bytes(key: str, encoding: str = "hex") -> bytes:
    if not key:
        raise SanitizerError(INVALID_KEY, "the key is empty")
    if encoding == "utf8":
        return key.encode()
    if encoding != "hex" or not re.fullmatch(r"(?:[0-9a-fA-F]{2})+", key):
        raise SanitizerError(INVALID_KEY, "a hex key has an even number of hexadecimal digits")
    return bytes.fromhex(key)


class Sanitizer:
    """Finds and replaces secrets, personal data and infrastructure names.

    Rules are ids of built-in ones or Rule objects, in order of priority; always_* make a
    rule before all others, never_* exempt values. Equal values have equal tokens under
    one key. Offsets count characters (code points). A line beyond max_line_chars is looked
    at in pieces, cut behind white space among a piece's last overlap_chars if there is some.
    """

    def __init__(
        self,
        key: str | None = None,
        key_encoding: str = "hex",
        rules: Iterable[Rule | str] | None = None,
        extra_rules: Iterable[Rule] = (),
        aggressive: bool = False,
        json: bool = True,
        always_values: Iterable[str] = (),
        always_patterns: Iterable[str] = (),
        always_rule_id: str = "custom",
        always_mode: str = "pseudo",
        always_token: str | None = None,
        never_values: Iterable[str] = (),
        never_patterns: Iterable[str] = (),
        never_by_rule: Mapping[str, Iterable[str]] | None = None,
        context_chars: int = 0,
        max_line_chars: int = MAX_LINE_CHARS,
        overlap_chars: int = OVERLAP_CHARS,
    ):
        if max_line_chars < 1:
            raise SanitizerError(INVALID_OPTION, "max_line_chars is 1 at least")
        if not 0 <= overlap_chars < max_line_chars:
            raise SanitizerError(INVALID_OPTION, "overlap_chars is 0 at least and below max_line_chars")
        if context_chars < 0:
            raise SanitizerError(INVALID_OPTION, "context_chars is 0 at least")
        self.key = generate_key() if key is None else key
        found = resolve_rules(BUILTIN if rules is None else rules, BUILTIN, extra_rules)
        first = always_rule(always_values, always_patterns, always_rule_id, always_mode, always_token)
        if first is not None:
            if any(r.id == first.id for r in found):
                raise SanitizerError(INVALID_RULE, f"there is a rule {first.id!r} already")
            found.insert(0, first)
        for p in (patterns := tuple(never_patterns)):
            try:
                compiled(p)
            except Exception as e:
                raise SanitizerError(INVALID_OPTION, f"{p!r} is no pattern: {e}") from e
        allow = AllowList(frozenset(never_values), patterns, {k: frozenset(v) for k, v in (never_by_rule or {}).items()})
        self.rules = [with_patterns(r, aggressive) for r in found]
        self.settings = Settings(tuple(self.rules), key_bytes(self.key, key_encoding), allow, json, context_chars, max_line_chars, overlap_chars)

    # ------------------------------------------------ columns and tables

    def column(self, text: Column) -> Column:
        """Struct (output, is_json, matches) of lines in a column."""
        return redacted(text, self.settings)

    def transform(self, df: DataFrame, column: str = "line", into: str = "redacted") -> DataFrame:
        return redact(df, column, self.settings, into)

    def transform_except(self, df: DataFrame, exempt: DataFrame, column: str = "line", value: str = "value", into: str = "redacted") -> DataFrame:
        """As transform(), but values of a table stay: never_values for lists of any size."""
        return redact_except(df, column, self.settings, exempt, value, into)

    def transform_text(self, df: DataFrame, text: str, by: list[str]) -> DataFrame:
        """Rows (by, line_no, line, redacted): each line of a text by itself."""
        return self.transform(T.explode_lines(df.select(*by, text), text), "line")

    def token(self, rule_id: str, value: str) -> str:
        """The replacement of one value."""
        at = next(i for i, r in enumerate(self.rules) if r.id == rule_id)
        return Tokens(self.settings).token(at, value)

    def columns_by_rule(self, df: DataFrame) -> dict[str, str]:
        """Columns whose names ask for a rule, as field names of JSON lines do."""
        resolve = KeyResolver(self.rules)
        return {c: self.rules[i].id for c in df.columns if (i := resolve(c)) is not None}

    def transform_columns(self, df: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
        """Replaces whole values of the named columns, or of those whose names ask for it; empty ones and "-" stay."""
        named = self.columns_by_rule(df) if rules is None else dict(rules)
        ids = [r.id for r in self.rules]
        allowed, tokens = self.settings.allow, Once(Tokens, self.settings)

        def replaced(rule: int):
            @F.arrow_udf("string")
            def run(values: pa.Array) -> pa.Array:
                token, exempt = tokens().token, allowed.matcher()
                coded = values.dictionary_encode()  # each distinct value of a batch once
                new = [v if v in ("", "-") or exempt(ids[rule], v) else token(rule, v) for v in coded.dictionary.to_pylist()]
                return pa.array(new, pa.string()).take(coded.indices)

            return run

        return df.withColumns({c: replaced(ids.index(rule))(F.col(c).cast("string")) for c, rule in named.items()})

    def transform_nested(self, df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
        """Replaces whole values of all columns, or of those named, and below their structs, arrays and maps, where names ask for it: as JSON lines are walked.

        Empty values and "-" stay, nulls too. Numbers that are replaced become text. Columns without such a name are passed on untouched.
        """
        resolve, tokens, allowed, ids = KeyResolver(self.rules), Once(Tokens, self.settings), self.settings.allow, [r.id for r in self.rules]
        plans = {f.name: N.planned(f.dataType, resolve, f.name) for f in df.schema if columns is None or f.name in set(columns)}

        def column(name: str, plan, kind) -> Column:
            @F.arrow_udf(kind)
            def run(values: pa.Array) -> pa.Array:
                token, exempt = tokens().token, allowed.matcher()
                return N.rewritten(values, plan, resolve, lambda rule, text: text if exempt(ids[rule], text) else token(rule, text))

            return run(F.col(f"`{name}`"))

        return df.withColumns({name: column(name, plan, kind) for name, (plan, kind) in plans.items() if plan is not None})

    def rule_catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.id, r.label, r.mode, r.prefix, len(r.patterns), list(r.json_keys), list(r.json_key_contains)) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "priority int, rule_id string, label string, mode string, prefix string, n_patterns int, json_keys array<string>, json_key_contains array<string>")

    # ------------------------------------------------ texts, files, streams

    def sanitize_text(self, spark: SparkSession, text: str, preview_chars: int = 0, most_per_rule: int | None = None) -> tuple[str, dict]:
        """(text, report) of a text that the driver holds."""
        df = self.transform_text(spark.createDataFrame([(text,)], "text string").withColumn("id", F.lit(0)), "text", ["id"])
        df = df.cache()
        lines = [r.o for r in df.orderBy("line_no").select(F.col("redacted.output").alias("o")).collect()]
        report = self.report(df, "line", ["line_no"], preview_chars, most_per_rule)
        df.unpersist()
        return "\n".join(lines) + ("\n" if text.endswith("\n") else ""), report

    def report(self, df: DataFrame, line: str, order: list[str], preview_chars: int = 0, most_per_rule: int | None = 1000) -> dict:
        """Summary on the driver: counts by rule, totals, replacements (most_per_rule a rule, MOST_ON_DRIVER at most) and a preview of bounded size."""
        return self._report(cut(df.select(*order, line, "redacted")), line, order, preview_chars, most_per_rule)

    def _report(self, kept: DataFrame, line: str, order: list[str], preview_chars: int, most_per_rule: int | None) -> dict:
        """From rows that are stored: nothing here scans a line again."""
        most_per_rule = MOST_ON_DRIVER if most_per_rule is None else min(most_per_rule, MOST_ON_DRIVER)
        matches = R.matches_of(kept, order)
        counted = {r.rule_id: r.n for r in R.counts(matches).collect()}
        return {
            "counts": counted,
            "total_matches": sum(counted.values()),
            "line_count": kept.count(),
            "replacements": [r.asDict() for r in R.replacements(matches, most_per_rule).orderBy("first").collect()],
            "replacements_truncated": R.truncated(matches, most_per_rule),
            "preview": [r.asDict() for r in R.preview(kept, line, order, preview_chars).collect()] if preview_chars else [],
        }

    def sanitize_path(self, spark: SparkSession, source: str, target: str | None) -> DataFrame:
        """Reads lines, writes what they become (or nothing, for the counts alone), and returns the counts by rule: one scan, counted as it writes."""
        seen = Observation()
        of_rule = lambda rule: F.filter("redacted.matches", lambda m: m["rule_id"] == rule.id)
        each = [F.sum(F.size(of_rule(r))).alias(f"n{i}") for i, r in enumerate(self.rules)]
        df = self.transform(T.read_lines(spark, source), "line").observe(seen, F.count(F.lit(1)).alias("lines"), *each)
        out = df.select(F.col("redacted.output").alias("line"))
        T.discard(out) if target is None else T.write_lines(out, target)
        rows = [(r.id, n) for i, r in enumerate(self.rules) if (n := seen.get[f"n{i}"])]
        return spark.createDataFrame(rows, "rule_id string, n long")

    def sanitize_file(self, spark: SparkSession, source: str, target: str | None, preview_chars: int = 0, most_per_rule: int | None = 1000) -> dict:
        """As sanitize_path(), with the whole report: lines are scanned once, outputs and matches kept in the shared folder for both."""
        kept = self.scanned(spark, source)
        if target is not None:
            self.write(kept, target)
        return self.report_of(kept, preview_chars, most_per_rule)

    def sanitize_files(self, spark: SparkSession, source: str, target: str | None, preview_chars: int = 0, most_per_rule: int | None = 1000, range_bytes: int = RANGE_BYTES, lines_seen=None) -> dict:
        """A file, or each file below a folder, to a file of the same name below target: same order, line ends and last line. Gives the report; lines are scanned once.

        Files are read in ranges of range_bytes, lines beyond max_line_chars in pieces, so a task's memory is bounded however long they are.
        """
        rows = read_bounded(spark, source, self.settings.max_line_chars, self.settings.overlap_chars, range_bytes)
        kept = cut(once(rows, redacted(F.col("line"), self.settings, lines_seen), "redacted"))
        if target is not None:
            write_files(kept.withColumn("line", F.col("redacted.output")), source, target)
        return self._report(kept.where("ended or line <> ''"), "line", ["source", "offset", "piece"], preview_chars, most_per_rule)

    def start_files(self, spark: SparkSession, source: str, target: str | None, on_progress: Callable[[dict], None] | None = None, every: float = 0.5, **options) -> Run:
        """sanitize_files() beside the caller: progress(), abort() and result() of the run. A file of an aborted run is there whole or not at all."""
        lines = spark.sparkContext.accumulator(0)
        return Run(spark, lambda: self.sanitize_files(spark, source, target, lines_seen=lines, **options), lines, on_progress, every)

    def scanned(self, spark: SparkSession, source: str) -> DataFrame:
        """Lines of files with what they become, kept in the shared folder."""
        return cut(self.transform(T.read_lines(spark, source), "line"))

    def write(self, kept: DataFrame, target: str) -> None:
        T.write_lines(kept.select(F.col("redacted.output").alias("line")), target)

    def report_of(self, kept: DataFrame, preview_chars: int = 0, most_per_rule: int | None = 1000) -> dict:
        return self._report(kept, "line", ["source", "block", "row"], preview_chars, most_per_rule)

    def sanitize_stream(self, stream: DataFrame, column: str = "line") -> DataFrame:
        """Streaming or static rows with `column` replaced; stateless, so append mode holds."""
        return once(stream, self.column(F.col(column))["output"], column)
