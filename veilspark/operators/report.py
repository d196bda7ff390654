"""Reports over redacted rows: counts, distinct replacements, previews, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import INVALID_OPTION, SanitizerError


#: Groups that meet in one at each level of a search for a rule's first values.
SHARES = 16


def matches_of(df: DataFrame, order: list[str], redacted: str = "redacted") -> DataFrame:
    """A row a match: rule_id, original, replacement, contexts, and ord, its place by the order columns."""
    m = F.explode(f"{redacted}.matches").alias("m")
    return df.select(*order, m).select(F.struct(*order, F.col("m.seq").alias("seq")).alias("ord"), "m.*").drop("seq", "index", "length")


def counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("rule_id").agg(F.count("*").alias("n"))


def totals(df: DataFrame, redacted: str = "redacted") -> DataFrame:
    """One row: line_count, total_matches."""
    return df.agg(F.count("*").alias("line_count"), F.coalesce(F.sum(F.size(f"{redacted}.matches")), F.lit(0)).alias("total_matches"))


def replacements(matches: DataFrame, most_per_rule: int | None = None) -> DataFrame:
    """A row each distinct (rule_id, original): replacement, n, the first match's context, first (its place).

    most_per_rule keeps the first ones of each rule, as a report that asks for so many; counts stay whole.
    """
    if most_per_rule is not None and most_per_rule < 0:
        raise SanitizerError(INVALID_OPTION, "most_per_rule is 0 at least")
    if "n" not in matches.columns:
        matches = matches.withColumns({"n": F.lit(1).cast("long"), "first": F.col("ord")})
    by = F.min_by(F.struct("replacement", "context_before", "context_after"), "first")
    rows = matches.groupBy("rule_id", "original").agg(F.sum("n").alias("n"), F.min("first").alias("first"), by.alias("c"))
    rows = rows.select("rule_id", "original", "c.replacement", "n", "c.context_before", "c.context_after", "first")
    return rows if most_per_rule is None else first_of_each_rule(rows, most_per_rule)


def first_of_each_rule(rows: DataFrame, most: int, shares: int = SHARES) -> DataFrame:
    """The rows of each rule that come first, by distinct places `first`.

    In levels: a rule's values are dealt by hash over shares * shares groups, each keeps its
    first ones, and what is left meets in `shares` groups and then in one, which has
    shares * most rows at most, however many values the rule has.
    """
    dealt = F.pmod(F.xxhash64("original", F.lit(7)), F.lit(shares * shares))
    rows = rows.withColumn("__share", dealt)
    for keys in ([F.col("__share")], [F.pmod("__share", F.lit(shares))], []):
        by_place = Window.partitionBy("rule_id", *keys).orderBy("first")
        rows = rows.withColumn("__rank", F.row_number().over(by_place)).where(F.col("__rank") <= most).drop("__rank")
    return rows.drop("__share")


def truncated(matches: DataFrame, most_per_rule: int | None) -> bool:
    """Whether a limit leaves distinct values of a rule out."""
    if most_per_rule is None:
        return False
    distinct = matches.groupBy("rule_id", "original").count().groupBy("rule_id").agg(F.count("*").alias("d"))
    return not distinct.where(F.col("d") > most_per_rule).isEmpty()


def merge_replacements(parts: list[DataFrame], most_per_rule: int | None = None) -> DataFrame:
    """Replacement tables of disjoint parts as one: counts add up, the first context wins, the limit holds anew."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return replacements(whole, most_per_rule)


def merge_counts(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("rule_id").agg(F.sum("n").alias("n"))


def preview(df: DataFrame, line: str, order: list[str], preview_chars: int, redacted: str = "redacted") -> DataFrame:
    """The first lines, before and after, until their outputs have preview_chars characters; whole lines, none at 0."""
    if preview_chars < 0:
        raise SanitizerError(INVALID_OPTION, "preview_chars is 0 at least")
    # A line has a character at least with its end, so no more lines than characters can be in a preview.
    head = df.select(*order, F.col(line).alias("before"), F.col(f"{redacted}.output").alias("after")).orderBy(*order).limit(preview_chars)
    size = F.length("after") + 1
    before = F.coalesce(F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("__before", before).where(F.col("__before") < preview_chars).drop("__before").withColumn("changed", F.col("before") != F.col("after"))


def highlighted(lines: DataFrame, redacted: str = "redacted", line: str = "line") -> DataFrame:
    """lines with before_segments and after_segments, arrays of (text, changed): the places of matches in the line, and tokens in the output."""
    segment = "struct<text:string,changed:boolean>"
    piece = lambda text, changed: F.struct(text.alias("text"), F.lit(changed).alias("changed"))
    filled = lambda pieces: F.filter(pieces, lambda x: F.length(x["text"]) > 0)
    text, out = F.coalesce(F.col(line), F.lit("")), F.coalesce(F.col(f"{redacted}.output"), F.lit(""))
    places = F.array_sort(F.transform(f"{redacted}.matches", lambda m: F.struct(m["index"].alias("index"), m["length"].alias("length"))))

    def cut(state, m):
        gap, value = F.substr(text, state["at"] + 1, m["index"] - state["at"]), F.substr(text, m["index"] + 1, m["length"])
        return F.struct((m["index"] + m["length"]).alias("at"), F.concat(state["seen"], filled(F.array(piece(gap, False), piece(value, True)))).alias("seen"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{segment}>").alias("seen"))
    before = F.aggregate(places, start, cut, lambda s: F.concat(s["seen"], filled(F.array(piece(F.substr(text, s["at"] + 1), False)))))
    rest, tokens = F.split(out, TOKEN), F.regexp_extract_all(out, F.lit(f"({TOKEN})"))
    woven = F.flatten(F.transform(rest, lambda r, i: F.when(i < F.size(tokens), F.array(piece(r, False), piece(F.get(tokens, i), True))).otherwise(F.array(piece(r, False)))))
    return lines.withColumns({"before_segments": before, "after_segments": filled(woven)})


#: Fixed value: the form of a replacement.
TOKEN = "<[A-Z][A-Z0-9]*:[0-9a-f]{16}>"


def merge_reports(reports: list[dict], most_per_rule: int | None = None, preview_chars: int | None = None) -> dict:
    """Reports of disjoint parts, in their order, as one: sums; the first context of a value; limits hold anew.

    For reports as Sanitizer.report() gives them, which are of bounded size; tables of any
    size merge by merge_replacements().
    """
    counted: dict[str, int] = {}
    rows: dict[tuple[str, str], dict] = {}
    kept: dict[str, int] = {}
    cut_off, preview, size = False, [], 0
    for part in reports:
        cut_off |= part["replacements_truncated"]
        for rule, n in part["counts"].items():
            counted[rule] = counted.get(rule, 0) + n
        for row in part["replacements"]:
            at = row["rule_id"], row["original"]
            if at in rows:
                rows[at]["n"] += row["n"]
            elif most_per_rule is not None and kept.get(at[0], 0) >= most_per_rule:
                cut_off = True
            else:
                kept[at[0]] = kept.get(at[0], 0) + 1
                rows[at] = dict(row)
        for line in part["preview"]:
            if preview_chars is None or size < preview_chars:
                preview.append(line)
                size += len(line["after"] or "") + 1
    return {
        "counts": counted, "total_matches": sum(counted.values()), "line_count": sum(p["line_count"] for p in reports),
        "replacements": list(rows.values()), "replacements_truncated": cut_off, "preview": preview,
    }


def report_text(line_count: int, counted: dict[str, int]) -> str:
    return "\n".join([f"lines: {line_count}", f"matches: {sum(counted.values())}", *(f"  {rule}: {n}" for rule, n in counted.items())]) + "\n"
