"""Queries of all rules that no SQL expresses, against the definition of a scan applied to every line."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

from tests.core.test_scan import plain_taken
from veilspark.functions import fields
from veilspark.functions.builtin_rules import BUILTIN
from veilspark.functions.rules import KeyResolver, with_patterns
from veilspark.plans.queries import KEY, QUERIES
from veilspark.plans.sanitizer import Sanitizer

SF = "/root/testdata/sf0.001"
RULES, BOLD = ([with_patterns(r, bold) for r in BUILTIN.values()] for bold in (False, True))


def lines(text):
    parts = (text or "").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


@pytest.fixture(scope="module")
def sanitizer():
    return Sanitizer(KEY)


def rewritten(line, rules, sanitizer):
    """(output, [rule of each match]) of a line that has neither JSON nor pairs."""
    assert fields.parse_json(line) is None and not fields.keyed_pairs(line, KeyResolver(rules))
    out, at, seen = [], 0, []
    for rule, value, start in plain_taken(line, rules):
        out += [line[at:start], sanitizer.token(rule, value)]
        at = start + len(value)
        seen.append(rule)
    return "".join([*out, line[at:]]), seen


def rows(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet").column(c).to_pylist() for c in columns), strict=True))


def test_documents(spark, sanitizer):
    want = {}
    for i, text in rows("documents", "doc_id", "text"):
        done = [rewritten(x, RULES, sanitizer) for x in lines(text)]
        if done:
            want[i] = (len(done), sum(len(m) for _, m in done), sum(len(o) for o, _ in done))
    got = {r.doc_id: (r.n_lines, r.n_matches, r.n_chars) for r in QUERIES["sanitized_documents"](spark, SF).collect()}
    assert got == want and sum(m for _, m, _ in want.values()) >= 20


def test_preview(spark, sanitizer):
    got, size = [(r.doc_id, r.line_no, r.before, r.after, r.changed) for r in QUERIES["report_preview"](spark, SF).orderBy("doc_id", "line_no").collect()], 0
    want = []
    for i, text in sorted(rows("documents", "doc_id", "text")):
        for k, x in enumerate(lines(text)):
            if size < 4096:
                out, _ = rewritten(x, RULES, sanitizer)
                want.append((i, k, x, out, x != out))
                size += len(out) + 1
    assert got == want


def test_bold_patterns(spark, sanitizer):
    want = Counter(m for _, text in rows("documents", "doc_id", "text") for x in lines(text) for m in rewritten(x, BOLD, sanitizer)[1])
    assert {r.rule_id: r.n for r in QUERIES["aggressive_documents"](spark, SF).collect()} == dict(want)


def test_conversations(spark, sanitizer):
    want = {(c, t): rewritten(text or "", RULES, sanitizer)[0] for c, t, text in rows("conversations", "conv_id", "turn", "text")}
    assert {(r.conv_id, r.turn): r.text or "" for r in QUERIES["sanitized_conversations"](spark, SF).collect()} == want


def test_pages(spark, sanitizer):
    want = Counter(m for _, html in rows("pages", "page_id", "html") for x in lines(html) for m in rewritten(x, RULES, sanitizer)[1])
    assert {r.rule_id: r.n for r in QUERIES["sanitized_pages"](spark, SF).collect()} == dict(want)
