"""First values of each rule, found in levels."""

import random

from veilspark.operators import report as R
from veilspark.plans import sanitizer as S


def test_levels_give_the_first_values(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["a", "a", "a", "b"]), f"v{draw.randrange(9000)}", k) for k in range(30_000)]
    matches = spark.createDataFrame([(r, v, f"<{v}>", None, None, k) for r, v, k in rows], "rule_id string, original string, replacement string, context_before string, context_after string, ord int").repartition(6)
    first, n = {}, {}
    for r, v, k in rows:
        first.setdefault((r, v), k)
        n[r, v] = n.get((r, v), 0) + 1
    for most in (0, 1, 7, 5000, 100_000):
        want = [x for rule in "ab" for x in sorted((k, r, v) for (r, v), k in first.items() if r == rule)[:most]]
        got = sorted((r.first, r.rule_id, r.original, r.n) for r in R.replacements(matches, most).collect())
        assert got == sorted((k, r, v, n[r, v]) for k, r, v in want)
        assert R.truncated(matches, most) == (most < 7000)


def test_a_level_meets_bounded_groups(spark):
    """No group of the last level has more rows than shares * most: those before it have dropped the rest."""
    rows = spark.range(60_000).selectExpr("'a' as rule_id", "concat('v', id) as original", "id as first")
    out = R.first_of_each_rule(rows, 100, 4)
    assert sorted(r.first for r in out.collect()) == list(range(100))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") >= 3 and plan.count("<= 100") >= 3


def test_reports_on_the_driver_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_ON_DRIVER", 2)
    s = S.Sanitizer("00" * 32, rules=["ips"])
    _, report = s.sanitize_text(spark, "10.0.0.1 10.0.0.2 10.0.0.3", most_per_rule=None)
    assert [r["original"] for r in report["replacements"]] == ["10.0.0.1", "10.0.0.2"] and report["replacements_truncated"] and report["counts"] == {"ips": 3}
