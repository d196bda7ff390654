"""Large lists of values: leftmost, longest, in one pass."""

import random
import re
import time

import pytest

from veilspark.errors import SanitizerError
from veilspark.functions import rules as R
from veilspark.operators import redact
from veilspark.operators.redact import Scanner, Settings
from veilspark.plans.sanitizer import Sanitizer

KEY = "0123456789abcdef" * 4


def scan(values, **options):
    s = Sanitizer(KEY, always_values=values, **({"json": False, "rules": []} | options))
    return Scanner(s.settings).line


def test_lists_find_what_patterns_find(monkeypatch):
    draw = random.Random(2)
    for _ in range(150):
        values = {"".join(draw.choices("ab c", k=draw.randrange(1, 5))).strip() for _ in range(draw.randrange(1, 30))} - {""} or {"a"}
        text = "".join(draw.choices("ab cd10.", k=60)) + " 10.0.0.1 bab"
        got = []
        for few in (1000, 0):
            monkeypatch.setattr(R, "FEW_LITERALS", few)
            got.append(scan(values, rules=["ips"], never_values=["ab"])(text))
        assert got[0] == got[1]
        want = [m[0] for m in re.finditer("|".join(map(re.escape, sorted(values, key=lambda v: -len(v)))), text)]
        assert [m[1] for m in scan(values)(text)[2]] == want


def test_any_number_of_values_takes_one_pass():
    text = " ".join(f"word{k % 977}" for k in range(60_000))
    took = []
    for n in (100, 100_000):
        one = scan([f"word{k}x" for k in range(n)] + ["word976 word0"])
        began = time.process_time()
        assert len(one(text)[2]) == 61
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 1


def test_lists_have_a_bound_and_fit_other_rules(monkeypatch):
    monkeypatch.setattr(R, "MOST_LITERAL_CHARS", 1000)
    with pytest.raises(SanitizerError) as e:
        Sanitizer(KEY, always_values=[f"value {k}" for k in range(500)])
    assert e.value.code == "INVALID_OPTION"
    rule = R.define_rule(R.Rule("names", "Names", "Names", literals=("eve", "bob"), validate=lambda v: v != "bob"))
    out, _, matches = Scanner(Settings((rule,), b"k")).line('{"x": "eve and bob"}')
    assert [(m[1], m[3]) for m in matches] == [("eve", 7)] and "bob" in out
    assert isinstance(Scanner(Settings((rule,), b"k")).cursors[-1], redact.Literals)


def test_a_table_exempts_what_a_list_exempts(spark):
    values = ["10.0.0.1", "eve", "48.5", "x@corp-mail.com", None, "eve", 'a"b']
    lines = ["10.0.0.1 10.0.0.2", '{"user": "eve", "username": "a\\"b", "lat": 48.5, "ip": "10.0.0.1", "note": "x@corp-mail.com 10.0.0.3"}', "none", None, "", "user=eve host=web-1", 'ev "userId": 77, "latitude": 48.5', "y@corp-mail.com"]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(lines)], "i int, line string, __row int").repartition(3)
    exempt = spark.createDataFrame([(v,) for v in values], "value string")
    s, t = Sanitizer(KEY, context_chars=4), Sanitizer(KEY, context_chars=4, never_values=[v for v in values if v])
    out = s.transform_except(df, exempt)
    assert out.columns == ["i", "line", "__row", "redacted"]
    assert sorted(out.collect()) == sorted(t.transform(df).collect())
    assert sorted(s.transform_except(df, exempt.limit(0)).collect()) == sorted(s.transform(df).collect())
    assert s.transform_except(df.limit(0), exempt).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "corp-mail" not in plan
