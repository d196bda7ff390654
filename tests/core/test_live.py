"""The live report of a stream against the report of the same lines at once."""

import pytest
from pyspark.sql import functions as F

from veilspark.errors import SanitizerError
from veilspark.plans.sanitizer import Sanitizer
from veilspark.sources.text import discard
from veilspark.streaming.live import LiveReport

KEY = "0123456789abcdef" * 4
BATCHES = [
    ["a 10.0.0.1 b", "none", "10.0.0.2 and 10.0.0.1", "x@corp-mail.com"],
    [],
    ["10.0.0.3 10.0.0.4", "again 10.0.0.1", "y@corp-mail.com x@corp-mail.com", ""],
    ["10.0.0.5", "10.0.0.2 10.0.0.4 10.0.0.1"],
]


def lines_of(k):
    return [(sum(map(len, BATCHES[:k])) + i, x) for i, x in enumerate(BATCHES[k])]


def strip(report):
    return report | {"replacements": [{k: v for k, v in r.items() if k not in ("first", "last")} for r in report["replacements"]], "preview": [(p["before"], p["after"], p["changed"]) for p in report["preview"]]}


@pytest.mark.parametrize(("most", "chars"), [(1000, 60), (2, 25), (0, 0)])
def test_state_after_each_batch_is_the_report_of_all_lines(spark, tmp_path, most, chars):
    s = Sanitizer(KEY, rules=["ips", "users"], context_chars=3)
    live = LiveReport(s, str(tmp_path / "live"), ["i"], most_per_rule=most, preview_chars=chars)
    assert live.snapshot(spark)["line_count"] == 0
    for k in range(len(BATCHES)):
        batch = spark.createDataFrame(lines_of(k), "i long, line string").repartition(3)
        for _ in range(1 + (k == 2)):  # a batch that runs twice counts once
            live.add(s.transform(batch), k)
        whole = s.transform(spark.createDataFrame([x for b in range(k + 1) for x in lines_of(b)], "i long, line string"))
        assert strip(live.snapshot(spark)) == strip(s.report(whole, "line", ["i"], chars, most))
    assert not live.snapshot(spark, False)["replacements"] and len(list((tmp_path / "live").iterdir())) == 2


def test_stream_with_a_sink_and_restart(spark, tmp_path):
    s = Sanitizer(KEY, rules=["ips"])
    live, out = LiveReport(s, str(tmp_path / "live"), ["i"], preview_chars=1000), []
    source = tmp_path / "in"

    def run(each=None):
        stream = spark.readStream.schema("i long, line string").option("maxFilesPerTrigger", 1).json(str(source))
        query = live.start(stream, str(tmp_path / "cp"), each)
        query.awaitTermination()

    def put(k):
        spark.createDataFrame(lines_of(k), "i long, line string").coalesce(1).write.json(f"{tmp_path}/made{k}")
        source.mkdir(exist_ok=True)
        for f in (tmp_path / f"made{k}").glob("part-*"):
            f.rename(source / f"{k}.json")

    put(0)
    run(lambda rows, number: out.append(rows.count()))
    put(2)
    with pytest.raises(Exception, match="sink"):  # a failing batch leaves the snapshot before it

        def fail(rows, number):
            raise RuntimeError("sink")

        run(fail)
    assert live.snapshot(spark)["line_count"] == 4 and live.snapshot(spark)["counts"] == {"ips": 3}
    run(lambda rows, number: (out.append(rows.count()), discard(rows)))
    assert out == [4, 4]
    whole = s.transform(spark.createDataFrame(lines_of(0) + lines_of(2), "i long, line string"))
    assert strip(live.snapshot(spark)) == strip(s.report(whole, "line", ["i"], 1000))


def test_values_leave_after_their_time(spark, tmp_path):
    s = Sanitizer(KEY, rules=["ips"])
    live = LiveReport(s, str(tmp_path / "live"), ["i"], most_per_rule=2, live_batches=2)
    for k, line in enumerate(["10.0.0.1 10.0.0.2", "10.0.0.2", "10.0.0.3 10.0.0.2", "10.0.0.4"]):
        live.add(s.transform(spark.createDataFrame([(k, line)], "i int, line string")), k)
    assert {r.original: r.n for r in live.replacements(spark).select(F.col("original"), "n").collect()} == {"10.0.0.2": 3, "10.0.0.3": 1}
    report = live.snapshot(spark)
    assert report["counts"] == {"ips": 6} and report["replacements_truncated"]
    for options in ({"most_per_rule": -1}, {"preview_chars": -1}, {"live_batches": 0}):
        with pytest.raises(SanitizerError):
            LiveReport(s, "x", ["i"], **options)
