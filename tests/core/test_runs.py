"""Progress and abort of a run."""

import time

import pytest

from veilspark.errors import ABORTED, SanitizerError
from veilspark.functions.rules import Rule
from veilspark.plans.runs import Run
from veilspark.plans.sanitizer import Sanitizer

KEY = "0123456789abcdef" * 4


def slow(value: str) -> bool:
    time.sleep(0.02)
    return True


def put(folder, files=4, lines=60):
    folder.mkdir()
    for k in range(files):
        (folder / f"{k}.log").write_text("".join(f"line {i} 10.0.0.{i % 9 + 1}\n" for i in range(lines)))


def test_progress_grows_to_the_whole(spark, tmp_path):
    put(tmp_path / "in")
    seen = []
    rule = Rule("ips", "a", "a", token="IP", patterns=(r"10\.0\.0\.\d",), validate=slow)
    run = Sanitizer(KEY, rules=[rule]).start_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), seen.append, 0.1, range_bytes=300)
    report = run.result()
    assert report["line_count"] == 240 and report["counts"] == {"ips": 240}
    end = run.progress()
    assert end["lines"] == 240 and end["tasks_done"] == end["tasks"] > 8
    lines = [p["lines"] for p in seen]
    assert lines == sorted(lines) and len(set(lines)) > 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{k}.log" for k in range(4)]


def test_an_aborted_run_leaves_nothing(spark, tmp_path):
    put(tmp_path / "in", lines=2000)
    rule = Rule("ips", "a", "a", token="IP", patterns=(r"10\.0\.0\.\d",), validate=slow)
    run = Sanitizer(KEY, rules=[rule]).start_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), range_bytes=600)
    while not run.progress()["lines"]:
        time.sleep(0.1)
    with pytest.raises(TimeoutError):
        run.result(0.01)
    began = time.time()
    run.abort()
    with pytest.raises(SanitizerError) as e:
        run.result()
    assert e.value.code == ABORTED and time.time() - began < 20
    assert 0 < run.progress()["lines"] < 8000
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    assert spark.range(5).count() == 5  # jobs of others go on


def test_results_and_errors_of_work(spark):
    assert Run(spark, lambda: spark.range(7).count()).result() == 7
    with pytest.raises(ZeroDivisionError):
        Run(spark, lambda: 1 // 0).result()
    done = Run(spark, lambda: 3)
    assert done.result() == 3
    done.abort()
    assert done.result() == 3 and done.progress()["lines"] is None
