import json

from veilspark.__main__ import main


def test_command_line(spark, tmp_path):
    (tmp_path / "in.log").write_text("a 10.0.0.1\nb bob@example.com\nTK-12\n")
    (tmp_path / "rules.json").write_text(json.dumps([{"id": "ticket", "label": "t", "description": "d", "patterns": ["TK-\\d+"]}]))
    args = [str(tmp_path / "in.log"), str(tmp_path / "out"), "--key", "k", "--rules", str(tmp_path / "rules.json"), "--exclude", "users", "--report", str(tmp_path / "r.json")]
    assert main(args) == 0
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["counts"] == {"hosts": 1, "ips": 1, "ticket": 1} and report["line_count"] == 3
    assert main([]) == 2 and main([str(tmp_path / "in.log"), "--include", "nope", "--key", "k"]) == 2
