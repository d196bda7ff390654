"""Byte ranges, lines in pieces, and files that come back file by file."""

import io
import os
import random
import tracemalloc

import pytest

from veilspark.errors import SanitizerError
from veilspark.operators.redact import Scanner, Settings
from veilspark.plans.sanitizer import Sanitizer
from veilspark.sources.bounded import files_below, first_piece, framed, line_ranges, range_of, read_bounded, write_files

KEY = "0123456789abcdef" * 4
SAMPLES = ["p\nq\n", "".join(f"entry {k * k}\n" for k in range(12)), ("-" * 90 + "\n") * 3, "\n" * 5, "one line and no end", "\n", "two lines\nand no end", "\ufeffmarked\nfile\n", "é\r\n日本\r\n"]


def ranges(text, parts, **options):
    data = text if isinstance(text, bytes) else text.encode()
    return line_ranges(io.BytesIO(data), len(data), parts, **options)


@pytest.mark.parametrize("text", SAMPLES)
def test_ranges_cover_a_file_and_end_behind_lines(text):
    data = text.encode()
    for parts in (1, 2, 3, 7, 16, 64):
        for options in ({}, {"probe": 1, "most": 4}, {"probe": 3, "most": 3}):
            found = ranges(text, parts, **options)
            assert found[0][0] == 0 and found[-1][1] == len(data)
            assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False)) and all(a < b for a, b in found)
            assert all(data[a - 1 : a] == b"\n" for a, _ in found[1:])


def test_ranges_of_odd_files():
    assert ranges("", 4) == []
    assert ranges("no end here", 8) == [(0, 11)]
    assert ranges("k\nl\nm\n", 1) == [(0, 6)]
    assert ranges("1111\n2222\n3333\n", 3) == [(0, 10), (10, 15)]
    assert ranges("a" * 70 + "\n" + "b" * 30, 4, probe=4, most=8) == [(0, 101)]  # no window of a cut reaches the line feed
    assert ranges("a" * 70 + "\n" + "b" * 30, 4, probe=4, most=64) == [(0, 71), (71, 101)]
    assert ranges("\ufeffm\nn\no\n", 3)[0][0] == 0
    data = b"one\ntwo\n"
    assert [range_of(io.BytesIO(data), 8, k, 8) for k in range(8)].count(None) == 6
    for parts, probe, most in ((0, 1, 1), (1, 0, 1), (1, 4, 3)):
        with pytest.raises(SanitizerError):
            ranges("a\n", parts, probe=probe, most=most)


def rows_of(data, most=64, overlap=16, parts=1):
    return [row for a, b in line_ranges(io.BytesIO(data), len(data), parts) for row in framed(io.BytesIO(data), a, b, most, overlap)]


def test_frames_do_not_depend_on_ranges_or_blocks(monkeypatch):
    draw = random.Random(4)
    data = b"".join(draw.choice([b"short\n", b"\r\n", "é日本".encode() * 40, b"word and words " * 9, b"\xff\xc3\n", b"\n", b"x" * 70 + b"\r\n"]) for _ in range(200)) + b"tail"
    want = rows_of(data)
    text = data.decode("utf-8", "replace")
    assert "".join(line + "\n" * ended for _, _, line, ended in want) == text
    assert max(len(line) for _, _, line, _ in want) <= 64 and len({(o, p) for o, p, _, _ in want}) == len(want) and sorted(r[:2] for r in want) == [r[:2] for r in want]
    for block, parts in ((1 << 20, 7), (1, 1), (3, 5), (64, 64)):
        monkeypatch.setattr("veilspark.sources.bounded.BLOCK", block)
        assert rows_of(data, parts=parts) == want


def test_pieces_are_those_of_the_scan():
    """A line in pieces from the source is redacted as one that the scan cuts itself."""
    s = Sanitizer(KEY, rules=["ips"], max_line_chars=64, overlap_chars=16)
    scan = Scanner(s.settings)
    for line in ("q" * 150 + "10.0.0.9" + "r" * 170, "from 10.0.0.9 to 10.0.0.10 " * 40, "a " * 500):
        pieces = [p for _, _, p, _ in rows_of(line.encode())]
        assert pieces == [p for _, p in scan._pieces(line)] and len(pieces) > 1
        assert "".join(scan.line(p)[0] for p in pieces) == scan.line(line)[0]
    assert first_piece("ab cd", 4, 2) == 3 and first_piece("abcde", 4, 2) == 4
    assert isinstance(s.settings, Settings)


def test_a_long_line_takes_bounded_memory(tmp_path):
    path, size = tmp_path / "long", 200 << 20
    with open(path, "wb") as f:
        for _ in range(200):
            f.write(b"0123456789abcde " * (1 << 16))
    tracemalloc.start()
    with open(path, "rb") as f:
        total = sum(len(line) for _, _, line, _ in framed(f, 0, size, 1 << 20, 1024))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    os.truncate(path, 0)
    assert total == size and peak < 24 << 20


@pytest.mark.parametrize("range_bytes", [64 << 20, 40])
def test_files_come_back_file_by_file(spark, tmp_path, range_bytes):
    s = Sanitizer(KEY, max_line_chars=100, overlap_chars=10)
    ip = s.token("ips", "10.0.0.1")
    files = {
        "a.log": b"x 10.0.0.1\r\ny\r\n", "b.log": b"no end 10.0.0.1", "sub/c.log": b"\n\n\xef\xbb\xbfnothing here\n", "sub/deep/d.log": b"", "e e.log": ("word " * 60 + "10.0.0.1 end\nlast\r").encode(),
        "f.json": b'{"ip": "10.0.0.1", "n": 9007199254740993}\n{"n": 1}\n', "sub/_skipped": b"10.0.0.1", ".hidden/g": b"10.0.0.1",
    }
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    report = s.sanitize_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), range_bytes=range_bytes)
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    want = {n: d.replace(b"10.0.0.1", ip.encode()) for n, d in files.items() if "_" not in n and ".hidden" not in n}
    want["f.json"] = f'{{"ip":"{ip}","n":9007199254740993}}\n{{"n":1}}\n'.encode()
    assert found == want
    assert report["counts"] == {"ips": 4} and report["replacements"][0]["n"] == 4 and report["line_count"] == 13  # four are pieces of one line
    again = s.sanitize_files(spark, f"file://{tmp_path}/in/b.log", str(tmp_path / "one"))
    assert again["counts"] == {"ips": 1} and (tmp_path / "one" / "b.log").read_bytes() == f"no end {ip}".encode()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.log", "b.log", "e e.log", "f.json", "sub"]


def test_written_files_have_parts_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {f"{k}.txt": "".join(f"line {i} of {k}\n" for i in range(3000 * k)) + "end" * (k % 2) for k in range(4)}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    rows = read_bounded(spark, str(tmp_path / "in"), range_bytes=5000)
    assert rows.rdd.getNumPartitions() > 20
    told = write_files(rows.orderBy("line"), str(tmp_path / "in"), str(tmp_path / "out"), part_rows=1000).collect()
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == texts
    assert max(r.parts for r in told) > 2 and {os.path.basename(r.file): r.bytes for r in told} == {n: len(t) for n, t in texts.items()}
    assert [p for p, _ in files_below(str(tmp_path / "out"))] == [str(tmp_path / "out" / n) for n in sorted(texts)]


def test_files_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from veilspark.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"x 10.0.0.1\r\nlast")
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--files", "--key", KEY, "--key-encoding", "hex", "--quiet"]) == 0
    assert (tmp_path / "out" / "a.txt").read_bytes() == f"x {Sanitizer(KEY).token('ips', '10.0.0.1')}\r\nlast".encode()
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--files", "--progress", "--key", KEY, "--key-encoding", "hex", "--quiet"]) == 0
    assert capsys.readouterr().err.splitlines()[-1].startswith("lines: 2, tasks: ")

    from veilspark.plans.runs import Run

    real = Run.result
    monkeypatch.setattr(Run, "result", lambda self: real(self) if self.aborted else (_ for _ in ()).throw(KeyboardInterrupt))
    assert main([str(tmp_path / "in"), str(tmp_path / "none"), "--files", "--key", KEY, "--key-encoding", "hex", "--quiet"]) == 1
    assert "aborted" in capsys.readouterr().err and not list((tmp_path / "none").rglob("*.txt"))
