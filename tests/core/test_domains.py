"""The list of top-level domains is the package's: no machine's Java changes it."""

import os
import subprocess
import sys
import zipfile

from veilspark.functions.builtin_rules import BUILTIN, host_rule
from veilspark.functions.domains import HEAD, domains_of, packaged_domains
from veilspark.functions.rules import compiled


def hosts(text, rule=BUILTIN["hosts"]):
    return [m[m.lastindex or 0] for p in rule.patterns for m in compiled(p).finditer(text)]


def test_no_java_changes_nothing():
    code = "from veilspark.functions.builtin_rules import BUILTIN; import hashlib; print(hashlib.sha256(repr(BUILTIN['hosts'].patterns).encode()).hexdigest())"
    run = lambda env: subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout
    plain = {"PYTHONPATH": os.getcwd()}
    assert run({**os.environ, **plain}) == run({**plain, "PATH": "/nonexistent"}) == run({**plain, "JAVA_HOME": "/nonexistent", "PATH": "/nonexistent"})


def test_list_is_sorted_and_told():
    names = packaged_domains()
    assert list(names) == sorted(set(names)) and len(names) > 1400 and {"com", "ninja", "xyz", "бг", "um"} <= set(names)


def test_names_that_files_and_code_have_need_a_scheme():
    assert hosts("see a.ninja and b.co.uk, main.py request.app notes.data x.go") == ["a.ninja", "b.co.uk"]
    assert hosts("https://main.py/ http://a.app/") == ["main.py", "a.app"]


def test_a_list_of_ones_own(tmp_path):
    (tmp_path / "list.dat").write_text("// note\ncom\nco.uk\n*.made\n\nзона\n", encoding="utf-8")
    assert {"com", "uk", "made", "зона", "um"} <= set(domains_of(str(tmp_path / "list.dat")))
    assert hosts("a.made b.ninja", host_rule(str(tmp_path / "list.dat"))) == ["a.made"]
    with zipfile.ZipFile(tmp_path / "list.zip", "w") as z:
        z.writestr("com", "")
        z.writestr("other", "")
    assert {"com", "other"} <= set(domains_of(str(tmp_path / "list.zip"))) and HEAD.startswith("#")
    assert hosts("a.only", host_rule(("only",))) == ["a.only"]
