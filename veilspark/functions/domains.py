"""Top-level domains: the package's own list, the same on every machine, and how it is made from a public suffix list."""

from __future__ import annotations

import pkgutil
import sys
import zipfile
from functools import lru_cache

#: Domains that lists no longer have.
RETIRED_TLDS = "active an bl bq budapest cancerresearch cartier chloe doha doosan eh everbank flsmidth iwc mf mtpc panerai piaget sca shriram spiegel spreadbetting tp um"

HEAD = """# Top-level domains of the public suffix list (publicsuffix.org, MPL 2.0), as JDK 17 carries it, and the retired ones; sorted, one a line.
# Made by: python -m veilspark.functions.domains PATH-OF-A-LIST
"""


@lru_cache(maxsize=1)
def packaged_domains() -> tuple[str, ...]:
    lines = pkgutil.get_data(__package__, "top_level_domains.txt").decode().splitlines()
    return tuple(x for x in lines if x and not x.startswith("#"))


def domains_of(path: str) -> tuple[str, ...]:
    """Names of a public suffix list (its text, or the archive that a JDK has of it), with retired ones."""
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as names:
            found = set(names.namelist())
    else:
        with open(path, encoding="utf-8") as lines:
            found = {x for line in lines if (x := line.strip().rpartition(".")[2]) and not line.startswith("//")}
    return tuple(sorted(found | set(RETIRED_TLDS.split())))


if __name__ == "__main__":
    sys.stdout.reconfigure(encoding="utf-8")
    sys.stdout.write(HEAD + "".join(f"{n}\n" for n in domains_of(sys.argv[1])))
