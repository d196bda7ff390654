"""Fields of JSON lines and of key/value pairs in other lines: small helpers of the scan."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

#: A number that ends a pair, and the three ways that pairs are quoted.
NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.:+-])"
DOUBLE = re.compile(rf'(?<![\\\w])"((?:[^"\\\r\n]|\\.){{1,128}})"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|{NUMBER})', re.ASCII)
ESCAPED = re.compile(rf'\\"((?:[^"\\\r\n]|\\\\){{1,128}})\\"\s*:\s*(?:\\"((?:\\\\\\"|\\\\|\\[^"\\]|[^"\\])*)\\"|{NUMBER})', re.ASCII)
SINGLE = re.compile(rf"""(?<![\\\w])'((?:[^'\\\r\n]|\\.){{1,128}})'\s*:\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|{NUMBER})""", re.ASCII)

#: Values under a key that say nothing.
BLANK = ("", "-")


def _json_text(raw: str) -> str:
    try:
        return json.loads(f'"{raw}"') if "\\" in raw else raw
    except ValueError:
        return raw


def _repr_text(raw: str) -> str:
    return re.sub(r"""\\(['"\\])""", r"\1", raw)


def keyed_pairs(line: str, resolve) -> list[tuple[int, int, str, int, str]]:
    """(start, stop, value, rule, quote for a bare number) of pairs whose key asks for a rule, without overlaps."""
    styles = []
    if '":' in line or '" :' in line:
        styles.append((DOUBLE, _json_text, '"', 1))
        if '\\"' in line:
            styles.append((ESCAPED, lambda raw: _json_text(_json_text(raw)), '\\"', 2))
    if "':" in line or "' :" in line:
        styles.append((SINGLE, _repr_text, "'", 1))
    found = []
    for pattern, text_of, quote, closing in styles:
        for m in pattern.finditer(line):
            bare = m.lastindex == pattern.groups
            raw = m[m.lastindex]
            value = raw if bare else text_of(raw)
            if value in BLANK or (rule := resolve(text_of(m[1]))) is None:
                continue
            stop = m.end() - (0 if bare else closing)
            found.append((m.start(), stop - len(raw), stop, value, rule, quote if bare else ""))
    out, floor = [], 0
    for key, start, stop, value, rule, quote in sorted(found, key=lambda f: f[0]):
        if key >= floor:
            out.append((start, stop, value, rule, quote))
            floor = stop
    return out


# ---------------------------------------------------------------- JSON lines


def number_text(x: float) -> str:
    """The shortest text of a double, as JSON writers of browsers give it."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if -6 < point <= 21:
        body = text.ljust(point, "0")[:point] + ("." + text[point:] if len(text) > point else "") if point > 0 else "0." + "0" * -point + text
    else:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + body


def _refuse(name: str):
    raise ValueError(name)


class Leaf:
    """A string or number of a JSON line, and where it stands: a string's place is that between its quotes."""

    __slots__ = ("start", "stop", "value", "raw")

    def __init__(self, start: int, stop: int, value: str | float, raw: str):
        self.start, self.stop, self.value, self.raw = start, stop, value, raw

    def place(self, at: int) -> int:
        """Place in the line of a character of the decoded string."""
        if len(self.raw) == len(self.value):
            return self.start + at
        place = self.start
        for k, m in enumerate(_CHARACTER.finditer(self.raw)):
            if k == at:
                break
            place = self.start + m.end()
        return place

    def number(self) -> str:
        """A number's text as number_text() has it, or its own where that is another number."""
        text = number_text(self.value) if math.isfinite(self.value) else self.raw
        return text if len(self.raw) <= 15 or Decimal(text) == Decimal(self.raw) else self.raw


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s"{}\[\]:,]+')

#: A character of a JSON string as it is written: pairs of surrogates are one.
_CHARACTER = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|.", re.DOTALL)

_WORDS = {"true": True, "false": False, "null": None}


def parse_json(line: str):
    """The object or array of a line, its strings and numbers as Leaf; None if it is neither. Of a key that repeats, the last value counts."""
    if not line.lstrip().startswith(("{", "[")):
        return None
    try:
        json.loads(line.strip(), parse_int=float, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    top: list = []
    stack: list = [top]  # what is open: lists, and objects with the key that waits for its value
    keys: list[str | None] = [None]
    for m in _TOKEN.finditer(line):
        token = m[0]
        if token in ("}", "]"):
            stack.pop()
            keys.pop()
            continue
        if token in (":", ","):
            continue
        open_, key = stack[-1], keys[-1]
        if token[0] == '"':
            raw = token[1:-1]
            value = json.loads(token) if "\\" in raw else raw
            if isinstance(open_, dict) and key is None:
                keys[-1] = value
                continue
            node = Leaf(m.start() + 1, m.end() - 1, value, raw)
        elif token in ("{", "["):
            node = {} if token == "{" else []
        else:
            node = _WORDS[token] if token in _WORDS else Leaf(m.start(), m.end(), float(token), token)
        if isinstance(open_, dict):
            open_[key] = node
            keys[-1] = None
        else:
            open_.append(node)
        if token in ("{", "["):
            stack.append(node)
            keys.append(None)
    return top[0]


def walk(node, at, key: str | None = None, parent: str | None = None):
    """The value with each leaf replaced by at(leaf, key, parent); items of an array have its key and parent."""
    if isinstance(node, dict):
        return {k: walk(v, at, k, key) for k, v in node.items()}
    if isinstance(node, list):
        return [walk(v, at, key, parent) for v in node]
    return at(node, key, parent) if isinstance(node, Leaf) else node


_UNPAIRED = re.compile("[\ud800-\udfff]")


def json_text(node) -> str:
    """Compact JSON; keys that are whole numbers come first."""
    if isinstance(node, dict):
        first = sorted((k for k in node if re.fullmatch(r"0|[1-9][0-9]{0,9}", k) and int(k) < 2**32 - 1), key=int)
        order = [*first, *(k for k in node if k not in set(first))] if first else node
        return "{" + ",".join(f"{json_text(k)}:{json_text(node[k])}" for k in order) + "}"
    if isinstance(node, list):
        return "[" + ",".join(map(json_text, node)) + "]"
    if isinstance(node, Leaf):
        return node.number() if isinstance(node.value, float) else json_text(node.value)
    text = json.dumps(node, ensure_ascii=False)
    return _UNPAIRED.sub(lambda m: f"\\u{ord(m[0]):04x}", text) if isinstance(node, str) else text
