"""Redaction of a text column.

One function over each row, which shuffles nothing. In a unit of text (a line, or a string
of a JSON line) every pattern has a cursor at its next value; the leftmost value is taken,
then the rule's and the pattern's order decide, and cursors that are behind its end move
on. A value that its rule's check refuses takes its span all the same. Filters on other
columns go below the function, to the files; those on its result stay above it and use
the value that was computed. Keys for tokens stay out of plans: they travel with the function.
"""

from __future__ import annotations

import hashlib
import heapq
import hmac
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.rules import AllowList, KeyResolver, Rule, compiled, python_pattern

MATCHES = "array<struct<rule_id:string,original:string,replacement:string,index:int,length:int,seq:int,context_before:string,context_after:string>>"
RESULT = f"output string, is_json boolean, matches {MATCHES}"

#: Characters of a line that are looked at together, and among its last ones a place for a cut is looked for.
MAX_LINE_CHARS, OVERLAP_CHARS = 1 << 20, 1024


@dataclass(frozen=True)
class Settings:
    """What the function needs on an executor; pickled with it."""

    rules: tuple[Rule, ...]
    key: bytes = field(repr=False)
    allow: AllowList = field(default_factory=AllowList)
    json: bool = True
    context_chars: int = 0
    max_line_chars: int = MAX_LINE_CHARS
    overlap_chars: int = OVERLAP_CHARS


#: Characters between a value and the next one's floor that are searched again without asking how far a prefix reaches.
NEAR = 200

#: Sets of characters that a gate has at most; common letters tell nothing.
GATES, COMMON = 3, frozenset("abcdefghijklmnopqrstuvwxyz ")


@lru_cache(maxsize=4096)
def gates(source: str) -> tuple[frozenset[str], ...]:
    """Sets of characters: a text that has a match has a character of each. Found in the parsed pattern; none where that is not plain."""
    from re import _constants as C
    from re import _parser as P

    def chars(items) -> frozenset[str]:
        out: set[str] = set()
        for op, arg in items:
            if op is C.LITERAL:
                out.add(chr(arg))
            elif op is C.RANGE and arg[1] - arg[0] < 64:
                out.update(map(chr, range(arg[0], arg[1] + 1)))
            elif op is C.CATEGORY and arg is C.CATEGORY_DIGIT:
                out.update("0123456789")
            else:
                return frozenset()
        return frozenset(out)

    def walk(items) -> list[frozenset[str]]:
        out = []
        for op, arg in items:
            if op is C.LITERAL:
                out.append(frozenset(chr(arg)))
            elif op is C.IN:
                out.append(chars(arg))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
                out += walk(arg[2])
            elif op is C.SUBPATTERN and not arg[1] & re.IGNORECASE:
                out += walk(arg[3])
            elif op is C.ASSERT:
                out += walk(arg[1])
            elif op is C.BRANCH:
                each = [min(kept, key=cost, default=frozenset()) for kept in (list(filter(None, walk(a))) for a in arg[1])]
                if all(each):
                    out.append(frozenset().union(*each))
        return [s for s in out if s]

    def cost(s: frozenset[str]) -> tuple[int, int]:
        return len(s & COMMON), len(s)

    try:
        tree = P.parse(python_pattern(source), re.ASCII)
    except re.error:
        return ()
    if tree.state.flags & re.IGNORECASE:
        return ()
    return tuple(sorted({s for s in walk(tree) if not s & COMMON}, key=lambda s: (*cost(s), sorted(s)))[:GATES])


@lru_cache(maxsize=4096)
def reach(source: str) -> tuple[int, frozenset[str]] | None:
    """How far a pattern's prefix may begin before its group: so many characters, besides any number of those in a set and of those beyond ASCII. None if that is not plain."""
    from re import _constants as C
    from re import _parser as P

    def chars(op, arg) -> frozenset[str] | None:
        """ASCII characters that one item takes."""
        if op is C.LITERAL:
            return frozenset(chr(arg))
        if op is C.IN:
            out: set[str] = set()
            for o, a in arg:
                if o is C.LITERAL:
                    out.add(chr(a))
                elif o is C.RANGE:
                    out.update(map(chr, range(a[0], min(a[1], 127) + 1)))
                elif o is not C.NEGATE:
                    return frozenset(map(chr, range(128)))
            return frozenset(map(chr, range(128))) - out if arg[0][0] is C.NEGATE else frozenset(out)
        return frozenset(map(chr, range(128))) if op in (C.ANY, C.NOT_LITERAL, C.CATEGORY) else None

    def width(items) -> tuple[int, frozenset[str]] | None:
        most, free = 0, frozenset()
        for op, arg in items:
            if op in (C.ASSERT, C.ASSERT_NOT, C.AT):
                continue
            if op in (C.LITERAL, C.IN, C.ANY, C.NOT_LITERAL, C.CATEGORY):
                most += 1
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, sub = arg
                if high is C.MAXREPEAT or high > 64:
                    if len(sub) != 1 or (some := chars(*sub[0])) is None:
                        return None
                    free |= some
                elif (inner := width(sub)) is None:
                    return None
                else:
                    most, free = most + high * inner[0], free | inner[1]
            elif op is C.SUBPATTERN and arg[0] is None:
                if (inner := width(arg[3])) is None or arg[1] & re.IGNORECASE and inner[1]:
                    return None
                most, free = most + inner[0], free | inner[1]
            elif op is C.BRANCH:
                each = [width(a) for a in arg[1]]
                if not all(each):
                    return None
                most, free = most + max(w for w, _ in each), free.union(*(f for _, f in each))
            else:
                return None
        return most, free

    try:
        tree = list(P.parse(python_pattern(source), re.ASCII))
    except re.error:
        return None
    place = next((k for k, (op, arg) in enumerate(tree) if op is C.SUBPATTERN and arg[0] == 1), None)
    return None if place is None else width(tree[:place])


class Cursor:
    """One pattern's next value in a text."""

    __slots__ = ("rank", "order", "pattern", "grouped", "needs", "check", "guard", "resume", "reach")

    def __init__(self, rank: int, order: int, source: str, rule: Rule):
        self.rank, self.order, self.pattern, self.needs, self.check = rank, order, compiled(source), gates(source), rule.validate
        self.grouped = self.pattern.groups == 1
        self.reach = reach(source) if self.grouped else None
        self.guard = dict(rule.guards).get(order)
        self.resume = 0

    def _from(self, text: str, floor: int) -> int:
        """Where a prefix begins at the earliest whose value begins at floor or later: those inside of a span that was taken are passed over."""
        at = min(self.resume, floor)
        if self.reach is None or floor - at <= NEAR:
            return at
        most, free = self.reach
        x = floor
        while x > at:
            c = text[x - 1]
            if c < "\x80" and c not in free:
                if not most:
                    break
                most -= 1
            x -= 1
        return x

    def seek(self, text: str, floor: int, guards: dict) -> tuple[int, int] | None:
        """The span of the first value that begins at floor or later. A prefix may begin before it."""
        at = self._from(text, floor) if self.grouped else floor
        while m := self.pattern.search(text, at):
            start, stop = m.span(1) if self.grouped and m.start(1) >= 0 else m.span()
            if start >= floor and (self.guard is None or self._holds(text, start, guards)):
                self.resume = start
                return start, stop
            at = max(start, m.start() + 1)
            if at > len(text):
                break
        return None

    def _holds(self, text: str, start: int, guards: dict) -> bool:
        if self.guard not in guards:
            guards[self.guard] = self.guard(text)
        return guards[self.guard](start)


class Literals:
    """The next value of a list in a text: an automaton finds all of them in one pass, the longest counts at each place."""

    __slots__ = ("rank", "order", "needs", "check", "resume", "automaton")

    def __init__(self, rank: int, rule: Rule):
        import ahocorasick

        self.rank, self.order, self.needs, self.check, self.resume = rank, -1, (), rule.validate, 0
        self.automaton = ahocorasick.Automaton()
        for value in rule.literals:
            self.automaton.add_word(value, len(value))
        self.automaton.make_automaton()

    def seek(self, text: str, floor: int, found: dict) -> tuple[int, int] | None:
        """The span of the first value that begins at floor or later; `found` keeps a text's values."""
        if self not in found:
            longest: dict[int, int] = {}
            for last, n in self.automaton.iter(text):  # longer ones end later
                longest[last + 1 - n] = last + 1
            starts = sorted(longest)
            found[self] = starts, [longest[a] for a in starts]
        starts, stops = found[self]
        k = bisect_left(starts, floor)
        return (starts[k], stops[k]) if k < len(starts) else None


class Scanner:
    """Values and replacements of lines."""

    def __init__(self, settings: Settings):
        self.settings, self.rules, self.json = settings, settings.rules, settings.json
        self.allowed = settings.allow.matcher()
        self.resolve = KeyResolver(list(settings.rules))
        self.cursors = [Cursor(rank, k, p, rule) for rank, rule in enumerate(settings.rules) for k, p in enumerate(rule.patterns)]
        self.cursors += [Literals(rank, rule) for rank, rule in enumerate(settings.rules) if rule.literals]
        self.token = Tokens(settings).token
        #: Characters that gates ask for; of those that a text has, which cursors may find something.
        self.telling = frozenset().union(*(n for c in self.cursors for n in c.needs))
        self.open: dict[frozenset[str], list[int]] = {}

    def _open(self, text: str) -> list[int]:
        """Numbers of the cursors whose gates a text passes; lines of one kind have the same few telling characters."""
        has = self.telling.intersection(text)
        found = self.open.get(has)
        if found is None:
            if len(self.open) >= 10_000:
                self.open.clear()
            found = self.open[has] = [i for i, c in enumerate(self.cursors) if not any(n.isdisjoint(has) for n in c.needs)]
        return found

    def taken(self, text: str) -> list[tuple[int, int, int, str, str]]:
        """(start, stop, rule, value, quotes to put around its token) of what is redacted, in order."""
        keyed = fields.keyed_pairs(text, self.resolve) if self.json else []
        shown = text
        if keyed:
            parts, at = [], 0
            for start, stop, *_ in keyed:
                parts += (text[at:start], " " * (stop - start))
                at = stop
            shown = "".join([*parts, text[at:]])
        heap, guards = [], {}
        for i in self._open(shown):
            c = self.cursors[i]
            c.resume = 0
            if (span := c.seek(shown, 0, guards)) is not None:
                heap.append((span[0], c.rank, c.order, span[1], i))
        heapq.heapify(heap)
        out, floor, k = [], 0, 0
        while heap or k < len(keyed):
            if k < len(keyed) and (not heap or keyed[k][0] <= heap[0][0]):
                start, stop, value, rule, quote = keyed[k]
                k += 1
                if not self.allowed(self.rules[rule].id, value):
                    out.append((start, stop, rule, value, quote))
                floor = stop
                continue
            start, rank, order, stop, i = heap[0]
            c = self.cursors[i]
            if start >= floor:
                if k < len(keyed) and stop > keyed[k][0]:
                    to = start + 1  # what a key names is not cut into
                else:
                    value = text[start:stop]
                    if (c.check is None or c.check(value)) and not self.allowed(self.rules[rank].id, value):
                        out.append((start, stop, rank, value, ""))
                    to = floor = max(stop, start + 1)
            else:
                to = floor
            span = c.seek(shown, to, guards) if to <= len(shown) else None
            if span is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (span[0], rank, order, span[1], i))
        return out

    def _around(self, line: str, start: int, stop: int, shift: int = 0) -> tuple:
        """(index, length, context before, context after) of a span of the line."""
        chars = self.settings.context_chars
        return start + shift, stop - start, *((line[max(0, start - chars) : start], line[stop : stop + chars]) if chars else (None, None))

    def _text(self, text: str, matches: list[tuple], around) -> str:
        """The text with tokens; its matches are added, around(start, stop) tells where they stand."""
        at, parts = 0, []
        for start, stop, rule, value, quote in self.taken(text):
            new = self.token(rule, value)
            parts += (text[at:start], quote, new, quote)
            at = stop
            matches.append((self.rules[rule].id, value, new, *around(start, stop)))
        return "".join([*parts, text[at:]]) if parts else text

    def _pieces(self, line: str):
        """(place, piece) of a line beyond the bound: cut behind the last white space of a piece's last characters, if there is one."""
        most, overlap, at = self.settings.max_line_chars, self.settings.overlap_chars, 0
        while len(line) - at > most:
            blank = max((line.rfind(c, at + most - overlap, at + most) for c in " \t"), default=-1)
            to = blank + 1 if blank >= 0 else at + most
            yield at, line[at:to]
            at = to
        yield at, line[at:]

    def line(self, line: str) -> tuple[str, bool, list[tuple]]:
        """(output, whether the line is JSON, matches). Places are those in the line, of what a JSON string decodes to as well."""
        matches: list[tuple] = []
        if len(line) > self.settings.max_line_chars:
            pieces = [self._text(piece, matches, lambda a, b, at=at, piece=piece: self._around(piece, a, b, at)) for at, piece in self._pieces(line)]
            return "".join(pieces), False, matches
        tree = fields.parse_json(line) if self.json else None
        if tree is None:
            return self._text(line, matches, lambda a, b: self._around(line, a, b)), False, matches

        def put(leaf: fields.Leaf, key, parent):
            number = isinstance(leaf.value, float)
            text = leaf.number() if number else leaf.value
            rule = None if key is None or text in fields.BLANK else self.resolve(key, parent)
            if rule is None:
                return leaf if number else self._text(text, matches, lambda a, b: self._around(line, leaf.place(a), leaf.place(b)))
            if self.allowed(self.rules[rule].id, text):
                return leaf
            new = self.token(rule, text)
            matches.append((self.rules[rule].id, text, new, *self._around(line, leaf.start, leaf.stop)))
            return new

        end = line[len(line.rstrip("\r\n")) :]
        end = end[-2:] if end.endswith("\r\n") else end[-1:]
        try:
            return fields.json_text(fields.walk(tree, put)) + end, True, matches
        except RecursionError:  # nested too deep to be written again: text like any other
            matches.clear()
            return self._text(line, matches, lambda a, b: self._around(line, a, b)), False, matches


class Tokens:
    """Replacements of values, with a bounded memory of those given."""

    def __init__(self, settings: Settings):
        key, rules = settings.key, settings.rules

        @lru_cache(maxsize=100_000)
        def token(rule: int, value: str) -> str:
            digest = hmac.new(key, f"{rules[rule].id}\0{value}".encode("utf-8", "surrogatepass"), hashlib.sha256)
            return f"<{rules[rule].prefix}:{digest.hexdigest()[:16]}>"

        self.token = token


class Once:
    """Made on first use, on each worker for itself."""

    def __init__(self, make, settings: Settings):
        self.make, self.settings, self.made = make, settings, None

    def __call__(self):
        if self.made is None:
            self.made = self.make(self.settings)
        return self.made

    def __getstate__(self):
        return {"make": self.make, "settings": self.settings, "made": None}


_KINDS = {"rule_id": pa.string(), "original": pa.string(), "replacement": pa.string(), "index": pa.int32(), "length": pa.int32(), "seq": pa.int32(), "context_before": pa.string(), "context_after": pa.string()}


def _column(rows: list[tuple[str | None, bool, list[tuple]]]) -> pa.Array:
    """Struct array of (output, is_json, matches)."""
    sizes = np.fromiter((len(m) for _, _, m in rows), np.int32, len(rows))
    flat = [m for _, _, ms in rows for m in ms]
    ends = np.cumsum(sizes, dtype=np.int32)
    parts = dict(zip(("rule_id", "original", "replacement", "index", "length", "context_before", "context_after"), zip(*flat, strict=True) if flat else [()] * 7, strict=True))
    parts["seq"] = np.arange(len(flat), dtype=np.int32) - np.repeat(ends - sizes, sizes)
    each = pa.StructArray.from_arrays([pa.array(parts[n], k) for n, k in _KINDS.items()], names=list(_KINDS))
    matches = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), each)
    return pa.StructArray.from_arrays([pa.array([o for o, _, _ in rows], pa.string()), pa.array([j for _, j, _ in rows], pa.bool_()), matches], names=["output", "is_json", "matches"])


def redacted(text: Column, settings: Settings, lines_seen=None) -> Column:
    """Struct (output, is_json, matches) of a string column; a null has a null output and no matches. lines_seen: an accumulator to count on, once a task that ends."""
    scanner = Once(Scanner, settings)

    @F.arrow_udf(RESULT)
    def run(lines: pa.Array) -> pa.Array:
        if lines_seen is not None:
            lines_seen.add(len(lines))
        one = scanner().line
        return _column([(None, False, []) if line is None else one(line) for line in lines.to_pylist()])

    return run(F.make_valid_utf8(text))


def once(df: DataFrame, computed: Column, into: str) -> DataFrame:
    """df with a computed column, as the one item of an exploded array: conditions on it are not moved below, where they would compute it again; all others are."""
    others = "*" if into not in df.columns else [c for c in df.columns if c != into]
    out = df.select(*([others] if others == "*" else others), F.explode(F.array(computed)).alias(into))
    return out if others == "*" else out.select(*df.columns)


def redact(df: DataFrame, column: str, settings: Settings, into: str = "redacted") -> DataFrame:
    """df with a struct (output, is_json, matches) of its column."""
    return once(df, redacted(F.col(column), settings), into)
