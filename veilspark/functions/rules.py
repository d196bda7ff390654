"""Rules: what they hold, how they are checked, and how their patterns become Python's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import lru_cache

from ..errors import INVALID_OPTION, INVALID_RULE, SanitizerError

#: White space of the pattern language, inside a character class.
WHITE = r"\t\n\v\f\r \xa0  -     　﻿"

PSEUDO, MASK = "pseudo", "mask"

#: Values up to which each is a pattern of its own; characters of all that a list may have. Beyond a megabyte Spark broadcasts what goes with a function.
FEW_LITERALS, MOST_LITERAL_CHARS = 16, 32 << 20


@dataclass(frozen=True)
class Rule:
    """Patterns give a value as their only group, which ends the match, or as the whole match."""

    id: str
    label: str
    description: str
    mode: str = PSEUDO
    token: str | None = None
    patterns: tuple[str, ...] = ()
    aggressive: tuple[str, ...] = ()
    validate: Callable[[str], bool] | None = None
    json_keys: tuple[str, ...] = ()
    json_key_contains: tuple[str, ...] = ()
    #: (number of a pattern, function of a text that gives a test of where a value starts): what a look-behind of any length would ask.
    guards: tuple[tuple[int, Callable[[str], Callable[[int], bool]]], ...] = ()
    #: Values that are found as they are, the longest at a place; they come before patterns, and any number of them costs the same scan.
    literals: tuple[str, ...] = ()

    @property
    def prefix(self) -> str:
        return "R" if self.mode == MASK else self.token or self.id.upper() or "ID"


def python_pattern(source: str) -> str:
    """The pattern with ASCII classes, Unicode white space and an absolute end."""
    out, i, inside = [], 0, False
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            d = source[i + 1]
            out.append({"s": WHITE if inside else f"[{WHITE}]", "S": "\\S" if inside else f"[^{WHITE}]", "/": "/", "-": "\\-"}.get(d, c + d))
            i += 2
            continue
        if inside:
            inside = c != "]"
            c = "\\[" if c == "[" else c
        elif c == "[":
            inside = True
        elif c == "$":
            c = r"\Z"
        out.append(c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=4096)
def compiled(source: str):
    """Compiled pattern; the regex module where look-behind has no fixed width."""
    text = python_pattern(source)
    try:
        return re.compile(text, re.ASCII)
    except re.error:
        import regex

        return regex.compile(text, regex.ASCII | regex.VERSION0)


def _refuse(rule: object, what: str):
    raise SanitizerError(INVALID_RULE, f"rule {getattr(rule, 'id', rule)!r}: {what}")


def define_rule(rule: Rule) -> Rule:
    """The rule itself, once its shape is checked."""
    if not isinstance(rule.id, str) or not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", rule.id):
        _refuse(rule, "id has to be an identifier")
    for name in ("label", "description"):
        if not isinstance(getattr(rule, name), str) or not getattr(rule, name).strip():
            _refuse(rule, f"{name} has to be text")
    if rule.mode not in (PSEUDO, MASK):
        _refuse(rule, "mode is pseudo or mask")
    if rule.token is not None and not re.fullmatch(r"[A-Z][A-Z0-9]*", rule.token):
        _refuse(rule, "token has to be capital letters and digits")
    if not rule.patterns and not rule.aggressive and not rule.literals:
        _refuse(rule, "it has no patterns")
    for source in (*rule.patterns, *rule.aggressive):
        if not isinstance(source, str) or not source:
            _refuse(rule, "patterns have to be text")
        try:
            pattern = compiled(source)
        except Exception as e:
            raise SanitizerError(INVALID_RULE, f"rule {rule.id!r}: {source!r} is no pattern: {e}") from e
        if pattern.groups > 1 or pattern.groupindex:
            _refuse(rule, f"{source!r} may have one group, without a name")
    for name in ("json_keys", "json_key_contains"):
        if any(not isinstance(k, str) or not k.strip() for k in getattr(rule, name)):
            _refuse(rule, f"{name} have to be text")
    if rule.validate is not None and not callable(rule.validate):
        _refuse(rule, "validate has to be a function")
    return rule


def resolve_rules(selectors: Iterable[Rule | str], builtin: dict[str, Rule], extra: Iterable[Rule] = ()) -> list[Rule]:
    """Rules in order of priority; a rule of the same id takes the other's place."""
    from ..errors import UNKNOWN_RULE

    found: dict[str, Rule] = {}
    for selector in [*selectors, *extra]:
        if isinstance(selector, str):
            if selector not in builtin:
                raise SanitizerError(UNKNOWN_RULE, f"no rule {selector!r}")
            rule = builtin[selector]
        else:
            rule = define_rule(selector)
        found[rule.id] = rule
    return list(found.values())


def always_rule(values: Iterable[str] = (), patterns: Iterable[str] = (), rule_id: str = "custom", mode: str = PSEUDO, token: str | None = None) -> Rule | None:
    """A rule of literal values, longest first, and patterns; None if there are none."""
    literals = sorted({v.strip() for v in values if v.strip()}, key=lambda v: (-len(v), v))
    if sum(map(len, literals)) > MOST_LITERAL_CHARS:
        raise SanitizerError(INVALID_OPTION, f"values have more than {MOST_LITERAL_CHARS} characters: each worker holds them")
    few = len(literals) <= FEW_LITERALS
    sources = [*(map(re.escape, literals) if few else ()), *patterns]
    if not literals and not sources:
        return None
    return define_rule(Rule(rule_id, "Always redacted", "Values and patterns that are always redacted.", mode, token, tuple(sources), literals=() if few else tuple(literals)))


@dataclass(frozen=True)
class AllowList:
    """Values that stay: exact ones, anchored patterns, exact ones of one rule."""

    values: frozenset[str] = frozenset()
    patterns: tuple[str, ...] = ()
    by_rule: dict[str, frozenset[str]] = field(default_factory=dict)

    def matcher(self) -> Callable[[str, str], bool]:
        anchored = [compiled(p) for p in self.patterns]
        by_rule = self.by_rule
        values = self.values
        if not (values or anchored or by_rule):
            return lambda rule, value: False
        return lambda rule, value: value in values or value in by_rule.get(rule, ()) or any(p.fullmatch(value) for p in anchored)


def normal_key(key: str) -> str:
    return re.sub(rf"[-_.{WHITE}]", "", key.lower())


class KeyResolver:
    """The rule that a field name asks for: with its parent, then by itself, then by a part of it."""

    def __init__(self, rules: list[Rule]):
        self.exact: dict[str, int] = {}
        self.parts: list[tuple[str, int]] = []
        for i, rule in enumerate(rules):
            for key in rule.json_keys:
                self.exact.setdefault(normal_key(key), i)
            self.parts += [(normal_key(p), i) for p in rule.json_key_contains]
        self.known: dict[tuple[str, str | None], int | None] = {}

    def __call__(self, key: str, parent: str | None = None) -> int | None:
        at = (key, parent)
        if at not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            self.known[at] = self._find(key, parent)
        return self.known[at]

    def _find(self, key: str, parent: str | None) -> int | None:
        above, dot, own = key.rpartition(".")
        leaf, scope = normal_key(own), above if dot else parent
        if not leaf:
            return None
        if scope is not None and (hit := self.exact.get(normal_key(scope.rpartition(".")[2]) + leaf)) is not None:
            return hit
        if leaf in self.exact:
            return self.exact[leaf]
        return next((i for part, i in self.parts if part in leaf), None)


def with_patterns(rule: Rule, aggressive: bool) -> Rule:
    return replace(rule, patterns=(*rule.patterns, *rule.aggressive)) if aggressive else rule
