"""Redaction of whole values below structs, arrays and maps, by the names of their fields.

A schema tells which leaves ask for a rule: a field by its parent and its own name, items
of an array by their array's, a map's values by their keys, row by row. One Arrow function
a column rewrites those leaves as arrays, each distinct value once a batch; what asks for
nothing is passed on as it is. Numbers become text with their token.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from ..functions.fields import BLANK, number_text
from ..functions.rules import KeyResolver


@dataclass(frozen=True)
class Leaf:
    rule: int


@dataclass(frozen=True)
class Struct:
    fields: tuple


@dataclass(frozen=True)
class Items:
    inner: object


@dataclass(frozen=True)
class Entries:
    """Values of a map: texts by their keys, others by their own names."""

    name: str
    inner: object


def planned(kind: T.DataType, resolve: KeyResolver, key: str | None, parent: str | None = None) -> tuple[object, T.DataType]:
    """(what to rewrite, or None; the type it becomes) of a value under a key."""
    if isinstance(kind, T.StructType):
        parts = [planned(f.dataType, resolve, f.name, key) for f in kind.fields]
        if not any(p is not None for p, _ in parts):
            return None, kind
        return Struct(tuple(p for p, _ in parts)), T.StructType([T.StructField(f.name, t, f.nullable, f.metadata) for f, (_, t) in zip(kind.fields, parts, strict=True)])
    if isinstance(kind, T.ArrayType):
        inner, made = planned(kind.elementType, resolve, key, parent)
        return (None, kind) if inner is None else (Items(inner), T.ArrayType(made, kind.containsNull))
    if isinstance(kind, T.MapType):
        if isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StringType):
            return Entries(key or "", None), kind
        inner, made = planned(kind.valueType, resolve, None)
        return (None, kind) if inner is None else (Entries(key or "", inner), T.MapType(kind.keyType, made, kind.valueContainsNull))
    if key is not None and isinstance(kind, (T.StringType, T.NumericType)) and (rule := resolve(key, parent)) is not None:
        return Leaf(rule), T.StringType()
    return None, kind


def text_of(value) -> str:
    if isinstance(value, float):
        return number_text(value) if np.isfinite(value) else str(value)
    return format(value.normalize(), "f") if isinstance(value, Decimal) else str(value)


def rewritten(array: pa.Array, plan, resolve: KeyResolver, replaced: Callable[[int, str], str]) -> pa.Array:
    """The array with its planned leaves replaced; nulls stay."""
    if plan is None:
        return array
    if array.offset:
        array = array.take(pa.array(np.arange(len(array))))
    if isinstance(plan, Leaf):
        coded = array.dictionary_encode()
        new = [t if (t := text_of(v)) in BLANK else replaced(plan.rule, t) for v in coded.dictionary.to_pylist()]
        return pa.array(new, pa.string()).take(coded.indices)
    none = array.is_null()
    if isinstance(plan, Struct):
        parts = [rewritten(a, p, resolve, replaced) for a, p in zip(array.flatten(), plan.fields, strict=True)]
        return pa.StructArray.from_arrays(parts, fields=[pa.field(f.name, a.type, True) for f, a in zip(array.type, parts, strict=True)], mask=none)
    missing = np.append(none.to_numpy(zero_copy_only=False), False)
    offsets = pa.array(array.offsets.to_numpy(), pa.int32(), mask=missing)
    if isinstance(plan, Items):
        return pa.ListArray.from_arrays(offsets, rewritten(array.values, plan.inner, resolve, replaced))
    items = array.items
    if plan.inner is not None:
        items = rewritten(items, plan.inner, resolve, replaced)
    else:
        rules = {k: resolve(k, plan.name) for k in array.keys.unique().to_pylist()}
        if any(r is not None for r in rules.values()):
            new = [v if (r := rules[k]) is None or v is None or v in BLANK else replaced(r, v) for k, v in zip(array.keys.to_pylist(), items.to_pylist(), strict=True)]
            items = pa.array(new, pa.string())
    return pa.MapArray.from_arrays(offsets, array.keys, items)
