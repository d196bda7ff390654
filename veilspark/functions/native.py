"""Checks and tokens as column expressions: for tables and for audits, in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a binary column, in hexadecimal. The key is in the plan: for tests and public keys; Sanitizer keeps its key out."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def token(key: bytes, rule_id: str, prefix: str, value: Column) -> Column:
    message = F.concat(F.lit(rule_id + "\0").cast("binary"), value.cast("binary"))
    return F.concat(F.lit(f"<{prefix}:"), F.substring(hmac_hex(key, message), 1, 16), F.lit(">"))


def luhn(digits: Column) -> Column:
    """Luhn check of digits that are not all zero."""
    return F.call_function("luhn_check", digits) & ~digits.rlike("^0+$")


def mod97(text: Column) -> Column:
    """Remainder by 97 of an account number: first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))

    def step(r: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (r * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(F.upper(moved), ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.coalesce(F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s - part(c) * F.log2(part(c))), F.lit(0.0))


def reserved_ipv4(ip: Column) -> Column:
    """Loopback, this network, link-local, multicast, or bits like a netmask's."""
    o = F.transform(F.split(ip, r"\."), lambda x: x.cast("int"))
    bits = F.array_join(F.transform(o, lambda x: F.lpad(F.bin(x), 8, "0")), "")
    return o[0].isin(0, 127) | ((o[0] == 169) & (o[1] == 254)) | o[0].between(224, 239) | ~bits.contains("01")


def normal_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.\s]", "")


def looks_like_json(line: Column) -> Column:
    return F.trim(line).rlike(r"^[\[{]")
