"""Exact deduplication by Patricia tries.

Texts are equal when identical after each run of white space is replaced by one
space. Each task first inserts its texts into a compressed radix trie of its own,
so a group of copies leaves a task as one string however large it is. The strings
that are left go to partitions by length and content hash; each partition owns one
trie of all its strings. Terminal nodes hold the smallest identifier and the number of
rows. A trie that grows beyond its bound emits its heaviest subtrees and drops them: in a
task's own trie they may come again, and the owner adds them up; an owner gets its
strings in the order of length and hash, so all but the last one is final.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WS, documents, free_name, whole_text
from .word_ids import slices

#: Bytes of labels and nodes that a trie may hold before its heaviest subtrees are emitted, and bytes of a node.
TRIE_BYTES, NODE_BYTES = 12 << 20, 200


class Patricia:
    """Compressed radix trie of byte strings; a terminal holds [smallest id, rows, hash]."""

    __slots__ = ("root", "size")

    def __init__(self):
        self.root: list = [b"", {}, None]  # label, children by first byte, terminal
        self.size = 0

    def insert(self, key: bytes, ident, rows: int, hashed: int = 0) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.size += end - at + NODE_BYTES
                node, at = child, end
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _shared(label, key, at)
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = upper
            self.size += NODE_BYTES
            node, at = upper, at + same
        if node[2] is None:
            node[2] = [ident, rows, hashed]
        else:
            if ident is not None and (node[2][0] is None or ident < node[2][0]):
                node[2][0] = ident
            node[2][1] += rows

    def items(self):
        """(string, smallest id, rows, hash) of all terminals."""
        return _below(self.root, b"")

    def spill(self, to: int, keep: bytes | None = None):
        """Emits and drops the heaviest subtrees that are not on the way to `keep` until at most `to` bytes are held, or nothing else is left."""
        node, prefix, at, aside = self.root, b"", 0, []
        while node is not None:
            on = node[1].get(keep[at]) if keep is not None and at < len(keep) else None
            aside += [(_weight(child), node, b, prefix) for b, child in node[1].items() if child is not on]
            if on is not None:
                prefix, at = prefix + on[0], at + len(on[0])
            node = on
        for weight, parent, b, before in sorted(aside, key=lambda x: -x[0]):
            if self.size <= to:
                break
            yield from _below(parent[1].pop(b), before)
            self.size -= weight


def _below(node: list, prefix: bytes):
    """Terminals of a subtree whose labels begin behind prefix."""
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        key = prefix + node[0]
        if node[2] is not None:
            yield key, *node[2]
        stack.extend((child, key) for child in node[1].values())


def _weight(node: list) -> int:
    """Bytes that a subtree holds."""
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += len(node[0]) + NODE_BYTES
        stack.extend(node[1].values())
    return total


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:]; they differ somewhere or key ends first."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key[at + low : at + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


_STRINGS = "size long, hash long, text binary, least long, n long"
_OWNERS = "sha binary, keep_id long, group_size long"


def _out(rows: list) -> pa.RecordBatch:
    size, hashes, text, least, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(size, pa.int64()), pa.array(hashes, pa.int64()), pa.array(text, pa.binary()), pa.array(least, pa.int64()), pa.array(n, pa.int64())],
        names=["size", "hash", "text", "least", "n"],
    )


def _batched(rows, most_bytes: int = 4 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size >= most_bytes:
            yield _out(held)
            held, size = [], 0
    if held:
        yield _out(held)


def _combine(batches, trie_bytes: int):
    """A task's own trie: each distinct string leaves it once, more often only after a spill."""

    def rows():
        trie = Patricia()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for hashed, text, ident in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    trie.insert(text, ident, 1, hashed)
                if trie.size > trie_bytes:
                    yield from trie.spill(trie_bytes // 2)
        yield from trie.items()

    yield from _batched((len(key), hashed, key, ident, n) for key, ident, n, hashed in rows())


def _own(batches, trie_bytes: int):
    """The trie of a partition's strings, which come in the order of (size, hash, text): equal ones follow each other."""
    trie, held = Patricia(), []
    for part in (part for batch in batches for part in slices(batch, "text", 2 << 20)):
        for text, least, n in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            trie.insert(text, least, n)
            if trie.size > trie_bytes:
                held.extend((hashlib.sha256(k).digest(), i, c) for k, i, c, _ in trie.spill(trie_bytes // 2, text))
                if len(held) >= 10_000:
                    yield _owners(held)
                    held = []
    held.extend((hashlib.sha256(k).digest(), i, c) for k, i, c, _ in trie.items())
    if held:
        yield _owners(held)


def _owners(held):
    sha, least, n = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(least, pa.int64()), pa.array(n, pa.int64())], names=["sha", "keep_id", "group_size"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 of the normalised text.

    Null texts count as empty, and all empty texts are equal; a text of white space
    alone normalises to one space and equals others like it, not the empty one. A null
    identifier is larger than any other; a group of null identifiers alone keeps each
    of its rows. Rows that repeat an identifier and its text all count and all stay if
    that identifier stays. An empty table gives an empty table. Added columns take
    underscores if docs has their names already.
    """
    names = {c: free_name(docs, c) for c in ("keep_id", "group_size", "kept", "text_sha256")}
    norm = F.regexp_replace(whole_text(text_col), WS, " ")
    sides = docs.select(F.xxhash64(norm).alias("hash"), norm.cast("binary").alias("text"), F.col(id_col).cast("long").alias("least"))
    strings = sides.mapInArrow(functools.partial(_combine, trie_bytes=trie_bytes), _STRINGS)
    owners = strings.repartition("size", "hash").sortWithinPartitions("size", "hash", "text").mapInArrow(functools.partial(_own, trie_bytes=trie_bytes), _OWNERS)
    sha = free_name(docs, "sha")
    keyed = docs.withColumn(names["text_sha256"], F.sha2(norm.cast("binary"), 256)).withColumn(sha, F.unhex(names["text_sha256"]))
    owners = owners.select(F.col("sha").alias("sha__owner"), F.col("keep_id").alias(names["keep_id"]), F.col("group_size").alias(names["group_size"]))
    joined = keyed.join(owners, F.col(sha) == F.col("sha__owner")).drop(sha, "sha__owner")
    return joined.withColumn(names["kept"], F.col(id_col).eqNullSafe(F.col(names["keep_id"])))


def op1_exact_dedup(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
