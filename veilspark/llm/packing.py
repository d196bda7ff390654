"""Best-fit packing by linear grouping.

The plan needs only how many pieces each length has: at most `capacity` counts, however
many documents there are. Large lengths, in descending order, are cut into groups of
equal cardinality and rounded up to the largest of their group; configurations of these
few sizes are chosen fullest first and repeated as often as the counts allow. Actual
lengths then take the rounded places, largest first, which gives back what rounding
took, and small lengths go best-fit into what room is left. The pieces of a length are
numbered and find their places by number, so no task sees more than its own rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, documents
from .word_ids import default_words, slices, word_encoder

CAPACITY = 2048


class Plan:
    """Runs (length, first number, pieces, first sequence, offset): number first+i of the length goes to sequence first sequence+i."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        #: Room left -> spans (first sequence, sequences), all with that room.
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.placed: dict[int, int] = {}

    def _put(self, length: int, first: int, n: int, offset: int) -> None:
        number = self.placed.get(length, 0)
        self.runs.append((length, number, n, first, offset))
        self.placed[length] = number + n

    def open(self, sizes: list[list[tuple[int, int]]], n: int) -> None:
        """n new sequences; sizes: for each place of the configuration, spans (length, pieces) that fill it in all n."""
        cuts = sorted({0, n, *(sum(c for _, c in place[: i + 1]) for place in sizes for i in range(len(place)))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for place in sizes:
                at = 0
                for length, c in place:
                    if at <= a < at + c:
                        self._put(length, self.sequences + a, b - a, offset)
                        offset += length
                        break
                    at += c
            self.room.setdefault(self.capacity - offset, []).append((self.sequences + a, b - a))
        self.sequences += n

    def best_fit(self, counts: np.ndarray, lengths) -> None:
        """Places counts[length] pieces of each length into the least room that takes it, else into new sequences."""
        for length in lengths:
            left = int(counts[length])
            while left:
                fit = min((r for r in self.room if r >= length), default=None)
                if fit is None:
                    each = self.capacity // length
                    n = max(1, left // each)
                    take = min(each, left)
                    first = self.sequences
                    for k in range(take):
                        self._put(length, first, n, k * length)
                    self.sequences += n
                    left -= n * take
                    self.room.setdefault(self.capacity - take * length, []).append((first, n))
                    continue
                first, n = self.room[fit].pop()
                if not self.room[fit]:
                    del self.room[fit]
                take = min(n, left)
                self._put(length, first, take, self.capacity - fit)
                left -= take
                self.room.setdefault(fit - length, []).append((first, take))
                if take < n:
                    self.room.setdefault(fit, []).append((first + take, n - take))
            counts[length] = 0


def _fullest(sizes: list[int], counts: dict[int, int], capacity: int) -> list[int]:
    """Configuration that starts with the largest size left and fills the rest as far as it can."""
    room = capacity - sizes[0]
    best: dict[int, list[int]] = {0: []}
    for s in sizes:
        if s > room:
            continue
        most = min(counts[s] - (s == sizes[0]), room // s)
        for total, picked in list(best.items()):
            for k in range(1, most + 1):
                if total + k * s > room:
                    break
                best.setdefault(total + k * s, [*picked, *[s] * k])
        if room in best:
            break
    return [sizes[0], *best[max(best)]]


def _grouped(counts: np.ndarray, capacity: int, groups: int, large: int) -> Plan:
    plan, counts = Plan(capacity), counts.copy()
    lengths = [n for n in range(capacity, large - 1, -1) if counts[n]]
    total = int(sum(counts[n] for n in lengths))
    if total:
        each = -(-total // groups)
        # Groups of equal cardinality over the sorted lengths; a length may be in two of them.
        spans: list[list] = []  # [rounded size, [(length, pieces)]]
        have = 0
        for n in lengths:
            c = int(counts[n])
            while c:
                if not spans or have == each:
                    spans.append([n, []])
                    have = 0
                take = min(c, each - have)
                spans[-1][1].append([n, take])
                have += take
                c -= take
        by_size: dict[int, list] = {}
        for size, parts in spans:
            by_size.setdefault(size, []).extend(parts)
        left = {s: sum(c for _, c in parts) for s, parts in by_size.items()}
        while left:
            sizes = sorted(left, reverse=True)
            shape = _fullest(sizes, left, capacity)
            need = {s: shape.count(s) for s in set(shape)}
            times = min(left[s] // k for s, k in need.items())
            places = []
            for s in shape:  # actual lengths take the rounded places, largest first
                place, want = [], times
                while want:
                    part = by_size[s][0]
                    take = min(part[1], want)
                    place.append((part[0], take))
                    part[1] -= take
                    want -= take
                    if not part[1]:
                        by_size[s].pop(0)
                places.append(place)
                left[s] -= times
                if not left[s]:
                    del left[s]
            plan.open(places, times)
        for n in lengths:
            counts[n] = 0
    plan.best_fit(counts, [n for n in range(large - 1, 0, -1) if counts[n]])
    return plan


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The plan with fewest sequences over several numbers of groups; counts[n]: pieces of length n."""
    plans = [_grouped(counts, capacity, groups, max(2, capacity // part)) for groups in (32, 128, 512) for part in (8, 4, 2)]
    return min(plans, key=lambda p: (p.sequences, len(p.runs)))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, number): each document's ids and its end id, cut only where longer than capacity.

    number counts the pieces of a length in the partition `part`, from 0.
    """
    tokenizer = tokenizer or default_words()

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc = word_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, stops = enc.with_end(batch.column(1), end_id)
                sizes = np.diff(stops, prepend=0)
                times = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), times)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                at = (stops - sizes)[doc] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(doc), part, np.int64)), pa.array(_numbered(length, seen))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"{_PIECES}, part long, number long")


def _numbered(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each piece among those of its length; seen[n]: how many came before, brought up to date."""
    order = np.argsort(length, kind="stable")
    mine = length[order]
    head = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else order
    sizes = np.diff(np.append(head, len(mine)))
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(mine)) - np.repeat(head, sizes) + seen[mine]
    seen[mine[head]] += sizes
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null texts count as empty and have the end id alone. Rows that repeat an identifier
    are packed each for itself; null identifiers are packed too. An empty table gives no
    rows. Other columns of docs are left out, so that none can clash. Pieces of one length
    are equal to the plan; they take its places in the order of the partitions they are in.
    """
    rows = cut(pieces(docs, id_col, text_col, tokenizer, end_id, capacity))
    # A row for each length and partition, however many pieces a length has; the plan sees a row a length.
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = cut(counts.select("length", "part", "n", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")))
    table = np.zeros(capacity + 1, np.int64)
    for length, n in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows, whatever the input
        table[length] = n
    runs = np.array(sorted(plan_packing(table, capacity).runs), np.int64).reshape(-1, 5)
    # Lengths and numbers in one ascending key; a length has fewer than 2**48 pieces.
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches):
        for batch in batches:
            length, number, skip = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            number = number + skip
            run = runs[np.searchsorted(keys, (length << 48) + number, side="right") - 1] if len(length) else runs[:0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + number - run[:, 1]), pa.array(run[:, 4].copy())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = rows.join(before.drop("n"), ["length", "part"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "number", "before").mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir) -> DataFrame:
    return pack(documents(spark, sf_dir))
