"""Hashes that chunks of documents send to meet in ranges, packed, and the bits that they hear back.

A chunk sends each of its hashes once, ascending, a row a range; within a row differences
are stored as planes of bytes. A hash that every chunk has is one number of each chunk
like any other, so no key is larger than the rest. An answer has one bit for each hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose hashes meet in one range, about.
RANGE_BYTES = 16 << 20


def ranges_for(chunks: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Ranges for a table of chunks: they grow with the text, so that one stays as large as it is."""
    return max(1, -(-(chunks.agg(F.sum("size").alias("n")).first().n or 0) // range_bytes))


def cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Places of ascending hashes where each range begins, and their end."""
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.append(0, np.append(np.searchsorted(hashes, bounds), len(hashes)))


def spans(hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the ranges that have hashes."""
    c = cuts(hashes, ranges)
    return [(int(r), int(c[r]), int(c[r + 1])) for r in np.flatnonzero(c[1:] > c[:-1])]


def planes(values: np.ndarray) -> bytes:
    """Words of eight bytes, as planes of bytes: the high ones of small numbers pack to nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unplanes(packed: bytes, n: int) -> np.ndarray:
    import zstandard

    lanes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(lanes.T).view(np.uint64).ravel()


def ascending(hashes: np.ndarray) -> bytes:
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unascending(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(packed, n), dtype=np.uint64)


def bits_of(yes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Packed bits of consecutive parts."""
    ends = np.cumsum(sizes)
    return pa.array([np.packbits(yes[e - k : e]).tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())


def heard(hashes: np.ndarray, told: pa.Table, ranges: int, bits: str = "bits") -> np.ndarray:
    """The bits that answer a chunk's ascending hashes, put together again; ranges without an answer have none set."""
    c, out = cuts(hashes, ranges).tolist(), np.zeros(len(hashes), bool)
    for r, b in zip(told.column("range").to_pylist(), told.column(bits).to_pylist(), strict=True):
        if b is not None:
            out[c[r] : c[r + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=c[r + 1] - c[r])
    return out


def at_level(told: pa.Table, level: int) -> pa.Table:
    return told.filter(pc.equal(told.column("level"), level))
