"""Token-id output: fixed-size blocks of ids, transposed into planes, each plane compressed.

A shard holds whole documents in ascending order of their identifiers. Its body:
magic, then the compressed planes of each block; behind them the chunk index, whose
place is in the last eight bytes. An entry of the index: ids in the block, planes,
and each plane's length. Planes are those of bytes (eight bits of every id) or of bits.
Shards are rows of a table in the shared folder, so any store that Spark writes holds them.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, kept_for_run, shared_dir
from .word_ids import default_words, slices, word_encoder

MAGIC = b"VSPLANE1"

#: Ids of a block and, at least, of a shard (the last document of a shard is whole).
BLOCK_IDS, SHARD_IDS = 65_536, 1 << 20


def write_shard(ids: np.ndarray, block: int = BLOCK_IDS, planes: str = "byte", level: int = 1) -> bytes:
    import zstandard

    packer = zstandard.ZstdCompressor(level=level)
    body, index = [MAGIC], []
    for k in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[k : k + block], dtype="<u4")
        lanes = part.view(np.uint8).reshape(-1, 4).T
        if planes == "bit":
            lanes = np.packbits(np.unpackbits(np.ascontiguousarray(lanes), axis=1, bitorder="little").reshape(4, -1, 8).transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")
        used = max((i + 1 for i in range(len(lanes)) if lanes[i].any()), default=0)
        packed = [packer.compress(np.ascontiguousarray(lanes[i]).tobytes()) for i in range(used)]
        body += packed
        index.append(struct.pack(f"<II{used}I", len(part), used, *map(len, packed)))
    at = sum(map(len, body))
    return b"".join([*body, struct.pack("<IIB", len(index), len(ids) & 0xFFFFFFFF, planes == "bit"), *index, struct.pack("<Q", at)])


def read_shard(shard) -> np.ndarray:
    import zstandard

    shard = memoryview(shard)
    if bytes(shard[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a shard of token ids")
    opener = zstandard.ZstdDecompressor()
    (at,) = struct.unpack_from("<Q", shard, len(shard) - 8)
    blocks, _, bits = struct.unpack_from("<IIB", shard, at)
    at += 9
    place, out = len(MAGIC), []
    for _ in range(blocks):
        n, used = struct.unpack_from("<II", shard, at)
        sizes = struct.unpack_from(f"<{used}I", shard, at + 8)
        at += 8 + 4 * used
        width = (n + 7) // 8 if bits else n
        lanes = np.zeros((32 if bits else 4, width), np.uint8)
        for i, size in enumerate(sizes):
            lanes[i] = np.frombuffer(opener.decompress(shard[place : place + size], max_output_size=width), np.uint8)
            place += size
        if bits:
            lanes = np.packbits(np.unpackbits(lanes, axis=1, count=n, bitorder="little").reshape(4, 8, n).transpose(0, 2, 1).reshape(4, -1), axis=1, bitorder="little")
        out.append(np.ascontiguousarray(lanes.T).view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4")


#: first: ids before the shard in its part.
_SHARDS = "part long, shard long, first long, n_ids long, docs array<bigint>, lengths array<bigint>, body binary"


def write_token_files(docs: DataFrame, at: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, planes: str = "byte") -> None:
    """Encodes each whole text, appends end_id, and writes shards at `at` in ascending order of identifiers.

    Null texts count as empty and have the end id alone. A null identifier comes first.
    Rows that repeat an identifier are all written, in the order of a hash of their texts,
    by which an identifier with very many rows is dealt over partitions too. An empty
    table gives an empty folder with a schema. Other columns of docs are not written, so
    that none can clash. Nothing but the order needs a shuffle: Spark range-partitions by
    identifier, each task writes its own shards.
    """
    tokenizer = tokenizer or default_words()

    def run(batches):
        from pyspark import TaskContext

        part, shard, first = TaskContext.get().partitionId(), 0, 0
        enc = word_encoder(tokenizer)
        idents, lengths, body, n = [], [], [], 0

        def out():
            nonlocal shard, first, idents, lengths, body, n
            row = [[part], [shard], [first], [n], [pa.concat_arrays(idents)], [np.concatenate(lengths)], [write_shard(np.concatenate(body), planes=planes)]]
            shard, first, idents, lengths, body, n = shard + 1, first + n, [], [], [], 0
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "shard", "first", "n_ids", "docs", "lengths", "body"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, stops = enc.with_end(batch.column(1), end_id)
                idents.append(batch.column(0))
                lengths.append(np.diff(stops, prepend=0))
                body.append(ids)
                n += len(ids)
                if n >= SHARD_IDS:
                    yield out()
        if idents:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(run, _SHARDS).write.option("compression", "none").parquet(at)


def _read(spark, at: str, columns, schema: str) -> DataFrame:
    """Documents from the shards; columns(ids of a shard, places behind each document's last id) gives what follows doc_id and start.

    A shard carries its place within its part, so only the ids before each part are
    handed out: one row a partition of the writing job, which is what bounds the broadcast.
    """
    shards = spark.read.schema(_SHARDS).parquet(at)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("before"))
    placed = shards.join(F.broadcast(before), "part").select((F.col("before") + F.col("first")).alias("first"), "docs", "lengths", "body")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a shard at a time
                row = batch.slice(i, 1)
                ids, lengths = read_shard(row.column(3)[0].as_buffer()), row.column(2).flatten().to_numpy()
                stops = np.cumsum(lengths)
                added = columns(ids, stops)
                out = pa.RecordBatch.from_arrays([row.column(1).flatten(), pa.array(stops - lengths + row.column(0)[0].as_py()), *added.values()], names=["doc_id", "start", *added])
                for k in range(0, out.num_rows, 2048):
                    yield out.slice(k, 2048)

    return placed.mapInArrow(run, f"doc_id long, start long, {schema}")


def read_token_files(spark, at: str) -> DataFrame:
    """Rows (doc_id, start, ids binary) of every document, from the shards; start counts the ids of all documents before it."""

    def columns(ids: np.ndarray, stops: np.ndarray) -> dict[str, pa.Array]:
        places = pa.array(np.append(0, 4 * stops).astype(np.int64)).buffers()[1]
        return {"ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, places, pa.py_buffer(ids)]).cast(pa.binary())}

    return _read(spark, at, columns, "ids binary")


def read_token_digests(spark, at: str) -> DataFrame:
    """As read_token_files(), with n_tokens and ids_crc32 in place of the ids."""

    def columns(ids: np.ndarray, stops: np.ndarray) -> dict[str, pa.Array]:
        starts = np.append(0, stops[:-1])
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return {"n_tokens": pa.array(stops - starts), "ids_crc32": pa.array(crc, pa.int64())}

    return _read(spark, at, columns, "n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir) -> DataFrame:
    at = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), at)
    return read_token_digests(spark, kept_for_run(spark, at))
