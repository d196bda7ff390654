"""What the operators of this subpackage share: the shared folder, chunks of documents, small helpers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir, shuffles_freed  # noqa: F401
from .word_ids import slices

#: Bytes of text that one chunk of documents holds (a longer document is a chunk of its own).
CHUNK_BYTES = 4 << 20

#: Runs of the white space that every contract of this subpackage means.
WS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept_for_run(spark: SparkSession, at: str) -> str:
    """Marks a path of the shared folder for removal when the application ends: what reads it may come later than this call."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it: column pruning holds on what follows."""
    at = f"{shared_dir(df.sparkSession)}/veilspark-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", codec).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(kept_for_run(df.sparkSession, at))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def tidy() -> None:
    """Hands memory that a worker no longer uses back to the system: workers stay, also between stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Each value's UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def chunks_of(batches, text: str, chunk_bytes: int = CHUNK_BYTES):
    """Record batches of whole documents, about chunk_bytes of text each; the order of rows stays."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_pylist()
        start = 0
        for i, n in enumerate(sizes):
            size += n + 64
            if size >= chunk_bytes:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def chunked(docs: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (chunk long, size long, blob binary): documents packed a chunk a row, in a table bucketed by chunk in the shared folder.

    Later steps meet their chunk again by its number without moving it: only their
    messages, which are keyed by chunk and not by document, are shuffled. size: bytes of
    text. A retried task may number its chunks anew only before the table is written.
    Bucketing needs a name in the catalog, which is dropped as soon as the table is read.
    """

    def pack(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(chunks_of(batches, text, chunk_bytes)):
            size = pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(text)))).as_py() or 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_batch(batch)], pa.binary())],
                names=["chunk", "size", "blob"],
            )

    spark = docs.sparkSession
    name = f"veilspark_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(pack, "chunk long, size long, blob binary").repartition(buckets, "chunk")
    at = f"{shared_dir(spark)}/{name}"
    rows.write.format("parquet").option("compression", "none").option("path", at).bucketBy(buckets, "chunk").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    kept_for_run(spark, at)
    return table


def split_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(words of each text, distinct words, their numbers in order); a word is a run without ASCII white space. lower: A-Z lowered."""
    some, coded = [], []
    for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
        texts = part.column(0).cast(pa.large_string()).fill_null("")
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy: kernels of strings may take a slice's offsets wrongly
        split = pc.ascii_split_whitespace(texts)
        words, n = split.flatten(), np.diff(split.offsets.to_numpy())
        full = pc.greater(pc.binary_length(words), 0)
        if not pc.all(full, min_count=0).as_py():  # white space at an end gives an empty string
            n = n - np.bincount(np.repeat(np.arange(len(n)), n)[~full.to_numpy(zero_copy_only=False)], minlength=len(n))
            words = words.filter(full)
        some.append(n)
        coded.append(words.dictionary_encode())
    if not coded:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int32)
    names = pa.concat_arrays([c.dictionary for c in coded])
    whole = (pc.ascii_lower(names) if lower else names).dictionary_encode()
    number, at, first = whole.indices.to_numpy(), [], 0
    for c in coded:
        at.append(number[c.indices.to_numpy() + first])
        first += len(c.dictionary)
    return np.concatenate(some), whole.dictionary, np.concatenate(at)


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if not isinstance(column, pa.ChunkedArray):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def whole_text(text: str):
    """Null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def by_chunk(chunks: DataFrame, messages: DataFrame, answer, schema: str) -> DataFrame:
    """Meets each chunk with its messages (column chunk); answer(chunk number, documents, messages) gives a table of the schema."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("messages for a chunk that is not there")
        return answer(left.column("chunk")[0].as_py(), unpack_table(left.column("blob")[0].as_py()), right)

    return chunks.groupBy("chunk").cogroup(messages.groupBy("chunk")).applyInArrow(meet, schema)


def ddl(df: DataFrame, *added: str) -> str:
    """Schema string of df's columns and those added."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *added])
