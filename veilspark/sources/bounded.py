"""Files of lines, read in byte ranges with bounded memory, and written back file by file.

A file is cut at every range_bytes; a cut moves to the byte behind the next line feed,
which is looked for in windows that double up to max_probe_bytes, and is dropped where
there is none. A task finds its own two cuts, so planning reads no file. A line that goes
on beyond max_line_chars leaves in pieces, cut as the scan cuts long lines; a row tells
whether a line feed follows it, so the rows of a file in order are the file.

Writing is in two steps: tasks write parts of outputs, in order, under names of their own,
and one task a file puts its parts together and gives the whole its name. Parts of tasks
that are lost or run twice are in no list of parts, and a file is there whole or not at all.
"""

from __future__ import annotations

import codecs
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import INVALID_OPTION, SanitizerError
from .shared import cut

RANGE_BYTES, PROBE_BYTES, MAX_PROBE_BYTES = 64 << 20, 64 << 10, 16 << 20

#: Bytes that are read at once.
BLOCK = 1 << 20

SCHEMA = "source string, offset long, piece int, line string, ended boolean"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:").replace("//", "", 1) if path.startswith("file:") else path)
    return fs.LocalFileSystem(), path


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder in order; names that begin with a dot or an underscore are left out."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(at) :].split("/") if x)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


def snapped(file, size: int, at: int, probe: int = PROBE_BYTES, most: int = MAX_PROBE_BYTES) -> int | None:
    """The byte behind the first line feed at `at` or later; None if no window up to `most` bytes has one, or it ends the file."""
    if not 0 < at < size:
        return None
    seen, window = 0, probe
    while seen < most and at + seen < size:
        file.seek(at + seen)
        block = file.read(min(window, most) - seen)
        found = block.find(b"\n")
        if found >= 0:
            return at + seen + found + 1 if at + seen + found + 1 < size else None
        seen += len(block)
        window *= 2
    return None


def range_of(file, size: int, k: int, parts: int, probe: int = PROBE_BYTES, most: int = MAX_PROBE_BYTES) -> tuple[int, int] | None:
    """Bytes of part k of a file that is read in so many parts; None if its cut is dropped, for then the part before has them."""
    cut_at = lambda i: snapped(file, size, round(size * i / parts), probe, most)
    start = cut_at(k) if k else 0
    if start is None or size == 0:
        return None
    stop = next((c for i in range(k + 1, parts) if (c := cut_at(i)) is not None), size)
    return (start, stop) if start < stop else None


def line_ranges(file, size: int, parts: int, probe: int = PROBE_BYTES, most: int = MAX_PROBE_BYTES) -> list[tuple[int, int]]:
    """All byte ranges of a file: without gaps, each but the last ends behind a line feed."""
    check_ranges(parts, probe, most)
    return [r for k in range(parts) if (r := range_of(file, size, k, parts, probe, most))]


def check_ranges(parts: int, probe: int, most: int) -> None:
    if parts < 1 or probe < 1 or most < probe:
        raise SanitizerError(INVALID_OPTION, "parts and probe_bytes are 1 at least, max_probe_bytes is probe_bytes at least")


def first_piece(text: str, most: int, overlap: int) -> int:
    """Where a text beyond `most` characters is cut: behind the last white space of the piece's last `overlap` ones, if there is some."""
    blank = max((text.rfind(c, most - overlap, most) for c in " \t"), default=-1)
    return blank + 1 if blank >= 0 else most


def framed(file, start: int, stop: int, most: int, overlap: int):
    """(offset of the line, number of the piece, line or piece, whether a line feed follows) of a range; never holds more than a block and a piece."""
    file.seek(start)
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    at, offset, piece, held = start, start, 0, ""
    while at < stop:
        block = file.read(min(BLOCK, stop - at))
        if not block:
            break
        parts = block.split(b"\n")
        for k, part in enumerate(parts):
            ended = k < len(parts) - 1
            held += decoder.decode(part, ended)
            while len(held) > most:
                to = first_piece(held, most, overlap)
                yield offset, piece, held[:to], False
                piece, held = piece + 1, held[to:]
            at += len(part) + ended
            if ended:
                yield offset, piece, held, True
                offset, piece, held = at, 0, ""
    held += decoder.decode(b"", True)
    if held or not stop:
        yield offset, piece, held, False


@dataclass
class _Part(InputPartition):
    path: str
    size: int
    k: int
    parts: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        number = lambda name, value: int(options.get(name, value))
        self.path = options["path"]
        self.range_bytes, self.probe, self.most_probe = number("rangeBytes", RANGE_BYTES), number("probeBytes", PROBE_BYTES), number("maxProbeBytes", MAX_PROBE_BYTES)
        self.most, self.overlap = number("maxLineChars", 1 << 20), number("overlapChars", 1024)
        check_ranges(1, self.probe, self.most_probe)

    def partitions(self):
        return [_Part(path, size, k, n) for path, size in files_below(self.path) for n in [max(1, -(-size // self.range_bytes))] for k in range(n)]

    def read(self, part):
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as file:
            found = range_of(file, part.size, part.k, part.parts, self.probe, self.most_probe) if part.size else (0, 0)
            if found is None:
                return
            rows, size = [], 0
            for row in framed(file, *found, self.most, self.overlap):
                rows.append(row)
                size += len(row[2]) + 64
                if size >= BLOCK:
                    yield _batch(part.path, rows)
                    rows, size = [], 0
            if rows:
                yield _batch(part.path, rows)


def _batch(path: str, rows: list) -> pa.RecordBatch:
    offset, piece, line, ended = zip(*rows, strict=True)
    columns = [pa.array([path] * len(rows), pa.string()), pa.array(offset, pa.int64()), pa.array(piece, pa.int32()), pa.array(line, pa.string()), pa.array(ended, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["source", "offset", "piece", "line", "ended"])


class BoundedLines(DataSource):
    """Format `bounded_lines`: rows (source, offset, piece, line, ended)."""

    @classmethod
    def name(cls):
        return "bounded_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_bounded(spark: SparkSession, path: str, max_line_chars: int = 1 << 20, overlap_chars: int = 1024, range_bytes: int = RANGE_BYTES, probe_bytes: int = PROBE_BYTES, max_probe_bytes: int = MAX_PROBE_BYTES) -> DataFrame:
    """Rows (source, offset, piece, line, ended) of a file or of all files below a folder.

    Lines end at \\n alone, \\r stays; bytes that are no UTF-8 become U+FFFD. offset is where
    the line begins; a line beyond max_line_chars has several pieces. In the order of
    (source, offset, piece), lines, with \\n where ended is true, are the file; an empty file
    is one empty line without end.
    """
    from ..shipping import ship

    check_ranges(1, probe_bytes, max_probe_bytes)
    if range_bytes < 1 or not 0 <= overlap_chars < max_line_chars:
        raise SanitizerError(INVALID_OPTION, "range_bytes is 1 at least, overlap_chars is below max_line_chars")
    ship(spark)
    spark.dataSource.register(BoundedLines)
    told = {"rangeBytes": range_bytes, "probeBytes": probe_bytes, "maxProbeBytes": max_probe_bytes, "maxLineChars": max_line_chars, "overlapChars": overlap_chars}
    return spark.read.format("bounded_lines").options(**told).load(path)


def write_files(rows: DataFrame, root: str, target: str, part_rows: int = 1_000_000) -> DataFrame:
    """Writes rows (source, offset, piece, line, ended) as files below target, each where its source is below root. Gives (file, bytes, parts) of each.

    Rows may come in any order. A source that is root itself goes to target as a file of its name.
    """
    base = opened(root)[1].rstrip("/")
    scratch = f"{target.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    n = max(1, min(10_000, -(-rows.count() // part_rows)))
    placed = rows.select("source", "offset", "piece", "line", "ended").repartitionByRange(n, "source", "offset", "piece").sortWithinPartitions("source", "offset", "piece")

    def parts(batches):
        store, at = opened(scratch)
        store.create_dir(at, recursive=True)
        source, out, path, first = None, None, None, (0, 0)
        for batch in batches:
            for name, offset, piece, line, ended in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if name != source:
                    if out is not None:
                        size = out.tell()
                        out.close()
                        yield _told(source, first, path, size)
                    source, first, path = name, (offset, piece), f"{at}/{uuid.uuid4().hex}"
                    out = store.open_output_stream(path)
                out.write(line.encode("utf-8", "surrogatepass") + (b"\n" if ended else b""))
        if out is not None:
            size = out.tell()
            out.close()
            yield _told(source, first, path, size)

    def whole(table: pa.Table) -> pa.Table:
        name = table.column("source")[0].as_py()
        below = name[len(base) :].lstrip("/") if name.startswith(base) and name != base else posixpath.basename(name)
        store, at = opened(target)
        final, own = f"{at.rstrip('/')}/{below}", f"{opened(scratch)[1]}/whole-{uuid.uuid4().hex}"
        store.create_dir(posixpath.dirname(final), recursive=True)
        with store.open_output_stream(own) as out:
            for path in table.sort_by([("first", "ascending"), ("piece", "ascending")]).column("path").to_pylist():
                with store.open_input_stream(path) as part:
                    while block := part.read(BLOCK):
                        out.write(block)
        store.move(own, final)
        return pa.table({"file": [final], "bytes": pa.array([sum(table.column("bytes").to_pylist())], pa.int64()), "parts": pa.array([table.num_rows], pa.int64())})

    try:
        # The list of parts is kept before anything is put together: what a task that runs again wrote is not in it.
        listed = cut(placed.mapInArrow(parts, "source string, first long, piece int, path string, bytes long"))
        return cut(listed.groupBy("source").applyInArrow(whole, "file string, bytes long, parts long"))
    finally:
        store, at = opened(scratch)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


def _told(source: str, first: tuple[int, int], path: str, size: int) -> pa.RecordBatch:
    columns = [pa.array([source]), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int32()), pa.array([path]), pa.array([size], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["source", "first", "piece", "path", "bytes"])
