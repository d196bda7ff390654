"""Token counts by overlap resynchronisation.

A huge document is encoded in chunks that overlap. Each chunk's encoder gives its token
boundaries with their offsets; two chunks are spliced at a boundary that both have in
the overlap and that is proven stable: before a run of spaces after another character,
which no piece of the vocabulary and so no merge covers. Where the overlap has no such
boundary it is widened, and a chunk without one is lengthened, to the rest of the
document if need be. A text of one chunk goes to the encoder as it is.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import documents, free_name, text_bytes
from .word_ids import slices

#: Characters of a chunk and of the first overlap.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512


class PieceCounter:
    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        #: No piece has a space mark after another character, and the library changes no spaces.
        #: To the library a U+2581 in a text is a space; count() takes it for one.
        self.stable = all("▁" not in p.lstrip("▁") for p in pieces) and "▁" in pieces and self._keeps_spaces()

    def _keeps_spaces(self) -> bool:
        probe = "a  b \n c   "
        same = "".join(self.library.encode(probe, out_type=str)).replace("<0x0A>", "\n") == "▁" + probe.replace(" ", "▁")
        return same and all(self.library.encode(x) == self.library.encode(x.replace("▁", " ")) for x in ("▁ ▁ a", "a▁b ▁", "▁", "a▁▁ \n▁b"))

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1)) if text else 0

    def chunk(self, text: str, start: int, stop: int) -> np.ndarray:
        """Where the encoder's tokens of text[start:stop] begin; a first space is the mark that the library puts before a text."""
        first = start + (text[start] == " ")
        part = text[first:stop]
        if not part:
            return np.array([start])
        pieces = self.library.encode(part, return_type="proto").pieces
        begins = np.fromiter((p.begin for p in pieces), np.int64, len(pieces))  # in bytes
        if not part.isascii():
            begins = (np.cumsum((np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80) - 1)[begins]
        begins += first
        begins[0] = start
        return begins

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        """Tokens of one text."""
        if len(text) < chunk or not self.stable:
            return self.whole(text)
        marked = " " + text.replace("▁", " ")  # with the mark that the library puts before it
        end = len(marked)
        at = total = 0  # tokens of marked[:at] are counted; at is a stable boundary
        stop, wide = chunk, overlap
        ours = self.chunk(marked, 0, stop)
        while stop < end:
            tail = stop - wide
            if tail <= at:  # no boundary to splice at in all of this chunk
                stop, wide = min(end, at + 2 * (stop - at)), overlap
                ours = self.chunk(marked, at, stop)
                continue
            until = min(end, tail + max(chunk, 2 * wide))
            theirs = self.chunk(marked, tail, until)
            both = np.intersect1d(ours, theirs)[::-1].tolist()
            splice = next((o for o in both if o > at and marked[o] == " " and marked[o - 1] != " "), None)
            if splice is None:
                wide *= 2  # alignment failed within the overlap
                continue
            total += int(np.searchsorted(ours, splice) - np.searchsorted(ours, at))
            at, ours, stop, wide = splice, theirs, until, overlap
        return total + len(ours) - int(np.searchsorted(ours, at))


@functools.lru_cache(maxsize=4)
def piece_counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, text_col: str = "text", limit: int = 4096, model: str | None = None) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) after its own columns.

    Null and empty texts have no bytes and no tokens. Whole texts count, however long;
    strings of control tokens are ordinary text. Rows stay as they are, repeated ones
    too; an empty table stays empty; clashing names take underscores.
    """
    model = model or default_pieces()
    names = [free_name(docs, n) for n in ("n_bytes", "n_tokens", "over_limit")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {k}" for n, k in zip(names, ("bigint", "bigint", "boolean"), strict=True))])

    def run(batches):
        counter = piece_counter(model)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = text_bytes(part.column(part.schema.get_field_index(text_col)))
                n = [counter.count(b.decode("utf-8", "replace")) for b in texts]
                added = [pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op4_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
