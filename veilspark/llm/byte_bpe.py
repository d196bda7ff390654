"""Byte-level BPE by corpus-level merge replay.

A task takes the distinct pieces of its documents as one corpus. An inverted index
from token pair to the places where it stands holds all of them at once; merges are
applied in rank order, each at all its places, and only the neighbours of a merged
place are entered anew. The ids of a document are those of its pieces in order.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import documents, text_bytes

#: Distinct pieces that a worker keeps, and that one replay takes, at most: bounds of memory, not of what is encoded.
KEPT_PIECES, REPLAYED_PIECES = 400_000, 40_000


class MergeReplay:
    """Encoder for one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.ids = {t: i.to_bytes(4, "little") for t, i in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        #: \s of the pattern means Unicode's White_Space, which Python's module takes wider.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], int | None] = {}

    def rank(self, a: int, b: int) -> int | None:
        """Rank of the token that the two make, if there is one."""
        try:
            return self.pairs[a, b]
        except KeyError:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b])
            return found

    def single(self, piece: bytes) -> list[int]:
        """One piece alone: the leftmost pair of least rank, again and again."""
        out = [self.byte_ids[b] for b in piece]
        while len(out) > 1:
            best = min(((r, i) for i in range(len(out) - 1) if (r := self.rank(out[i], out[i + 1])) is not None), default=None)
            if best is None:
                break
            out[best[1] : best[1] + 2] = [best[0]]
        return out

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, all pieces merged together."""
        token: list[int] = []
        word: list[int] = []
        starts = []
        for w, piece in enumerate(pieces):
            starts.append(len(token))
            token.extend(self.byte_ids[b] for b in piece)
            word.extend([w] * len(piece))
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for s in starts:
            if s < n:
                before[s] = -1
            if s:
                after[s - 1] = -1
        if n:
            after[n - 1] = -1
        index: dict[int, list[int]] = {}
        pair_at = [-1] * n  # the rank under which a place was entered last
        for i in range(n):
            j = after[i]
            if j >= 0 and (r := self.rank(token[i], token[j])) is not None:
                index.setdefault(r, []).append(i)
                pair_at[i] = r
        order = list(index)
        heapq.heapify(order)
        alone: set[int] = set()
        while order:
            r = heapq.heappop(order)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for i in places:
                if pair_at[i] != r:
                    continue  # a neighbour's merge took it
                j = after[i]
                k = after[j]
                pair_at[j] = -1
                token[i] = r
                after[i] = k
                pair_at[i] = -1
                if k >= 0:
                    before[k] = i
                    if (q := self.rank(r, token[k])) is not None:
                        self._enter(index, order, pair_at, i, q)
                        if q < r:
                            alone.add(word[i])
                h = before[i]
                if h >= 0:
                    if (q := self.rank(token[h], r)) is not None:
                        self._enter(index, order, pair_at, h, q)
                        if q <= r:
                            alone.add(word[i])
                    else:
                        pair_at[h] = -1
        out = []
        for w, s in enumerate(starts):
            if w in alone:  # a merge opened one of lower rank; the order within this piece needs care
                out.append(self.single(pieces[w]))
                continue
            ids, i = [], s if pieces[w] else -1
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    @staticmethod
    def _enter(index, order, pair_at, place, rank):
        pair_at[place] = rank
        places = index.get(rank)
        if places is None:
            index[rank] = [place]
            heapq.heappush(order, rank)
        else:
            places.append(place)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        kept = self.kept
        new = {p for pieces in split for p in pieces if p not in kept}
        over: dict[str, bytes] = {}
        waiting = []
        for p in new:
            whole = self.ids.get(b := p.encode())
            if whole is not None and len(b) == 1:
                over[p] = whole
            else:
                waiting.append((p, b))
        for k in range(0, len(waiting), REPLAYED_PIECES):
            part = waiting[k : k + REPLAYED_PIECES]
            for (p, _), ids in zip(part, self.replay([b for _, b in part]), strict=True):
                over[p] = b"".join([i.to_bytes(4, "little") for i in ids])
        room = max(0, KEPT_PIECES - len(kept))
        kept.update(over)
        try:
            return [b"".join(map(kept.__getitem__, pieces)) for pieces in split]
        finally:
            for p in list(over)[room:]:
                del kept[p]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist())) if ids else b""


@functools.lru_cache(maxsize=4)
def replayer(rank_file: str, pattern: str) -> MergeReplay:
    return MergeReplay(rank_file, pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Characters of text encoded together.
TOGETHER = 8 << 20


def encoded(docs: DataFrame, text_col: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ids (array of int) and decoded (binary) after its own columns.

    Null and empty texts have no ids and decode to nothing. Each text is encoded whole,
    whatever its length; special strings are ordinary text. Rows stay as they are,
    repeated ones too; an empty table stays empty; clashing names take underscores.
    """
    return _map(docs, text_col, rank_file, pattern, [("ids", "array<int>", lambda ids, enc: list(memoryview(ids).cast("I")) if ids else []), ("decoded", "binary", lambda ids, enc: enc.decode(ids))])


def encoded_digest(docs: DataFrame, text_col: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """As encoded(), with n_tokens and the SHA-256 of ids and of decoded bytes in place of them."""
    return _map(
        docs, text_col, rank_file, pattern,
        [("n_tokens", "bigint", lambda ids, enc: len(ids) // 4), ("ids_sha256", "string", lambda ids, enc: hashlib.sha256(ids).hexdigest()), ("decoded_sha256", "string", lambda ids, enc: hashlib.sha256(enc.decode(ids)).hexdigest())],
    )


def _map(docs, text_col, rank_file, pattern, added):
    from ._common import free_name

    ranks, default = default_ranks()
    rank_file, pattern = rank_file or ranks, pattern or default
    names = [free_name(docs, n) for n, _, _ in added]
    kinds = {"array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {k}" for n, (_, k, _) in zip(names, added, strict=True))])

    def run(batches):
        enc = replayer(rank_file, pattern)
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            sizes = pc.binary_length(whole.column(at)).fill_null(0).to_pylist()
            start = size = 0
            for i, n in enumerate([*sizes, None]):
                if n is not None:
                    size += n
                if (n is None and i > start) or (size >= TOGETHER and n is not None):
                    stop = i if n is None else i + 1
                    batch = whole.slice(start, stop - start)
                    ids = enc.encode([b.decode("utf-8", "replace") for b in text_bytes(batch.column(at))])
                    columns = [pa.array([f(x, enc) for x in ids], kinds[k]) for _, k, f in added]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])
                    start, size = stop, 0

    return docs.mapInArrow(run, schema)


def op10_byte_bpe(spark, sf_dir) -> DataFrame:
    docs = encoded_digest(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
