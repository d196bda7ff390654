r"""How far the sources of each language are from each other, and which terms set each one apart.

A task counts the terms of its documents a group (lang, source); Spark adds the counts up.
Terms in enough documents of a language are its vocabulary, cut by hash into chunks of
some CHUNK terms; a group's counts in one chunk are one packed vector. Groups are cut by
hash into blocks of some BLOCK groups. A vector goes to the tiles of its block with every
block of its language; a tile of two blocks and a slab of successive chunks is one task's
work, which holds the two blocks' vectors of one chunk at a time and the pairs' sums.
Sums of slabs are added by Spark. No task holds a vocabulary, a language or all groups.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, stored
from .line_dedup import UPPER
from .word_ids import slices

#: Documents of a language that hold a term of its vocabulary, at least; the most terms that are reported a group.
LEAST_DOCS, TOP = 10, 10

#: Parts that a probability has.
WHOLE = 1_000_000_000

#: Groups a block, terms a chunk, chunks a slab, about.
BLOCK, CHUNK, SLAB = 32, 2_048, 2

#: Terms that a task's counts hold before they leave it.
HELD_TERMS = 200_000

#: Terms are runs of ASCII letters and of all that is not ASCII; A-Z become small letters, other bytes spaces.
_TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Bytes of a text that are split into terms together.
PIECE = 1 << 20


def _pieces(text: bytes, most: int = PIECE):
    """The text's bytes as spaces and small letters, in pieces that end at a space."""
    text, at = text.translate(_TERM_BYTES), 0
    while len(text) - at > most:
        to = text.rfind(b" ", at + 1, at + most)
        to = text.find(b" ", at + most) if to < 0 else to
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def _counted(batches, held_terms: int = HELD_TERMS):
    """Rows (lang, source, term, n, docs) of a task; a group has a row without a term as well."""

    def out(held):
        rows = [(*group, term, n, docs[term]) for group, (counts, docs) in held.items() for term, n in counts.items()]
        rows += [(*group, b"", 0, 0) for group in held]
        kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for part in (p for batch in batches for p in slices(batch, "text")):
        for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in _pieces(text):
                terms = piece.split()
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(c) for c, _ in held.values()) > held_terms:
            yield out(held)
            held = {}
    if held:
        yield out(held)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, term, n, docs), stored; each group has one with an empty term too."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).cast("binary").alias("text"))
    counts = rows.mapInArrow(lambda batches: _counted(batches), "lang string, source string, term string, n long, docs long")
    return stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(n: Column, of: Column) -> Column:
    """1 + floor(WHOLE * (n + 2) / of) in longs, three digits at a time; beyond 9 * 10^15 in `of`, Spark raises rather than overflow."""
    div = lambda a, b: F.call_function("div", a, b)
    x, out = n + 2, F.lit(1).cast("long")
    for unit in (WHOLE, 1_000_000, 1_000, 1):
        out = out + div(x, of) * unit
        x = (x % of) * 1_000
    return out


def _shares(n: np.ndarray, of: int) -> np.ndarray:
    """As _share(), of an array."""
    if of > 9_000_000_000_000_000:
        raise ValueError("too many terms for sums of 64 bits")
    x, out = n + 2, np.ones(len(n), np.int64)
    for unit in (WHOLE, 1_000_000, 1_000, 1):
        out += x // of * unit
        x = x % of * 1_000
    return out


_TILE = "lang string, a long, b long, slab long, chunk long, source string, block long, n long, v long, terms long, at array<int>, counts array<long>"
_PAIRS = "lang string, source string, item string, value long"


class _Tile:
    """Two blocks of groups, the pairs' sums so far, and the vectors of the chunk that is being gathered."""

    def __init__(self, name: tuple):
        self.name, self.same = name, name[1] == name[2]
        self.sides: list[list[tuple[str, int]]] = [[], []]  # (source, denominator of its shares) of block a, and of block b
        self.terms = self.touched = 0
        self.sums = None
        self.chunk, self.vectors = None, []

    def group(self, source: str, block: int, n: int, v: int, terms: int) -> None:
        self.sides[0 if block == self.name[1] else 1].append((source, n + 2 * v))
        self.terms = terms

    def vector(self, chunk: int, source: str, block: int, at: np.ndarray, counts: np.ndarray) -> None:
        if chunk != self.chunk:
            self.add()
            self.chunk = chunk
        self.vectors.append((0 if block == self.name[1] else 1, source, at, counts))

    def _open(self) -> None:
        if self.sums is None:
            self.sides = [sorted(s) for s in self.sides]
            if self.same:
                self.sides[1] = self.sides[0]
            self.place = [{source: i for i, (source, _) in enumerate(s)} for s in self.sides]
            self.none = [np.array([_shares(np.zeros(1, np.int64), of)[0] if of else 1 for _, of in s], np.int64) for s in self.sides]
            self.sums = np.zeros((len(self.sides[0]), len(self.sides[1])), np.int64)

    def _pairs(self, p: np.ndarray, q: np.ndarray, times: int = 1) -> None:
        """Adds what columns of shares give for all pairs."""
        for i in range(len(p)):
            j = i + 1 if self.same else 0
            d = q[j:] - p[i]
            self.sums[i, j:] += (d * d // (q[j:] + p[i])).sum(axis=1) * times

    def add(self) -> None:
        """The chunk's vectors: columns that no group of the two blocks has are left for the end."""
        if not self.vectors:
            return
        self._open()
        columns = np.unique(np.concatenate([at for _, _, at, _ in self.vectors]))
        self.touched += len(columns)
        shares = [np.repeat(none[:, None], len(columns), axis=1) for none in self.none]
        for side, source, at, counts in self.vectors:
            i = self.place[side][source]
            shares[side][i, np.searchsorted(columns, at)] = _shares(counts, self.sides[side][i][1])
        self._pairs(shares[0], shares[0] if self.same else shares[1])
        self.vectors = []

    def done(self) -> pa.RecordBatch:
        self.add()
        self._open()
        self._pairs(self.none[0][:, None], self.none[1][:, None], self.terms - self.touched)
        i, j = np.triu_indices(len(self.sides[0]), 1) if self.same else (x.ravel() for x in np.indices(self.sums.shape))
        of = [[s for s, _ in side] for side in self.sides]
        columns = [[self.name[0]] * len(i), [of[0][k] for k in i.tolist()], [of[1][k] for k in j.tolist()]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(self.sums[i, j])], names=["lang", "source", "item", "value"])


def _tiles(batches):
    """Pairs' sums of each tile; its rows follow each other, groups first, then vectors by chunk."""
    tile = None
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        chunk, source, block, n, v, terms = (batch.column(i).to_pylist() for i in range(4, 10))
        at, counts = batch.column(10), batch.column(11)
        for k, name in enumerate(names):
            if tile is None or tile.name != name:
                if tile is not None:
                    yield tile.done()
                tile = _Tile(name)
            if chunk[k] < 0:
                tile.group(source[k], block[k], n[k], v[k], terms[k])
            else:
                tile.vector(chunk[k], source[k], block[k], at[k].values.to_numpy(), counts[k].values.to_numpy())
    if tile is not None:
        yield tile.done()


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, slab: int = SLAB
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` for each other source of the language, part `term` for the group's foremost terms.

    Null texts, languages and sources count as empty. Each row is a document, repeated
    ones too. A group whose documents have no terms has its pairs; a language with one
    source has none. Ranks go by value, greatest first, then by item; there are no ties.
    Sums are exact. Identifiers and further columns play no part, so none can clash. An
    empty table gives no rows. block, chunk and slab change tasks, not results.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    words = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    words = stored(words.select("lang", "term", "lang_n"))
    most = words.groupBy("lang").count().agg(F.max("count").alias("m")).first().m or 0
    chunks = max(1, -(-most // chunk))
    words = words.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("long"))
    words = words.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = stored(counts.join(words, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "chunk", "at"))

    groups = counts.where("term = ''").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"))
    langs = langs.join(words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left").fillna(0)
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0).join(langs, "lang")
    groups = stored(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))))

    # Tiles: a group and its vectors go to each pair of its block with another; a slab's groups come with the number of its terms.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pair = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")]
    slabs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((chunks - 1) // slab).cast("long"))).alias("slab")
    terms = words.groupBy("lang", F.floor(F.col("chunk") / slab).alias("slab")).agg(F.count("*").alias("terms"))
    heads = groups.select("lang", "source", "block", "total", "v", "blocks", slabs).join(terms, ["lang", "slab"], "left").fillna(0)
    heads = heads.select("*", other).select("lang", *pair, "slab", F.lit(-1).cast("long").alias("chunk"), "source", "block", "total", "v", "terms", F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<long>").alias("counts"))
    packed = kept.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("x"))
    vectors = packed.join(groups.select("lang", "source", "block", "blocks"), ["lang", "source"]).select("*", other)
    none = F.lit(None).cast("long")
    vectors = vectors.select("lang", *pair, F.floor(F.col("chunk") / slab).alias("slab"), "chunk", "source", "block", none, none, none, F.col("x.at"), F.col("x.n"))
    rows = heads.union(vectors).repartition("lang", "a", "b", "slab").sortWithinPartitions("lang", "a", "b", "slab", "chunk", "source")
    sums = rows.mapInArrow(_tiles, _PAIRS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.select("*", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(by_value))

    p, q = _share(F.col("n"), F.col("total") + 2 * F.col("v")), _share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v"))
    found = kept.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    found = found.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    return pairs.union(found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    return source_divergence(documents(spark, sf_dir).select("text", "lang", "source"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
v AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
s AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM v GROUP BY lang),
k AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN v USING (lang, term)),
t AS (SELECT g.lang, g.source, coalesce(sum(k.n), 0)::HUGEINT AS total FROM g LEFT JOIN k USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, v.term, coalesce(k.n, 0) AS n, 1 + ({WHOLE}::HUGEINT * (coalesce(k.n, 0) + 2)) // (t.total + 2 * s.v) AS p, 1 + ({WHOLE}::HUGEINT * (v.lang_n + 2)) // (s.lang_total + 2 * s.v) AS q
  FROM t JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN k USING (lang, source, term)
),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= {TOP}
"""
