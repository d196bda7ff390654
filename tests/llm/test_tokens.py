import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

SF = "/root/testdata/sf0.001"

HARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "it's I'LL 'd", "x" * 3000, "ab" * 2500, "a \x1c b\x85c\xa0d", "é é ñ", "日本語 テキスト", "a<|endoftext|>b", "<s> </s> <unk>", "\x00\x01", "a\t\tb\r\nc \n\n d",
    "aaaaaaaa aaaaaaa", "12345 6 7", "word " * 5000, "   " * 700 + "z", "😀😀 👍🏽", "ſK", "A" * 70 + " " * 70,
]


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)


def corpus(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + HARD


def ids_of(texts, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [[*library.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(spark):
    import sentencepiece

    from veilspark.llm.token_counts import token_counts

    texts = corpus(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens_, r.over_limit) for r in token_counts(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096), repr(t)[:80]
    assert token_counts(table(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(16, 1), (40, 8), (300, 2)])
def test_resynchronised_chunks(chunk, overlap):
    import sentencepiece

    from veilspark.llm.token_counts import PieceCounter

    counter = PieceCounter(P.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    draw = random.Random(3)
    for _ in range(150):
        text = "".join(draw.choice(["the", "qu", " ", " ", "  ", "\n", "é", "zz" * 30, "ing", "."]) for _ in range(draw.randrange(120)))
        assert counter.count(text, chunk, overlap) == len(library.encode(text)), repr(text)


def test_space_marks_in_texts():
    import sentencepiece

    from veilspark.llm.token_counts import PieceCounter

    counter = PieceCounter(P.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    draw = random.Random(4)
    texts = ["▁ ▁ a", "▁", " ▁", "▁ ", "a▁ b"] + ["".join(draw.choice(["▁", " ", "▁▁", "the", "é", "\n", "▂", "█", "x"]) for _ in range(draw.randrange(60))) for _ in range(300)]
    for text in texts:
        assert counter.count(text) == counter.count(text, 16, 2) == len(library.encode(text)), repr(text)


def test_chunks_have_the_boundaries_of_the_encoder(monkeypatch):
    import sentencepiece

    from veilspark.llm.token_counts import PieceCounter

    counter = PieceCounter(P.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    text = " resynchronisation of 日本語 tokens, naïvely  counted"
    places = np.cumsum([0, *(len(p) for p in library.encode(text[1:], out_type=str))])[:-1]
    assert list(counter.chunk(text, 0, len(text))) == places.tolist()

    seen, chunk = [], PieceCounter.chunk
    monkeypatch.setattr(PieceCounter, "chunk", lambda self, t, a, b: (seen.append((a, b)), chunk(self, t, a, b))[1])
    text = ("the quick brown foxes " * 40 + "x" * 700) * 3
    assert counter.count(text, 400, 50) == len(library.encode(text))
    assert len(seen) > 5 and all(b > c for (_, b), (c, _) in zip(seen, seen[1:], strict=False))

    # A boundary that only one chunk has is no place to splice at: the overlap is widened.
    hidden = []
    def without_some(self, t, a, b):
        offsets = chunk(self, t, a, b)
        if a and len(hidden) < 3:
            hidden.append(a)
            return offsets[(offsets < a + 1) | (offsets >= b - 5)]
        return offsets
    monkeypatch.setattr(PieceCounter, "chunk", without_some)
    text = "the quick brown foxes " * 200
    assert counter.count(text, 400, 50) == len(library.encode(text))
    assert len(hidden) == 3


def test_byte_bpe(spark):
    import base64
    import hashlib

    import tiktoken

    from veilspark.llm.byte_bpe import encoded, encoded_digest

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = corpus(spark)
    got = {r.doc_id: r for r in encoded_digest(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens_, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), repr(t)[:80]
    back = encoded(table(spark, HARD)).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for t in HARD]
    assert encoded_digest(table(spark, HARD).limit(0)).count() == 0


def test_replay_with_ranks_out_of_order():
    """Merges that open a pair of lower rank give what the one-piece rule gives."""
    from veilspark.llm.byte_bpe import MergeReplay

    replay = MergeReplay(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    draw = random.Random(5)
    for _ in range(40):
        letters = draw.sample(range(97, 123), 3)
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(25):
            new = bytes(draw.choice(letters) for _ in range(draw.choice([2, 2, 3, 3, 4, 5])))
            if new not in tokens:
                tokens.append(new)
        replay.ranks = {t: i for i, t in enumerate(tokens)}
        replay.tokens = dict(enumerate(tokens))
        replay.byte_ids = list(range(256))
        replay.pairs = {}
        words = [bytes(draw.choice(letters) for _ in range(draw.randrange(1, 30))) for _ in range(60)]
        assert replay.replay(words) == [replay.single(w) for w in words]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_shard_round_trip(planes):
    from veilspark.llm.token_files import read_shard, write_shard

    draw = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000, 65_536, 70_001):
        for top in (1, 2, 300, 49_408, 2**32):
            ids = draw.integers(0, top, n, dtype=np.uint64).astype("<u4")
            assert (read_shard(write_shard(ids, planes=planes)) == ids).all()
            assert (read_shard(write_shard(ids, block=33, planes=planes)) == ids).all() if n < 2000 else True


def test_token_files(spark, tmp_path):
    from veilspark.llm.token_files import read_token_files, write_token_files

    texts = corpus(spark)
    want, start = [], 0
    for i, ids in enumerate(ids_of(texts, 1)):
        want.append((i, start, ids))
        start += len(ids)
    write_token_files(table(spark, texts), str(tmp_path / "a"))
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(spark, str(tmp_path / "a")).orderBy("doc_id").collect()]
    assert got == want
    write_token_files(table(spark, ["x"]).limit(0), str(tmp_path / "b"))
    assert read_token_files(spark, str(tmp_path / "b")).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    write_token_files(twice, str(tmp_path / "c"), planes="bit")
    assert sorted((r.doc_id or -1, r.start) for r in read_token_files(spark, str(tmp_path / "c")).collect()) == [(-1, 0), (1, 1), (1, 3)]


def test_packing(spark):
    from veilspark.llm.packing import pack

    texts = [*corpus(spark), "word and more " * 900]
    rows = pack(table(spark, texts)).collect()
    want = {}
    for i, ids in enumerate(ids_of(texts, 0)):
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), crc(ids[k : k + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_packed(rows, 2048)
    assert pack(table(spark, ["x"]).limit(0)).count() == 0


def check_packed(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.03 * -(-total // capacity) + 2
    return len(sequences)


def test_plans_of_random_counts():
    from veilspark.llm.packing import plan_packing

    draw = np.random.default_rng(2)
    for case in range(25):
        capacity = int(draw.choice([10, 64, 2048]))
        counts = np.zeros(capacity + 1, np.int64)
        lengths = draw.integers(1, capacity + 1, draw.integers(0, 60))
        np.add.at(counts, lengths, draw.integers(1, 50, len(lengths)) if case % 2 else 1)
        plan = plan_packing(counts, capacity)
        filled = {}
        taken = np.zeros(capacity + 1, np.int64)
        for length, number, n, first, offset in sorted(plan.runs):
            assert number == taken[length]
            taken[length] += n
            for i in range(n):
                filled.setdefault(first + i, []).append((offset, length))
        assert (taken == counts).all()
        assert len(filled) == plan.sequences
        for places in filled.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity


def test_packing_of_odd_tables(spark):
    """Null and repeated identifiers, repeated rows, one length that most pieces have, columns of the names that are added."""
    from veilspark.llm.packing import pack

    rows = [(None, "one two"), (None, None), (7, "same text here"), (7, "same text here"), (7, "other"), (-1, "word " * 3000)] + [(100 + k, "equal lengths all of them") for k in range(500)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, piece int, Sequence_ID string").repartition(7)
    got = pack(docs).collect()
    want = sorted((repr(i), k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for (i, _), ids in zip(rows, ids_of([t for _, t in rows], 0), strict=True) for k in range(0, len(ids), 2048))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_packed(got, 2048)


def test_numbers_of_pieces():
    from veilspark.llm.packing import _numbered

    seen = np.zeros(6, np.int64)
    assert _numbered(np.array([3, 5, 3, 3, 1]), seen).tolist() == [0, 0, 1, 2, 0]
    assert _numbered(np.array([3, 1]), seen).tolist() == [3, 1] and _numbered(np.array([], np.int64), seen).tolist() == []
    assert seen.tolist() == [0, 2, 0, 4, 0, 1]


def test_token_files_of_one_identifier(spark, tmp_path):
    """An identifier, or none, that most rows have: starts have no gap and every row is there."""
    from veilspark.llm.token_files import read_token_digests, read_token_files, write_token_files

    rows = [(None, f"text {k}") for k in range(120)] + [(5, f"more {k} text") for k in range(200)] + [(9, "last")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    write_token_files(docs, str(tmp_path / "a"))
    got = sorted((r.start, repr(r.doc_id), len(r.ids) // 4, crc(np.frombuffer(r.ids, "<u4"))) for r in read_token_files(spark, str(tmp_path / "a")).collect())
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert sorted((i, c) for _, i, _, c in got) == sorted((repr(i), crc(ids)) for (i, _), ids in zip(rows, ids_of([t for _, t in rows], 1), strict=True))
    assert [i for _, i, _, _ in got] == ["None"] * 120 + ["5"] * 200 + ["9"]
    assert sorted((r.start, repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in read_token_digests(spark, str(tmp_path / "a")).collect()) == got


def test_words_of_slices_and_hard_texts():
    """Word by word as the library, also in slices of a column and over words that it splits further."""
    import pyarrow as pa

    from veilspark.llm.word_ids import default_words, word_encoder

    encoder = word_encoder(default_words())
    draw = random.Random(6)
    parts = ["Word", "it's,", "END.", "é,", "İ.", "J̌,", "ß?", "x1y2", "...", "!?,", "a<|endoftext|>", "\x85", "\xa0b,", "日本、", "́", "ſ,", "Ǆ.", "'s,", "\x1c", "12,", "Q" * 40 + ";"]
    texts = [None, "", *HARD[1:]] + [draw.choice([" ", "\n", "  "]).join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(300)]
    column = pa.array(["skipped, text"] * 7 + texts).slice(7)
    ids, counts = encoder.encode(column)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == encoder.library.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]
        at += n
    assert at == len(ids)
