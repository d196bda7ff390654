"""The numbered queries themselves, whole tables against brute force, the library or the definition."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.test_context_tree import base, brute
from tests.llm.test_simhash import by_force
from tests.llm.test_simhash import plain as fingerprint
from tests.llm.test_suffix import plain as cut_repeats
from tests.llm.test_tokens import check_packed, crc, ids_of
from veilspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert len(found) == 200
    return found


def result(spark, name, *columns, at=SF):
    return sorted(map(tuple, QUERIES[name](spark, at).select(*columns).collect()), key=repr)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_every_query_is_held():
    """Those with SQL by test_oracles, op12 by test_runs, the others here."""
    names = {int(n[2:].split("_")[0]): n for n in QUERIES}
    assert sorted(names) == list(range(1, 14)) and {names[n] for n in (1, 6, 9, 11, 13)} == set(ORACLES)


def test_op2(spark, rows):
    texts = [(t or "").encode() for _, t in rows]
    want = [(i, len(t), removed, spans, sha(kept)) for (i, _), t, (kept, removed, spans) in zip(rows, texts, cut_repeats(texts, 200), strict=True)]
    assert result(spark, "op2_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_op3(spark, rows):
    ids = dict(zip([i for i, _ in rows], ids_of([t for _, t in rows], 0), strict=True))
    got = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    check_packed(got, 2048)
    want = [(i, k, a, len(x[a : a + 2048]), crc(x[a : a + 2048])) for i, x in ids.items() for k, a in enumerate(range(0, len(x), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    tokens = sum(map(len, ids.values()))
    assert len({r.sequence_id for r in got}) <= 1.03 * tokens / 2048 + 1


def test_op4(spark, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert result(spark, "op4_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_op5(spark, rows):
    at, want = 0, []
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows], 1), strict=True):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert result(spark, "op5_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_op7(spark, rows):
    fps = [fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fps, by_force(fps), strict=True)]
    assert result(spark, "op7_simhash", "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_op8(spark, tmp_path):
    """Which texts are learned from, and the model, on a small table with a null identifier, repeated rows and a longer text."""
    texts = ["the cat sat on the mat", "The cat sat", None, "", "the dog sat on a log\nthe end", "żółć the cat", "the cat sat on the mat", "w" * 90 + " x", "ab " * 120]
    rows = [(17 * k, t) for k, t in enumerate(texts)] + [(None, "the cat"), (51, ""), (0, texts[0])]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = result(spark, "op8_lm_scoring", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", at=str(tmp_path))
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, _ in rows]
    raw = [(t or "") for _, t in rows]
    want = [(i, not use, *b, s) for (i, _), use, b, s in zip(rows, learn, base(raw, learn), brute([t.encode() for t in raw], learn, 4), strict=True)]
    assert any(learn) and not all(learn)
    want.sort(key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_op10(spark, rows):
    import regex

    ranks = {}
    import base64

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for line in f.read().splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert regex.compile(P.PATTERN)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert result(spark, "op10_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
