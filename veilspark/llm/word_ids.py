"""Token ids by the tokenizers library, a word at a time where that is proven to be the same."""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps at most, and fresh words encoded together: bounds of memory, not of what is encoded.
KEPT_WORDS, TOGETHER = 400_000, 20_000

#: Latin letters that stay one letter in lower case.
LETTER = r"[a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]"

#: A mark that ends a word is a token of its own behind a letter, so it may as well stand alone.
LAST_MARK = f"({LETTER})([,.;:!?])([ \\n])"


class WordEncoder:
    """Ids of whole texts.

    The file's normaliser turns white space into spaces and its splitter drops them, so
    no merge crosses one and a text's ids are those of its words in order; ASCII words
    have the ids of their lower case. Texts with a string of an added token, which the
    library looks for before it splits, go to the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [x["content"] for x in told["added_tokens"]]
        steps = (told["normalizer"] or {}).get("normalizers", [])
        split = ((told["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = (
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} in steps and {"type": "Lowercase"} in steps
            and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
            and r"[\p{L}]+" in split["pattern"]["Regex"] and r"[^\s\p{L}\p{N}]+" in split["pattern"]["Regex"]
        )
        suffix = told["model"].get("end_of_word_suffix")
        vocabulary = told["model"]["vocab"]
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.kept: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [array("I", x.ids).tobytes() for x in encode(texts, add_special_tokens=False)]

    def _fresh(self, words: pa.Array) -> dict[str, bytes]:
        """Ids of words: those of letters alone as one text, cut behind the ids that end a word."""
        out: dict[str, bytes] = {}
        plain = pc.match_substring_regex(words, f"^{LETTER}+$")
        for k in range(0, len(words), TOGETHER):
            part, letters = words.slice(k, TOGETHER), plain.slice(k, TOGETHER)
            rest = part.filter(pc.invert(letters)).to_pylist()
            mine = part.filter(letters).to_pylist()
            if mine:
                ids = np.frombuffer(self._library([" ".join(mine)])[0], "<u4")
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(mine) and ends[-1] == len(ids):
                    flat, at = ids.tobytes(), 0
                    for word, end in zip(mine, (4 * ends).tolist(), strict=True):
                        out[word] = flat[at:end]
                        at = end
                else:
                    rest += mine
            out.update(zip(rest, self._library(rest), strict=True))
        return out

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each text) of texts without added tokens."""
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, LAST_MARK, r"\1 \2\3"))
        some, words = np.diff(split.offsets.to_numpy()), split.flatten()
        coded = words.dictionary_encode()
        told = coded.dictionary
        told = pc.if_else(pc.string_is_ascii(told), pc.ascii_lower(told), told).dictionary_encode()
        where = told.indices.to_numpy()[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        names, kept = told.dictionary.to_pylist(), self.kept
        fresh = self._fresh(told.dictionary.filter(pa.array([w not in kept for w in names], pa.bool_())))
        ids = [kept[w] if w in kept else fresh[w] for w in names]
        for w, x in fresh.items():
            if len(kept) >= KEPT_WORDS:
                break
            kept[w] = x
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        before = np.cumsum(sizes) - sizes
        n = sizes[where]
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(n) else 0
        at = np.repeat(before[where] - stops + n, n)
        at += np.arange(total)
        upto = np.append(0, stops)[np.cumsum(np.append(0, some))]
        return flat[at], np.diff(upto)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each text has); null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy: kernels of strings may take a slice's offsets wrongly
        whole = pa.array(np.full(len(texts), not self.by_word))
        for a in self.added if self.by_word else ():
            whole = pc.or_(whole, pc.match_substring(texts, a))
        ids, counts = self._by_word(pc.if_else(whole, "", texts)) if self.by_word else (np.zeros(0, "<u4"), np.zeros(len(texts), np.int64))
        some = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(some):
            found = [np.frombuffer(x, "<u4") for x in self._library(texts.take(pa.array(some)).to_pylist())]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.insert(ids, np.repeat((np.cumsum(counts) - counts)[some], sizes), np.concatenate(found))
            counts[some] = sizes
        return ids, counts

    def with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with end_id behind each text."""
        ids, counts = self.encode(texts)
        stops = np.cumsum(counts + 1)
        out = np.empty(len(ids) + len(counts), "<u4")
        own = np.ones(len(out), bool)
        own[stops - 1] = False
        out[own] = ids
        out[stops - 1] = end_id
        return out, stops


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def default_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batch, text: str, together: int = 4 << 20):
    """The batch in parts of about `together` bytes of text."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist()):
        size += n
        if size >= together:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
