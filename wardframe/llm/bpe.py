"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf of the tree stands for a symbol and holds ``(rank of the pair with its right neighbour,
position)`` as one number; an inner node holds the smaller of its children, so the root names the
leftmost pair of lowest rank. A merge changes three leaves (the merged symbol, the symbol it ate,
its left neighbour), each repaired in a logarithmic walk, until the root holds no pair. A word of n
bytes therefore takes O(n log n), also when it is a megabyte long.

Texts are cut at special tokens, normalised and split as the vocabulary file says. Encoded words are
kept in a bounded table per worker: the merges run once per distinct word.

Defined results: NULL is the empty text (no ids; the digests are those of nothing); repeated rows
give repeated rows; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.llm.texts import fresh_name, text_udf

#: Distinct words whose encoding a worker keeps; then it starts over.
CACHE_WORDS = 400_000
#: Longer words are not kept.
CACHE_CHARS = 64
#: Texts of these characters only are composed already, and lower-casing them needs no context.
PLAIN = "\\t\\n\\r -~\u00a1-\u012f\u0131-\u017f"
#: The letters and numbers among them, once in lower case.
PLAIN_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f"
PLAIN_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_NONE = 1 << 62
_SHIFT = 32


def merge_symbols(symbols: list, ranks: dict) -> list:
    """Applies the merges to ``symbols``: always the lowest rank, the leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    get = ranks.get
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get((symbols[i], symbols[i + 1]))
        if rank is not None:
            tree[size + i] = rank << _SHIFT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    low = (1 << _SHIFT) - 1

    def put(leaf: int, value: int) -> None:
        node = size + leaf
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            least = value if value < other else other
            node >>= 1
            if tree[node] == least:
                return
            tree[node] = value = least

    while (root := tree[1]) != _NONE:
        i = root & low
        j = after[i]
        k = after[j]
        symbols[i] += symbols[j]
        symbols[j] = None
        after[i] = k
        if k < n:
            before[k] = i
            rank = get((symbols[i], symbols[k]))
            put(i, _NONE if rank is None else rank << _SHIFT | i)
        else:
            put(i, _NONE)
        put(j, _NONE)
        h = before[i]
        if h >= 0:
            rank = get((symbols[h], symbols[i]))
            put(h, _NONE if rank is None else rank << _SHIFT | h)
    return [s for s in symbols if s is not None]


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-level BPE file of the ``tokenizers`` library.

    Supported layout: a split pattern whose matches are the words, byte letters, an end-of-word
    suffix, special tokens taken from the raw text, no decoder (tokens joined by spaces).
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.letters = _byte_letters()
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V0)
        self.plain_words = re.compile(pattern.replace(r"\p{L}", PLAIN_LETTERS).replace(r"\p{N}", PLAIN_NUMBERS))
        self.unusual = re.compile(f"[^{PLAIN}]")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = "|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True))
        self.special = regex.compile(f"({marks})") if marks else None
        self.normalise: Callable[[str], str] = Tokenizer.from_file(path).normalizer.normalize_str
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.cache: dict[str, tuple[bytes, str]] = {}

    def split_words(self, piece: str) -> list[str]:
        """The words of a text without special tokens; common characters take a shorter way."""
        if self.unusual.search(piece):
            return self.words.findall(self.normalise(piece))
        return self.plain_words.findall(piece.lower())

    def word_tokens(self, word: str) -> list[str]:
        symbols = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        return merge_symbols(symbols, self.ranks)

    def _word(self, word: str) -> tuple[bytes, str]:
        tokens = [t for t in self.word_tokens(word) if t in self.ids]
        found = struct.pack(f"<{len(tokens)}I", *(self.ids[t] for t in tokens)), " ".join(tokens)
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def pack(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        pieces = self.special.split(text) if self.special else [text]
        ids: list[bytes] = []
        decoded: list[str] = []
        get, word_of = self.cache.get, self._word
        for piece in pieces:
            if piece in self.specials:
                ids.append(struct.pack("<I", self.specials[piece]))
                decoded.append(piece)
            elif piece:
                known = [get(word) or word_of(word) for word in self.split_words(piece)]
                ids += [k[0] for k in known]
                decoded += [k[1] for k in known]
        return b"".join(ids), " ".join(decoded)

    def encode(self, text: str) -> list[int]:
        packed = self.pack(text)[0]
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _digests(path: str):
    codec = WordBpe(path)

    def run(texts: list) -> pd.DataFrame:
        counts, ids, decoded = [], [], []
        for text in texts:
            packed, words = codec.pack(text or "")
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(words.encode("utf-8", "surrogatepass")).hexdigest())
        return pd.DataFrame({
            "n_tokens": pd.Series(counts, dtype="int64"), "ids_sha256": pd.Series(ids, dtype=object),
            "decoded_sha256": pd.Series(decoded, dtype=object),
        })

    return run


def _encoded(path: str):
    codec = WordBpe(path)

    def run(texts: list) -> pd.DataFrame:
        rows = [codec.pack(text or "") for text in texts]
        return pd.DataFrame({
            "ids": pd.Series([list(struct.unpack(f"<{len(p) // 4}I", p)) for p, _ in rows], dtype=object),
            "decoded": pd.Series([d for _, d in rows], dtype=object),
        })

    return run


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of long) and ``decoded``, the text that the ids stand for."""
    return _with(df, text_udf(lambda: _encoded(path), "ids array<long>, decoded string")(F.col(text)), ("ids", "decoded"))


def bpe_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` without shipping ids back."""
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    return _with(df, text_udf(lambda: _digests(path), "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col(text)), names)


def _with(df: DataFrame, made: Column, names: tuple[str, ...]) -> DataFrame:
    tmp = fresh_name(df, "encoded")
    return df.withColumn(tmp, made).withColumns({n: F.col(tmp)[n] for n in names}).drop(tmp)
