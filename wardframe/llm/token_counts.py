"""Token counts of whole texts; huge texts are encoded in overlapping windows that are spliced.

A window boundary may cut a word, so neighbouring windows overlap. They are joined at a position
where both encodings have a token boundary and where the splitting pattern must break whatever
stands around it: between a character that is no white space and a white-space character, or
between a letter and an ASCII digit. No piece of the pattern spans such a position and no piece
before it looks further, so the tokens on either side are those of the whole text. The overlap is
longer than any special token, hence a special token cut by one window is whole in the other, which
then has no boundary inside it. Both sides of a join are encoded with offsets around the overlap; if
that holds no such position it is doubled; if it reaches the middle of the left window, the window is
taken twice as long. In the worst case (one endless word) the text is encoded whole, so the result is
always that of the library.

Defined results: NULL is the empty text (0 bytes, 0 tokens); repeated rows give repeated rows; an
empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.llm.texts import fresh_name, text_udf

WINDOW = 32_768
OVERLAP = 256
LIMIT = 1024
#: Distinct pieces whose count a worker keeps, and the longest of them.
CACHE_PIECES = 400_000
CACHE_CHARS = 64


class SplicingEncoder:
    """Encodes like ``tokenizer.encode(text, add_special_tokens=False)`` without whole-text calls."""

    def __init__(self, tokenizer, window: int = WINDOW, overlap: int = OVERLAP):
        tokens = tokenizer.get_added_tokens_decoder().values()
        longest = max([len(t.content) for t in tokens], default=0)
        if overlap <= longest or window < 4 * overlap:
            raise ValueError("the overlap must exceed the longest special token, the window four overlaps")
        self.tokenizer = tokenizer
        self.window = window
        self.overlap = overlap

    def _encode(self, text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
        got = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return got.ids, [(a + start, b + start) for a, b in got.offsets]

    @staticmethod
    def _must_split(text: str, at: int) -> bool:
        before, after = text[at - 1], text[at]
        if after in " \t\n\r":
            return not before.isspace()
        return before.isalpha() and after in "0123456789"

    def _common_cut(self, text: str, left: list, right: list, end: int) -> int | None:
        """The last proven boundary that both windows have, strictly inside their overlap."""
        left_ends = {b for _, b in left}
        for a, _ in reversed(right):
            if a < end and a in left_ends and a > right[0][0] and self._must_split(text, a):
                return a
        return None

    def cuts(self, text: str) -> Iterator[int]:
        """Where windows join: proven boundaries, each seen from both sides of an overlap."""
        start, length, window = 0, len(text), self.window
        while start + window < length:
            end, overlap, cut = start + window, self.overlap, None
            while cut is None and end - 2 * overlap > start:
                _, left = self._encode(text, end - 2 * overlap, end)
                _, right = self._encode(text, end - overlap, min(length, end + overlap))
                cut = self._common_cut(text, left, right, end)
                overlap *= 2
            if cut is None:  # no proven boundary in half the window: a longer window
                window *= 2
                continue
            yield cut
            start, window = cut, self.window

    def segments(self, text: str) -> list[tuple[int, int]]:
        """The spans between the joins; encoded one by one they give the encoding of the text."""
        at = [0, *self.cuts(text), len(text)]
        return list(zip(at, at[1:], strict=False))

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and character spans of the whole text."""
        ids: list[int] = []
        spans: list[tuple[int, int]] = []
        for a, b in self.segments(text):
            some_ids, some_spans = self._encode(text, a, b)
            ids += some_ids
            spans += some_spans
        return ids, spans


class PieceCounter:
    """Token counts of texts up to a window, from pieces between proven boundaries.

    A piece is white space followed by other characters; it starts at a proven boundary, so counts
    add up. The library encodes each distinct piece once; counts are kept in a bounded table. Texts
    with other white space than the four common signs are encoded whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.pieces = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+").findall
        self.unusual = re.compile(r"[^\S \t\n\r]").search
        self.known: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        whole = [i for i, t in enumerate(texts) if self.unusual(t)]
        out = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True))
        split = {i: self.pieces(t) for i, t in enumerate(texts) if i not in out}
        known = self.known
        new = list({p for pieces in split.values() for p in pieces}.difference(known))
        fresh = dict(zip(new, self._encode(new), strict=True))
        for i, pieces in split.items():
            out[i] = sum([known[p] if p in known else fresh[p] for p in pieces])
        known.update((p, n) for p, n in fresh.items() if len(p) <= CACHE_CHARS)
        return [out[i] for i in range(len(texts))]


def _kernel(path: str, window: int, overlap: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encoder = SplicingEncoder(tokenizer, window, overlap)
    pieces = PieceCounter(tokenizer)

    def run(texts: list) -> pd.DataFrame:
        counts = [0] * len(texts)
        short = []
        for i, text in enumerate(texts):
            if text and len(text) > window:
                counts[i] = sum(pieces.counts([text[a:b] for a, b in encoder.segments(text)]))
            elif text:
                short.append(i)
        for i, n in zip(short, pieces.counts([texts[i] for i in short]), strict=True):
            counts[i] = n
        return pd.DataFrame({"n": pd.Series(counts, dtype="int64")})

    return run


def token_count(text: str | Column, path: str, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Struct with ``n``, the number of tokens of each text."""
    return text_udf(lambda: _kernel(path, window, overlap), "n long")(text)


def count_tokens(
    df: DataFrame, path: str, text: str = "text", limit: int = LIMIT, window: int = WINDOW, overlap: int = OVERLAP
) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit``; columns of these names are replaced."""
    tmp = fresh_name(df, "counted")
    out = df.withColumn(tmp, token_count(F.col(text), path, window, overlap))
    return out.withColumns({
        "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"),
        "n_tokens": F.col(tmp)["n"],
        "over_limit": F.col(tmp)["n"] > limit,
    }).drop(tmp)
