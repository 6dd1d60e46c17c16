"""Byte-level byte-pair encoding and decoding by recursive queries of an in-process DuckDB, one in each task.

A text is split by the vocabulary's pattern; each distinct word becomes rows (word, position, token),
one per byte. The recursive query joins neighbouring tokens with the merge table (every pair of tokens
whose bytes together are a token, with its rank), finds each word's least rank and contracts the
leftmost pair that has it, until no word holds a pair. (A word that is a token as a whole is that token, as in the library.) If the merged token stands in no pair of lower
rank than its own (told beforehand from the merge table), no contraction elsewhere can come before
the word's other pairs of that rank, so all of them (left to right, without overlaps) are contracted in
the same step; otherwise the leftmost alone. Ids are those of the library in every case.

Decoding joins the rows (text, position, id) with the vocabulary and concatenates the bytes in the
order of positions, in one ordered aggregation.

Bounded: the words of one query by ``QUERY_BYTES`` (a single longer word is a query of its own), the
steps of one query by ``QUERY_ROWS`` rows in all (words still open go on in the next), texts in hand by
slices, the ids of known words by ``CACHE_WORDS``. A word of n letters without repeats costs up to
(steps x n), as its steps follow one another.

Defined results: NULL is the empty text (no ids, digests of nothing); repeated rows give repeated
rows; an empty table gives an empty table; extra columns stay. Decoding an id outside the vocabulary
is an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.llm.texts import fresh_name, text_udf

QUERY_BYTES = 300_000
QUERY_ROWS = 3_000_000
#: Distinct words whose ids a worker keeps; then it starts over.
CACHE_WORDS = 500_000
#: Ids decoded by one query at most, unless a single text has more.
DECODE_IDS = 500_000
_PAIR = 1 << 32

#: ``pos`` grows over all words, so neighbours need no window for each word; only words with several least pairs are numbered.
ENCODE = f"""
WITH RECURSIVE step(word, pos, token, live, round) AS (
  SELECT word, pos, token, true, 0 FROM start
  UNION ALL
  (
    WITH paired AS (
      SELECT word, pos, token, round, lead(pos) OVER o AS next,
             CASE WHEN lead(word) OVER o = word THEN token::BIGINT * {_PAIR} + lead(token) OVER o END AS pair
      FROM step WHERE live AND round < $rounds WINDOW o AS (ORDER BY pos)
    ),
    ranked AS MATERIALIZED (
      SELECT word, pos, token, round, next, rank, alone FROM paired LEFT JOIN merges ON merges.pair = paired.pair
    ),
    least AS MATERIALIZED (SELECT word, min(rank) AS rank, count(*) > 2 AS open FROM ranked GROUP BY word),
    hits AS MATERIALIZED (
      SELECT r.word, r.pos, r.next, r.rank, alone FROM ranked r JOIN least l ON l.word = r.word AND l.rank = r.rank
    ),
    several AS (
      SELECT *, CASE WHEN lag(next) OVER (ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh FROM hits
      WHERE word IN (SELECT word FROM hits GROUP BY word HAVING count(*) > 1)
    ),
    runs AS (SELECT *, sum(fresh) OVER (ORDER BY pos) AS run FROM several),
    taken AS MATERIALIZED (
      SELECT any_value(pos) AS pos, any_value(next) AS next, any_value(rank) AS rank FROM hits GROUP BY word HAVING count(*) = 1
      UNION ALL
      SELECT pos, next, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) AS nth, min(pos) OVER (PARTITION BY word) AS leftmost FROM runs
      ) WHERE pos = leftmost OR (NOT alone AND nth % 2 = 1)
    )
    SELECT r.word, r.pos, coalesce(t.rank, r.token), l.rank IS NOT NULL AND l.open, r.round + 1
    FROM ranked r JOIN least l ON l.word = r.word LEFT JOIN taken t ON t.pos = r.pos
    WHERE NOT EXISTS (SELECT 1 FROM taken g WHERE g.next = r.pos)
  )
)
SELECT word, pos, token, live FROM step WHERE NOT live OR round = $rounds ORDER BY word, pos
"""
DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS decoded FROM given JOIN vocabulary ON vocabulary.id = given.id GROUP BY doc
"""


class RecursiveBpe:
    """Encoder and decoder of a rank file; ``pattern`` cuts texts into words that are encoded separately."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.words = regex.compile(pattern)
        self.tokens = ranks
        self.byte_tokens = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        early = {part for left, right, rank in pairs for part in (left, right) if rank < part}
        merges = pd.DataFrame(pairs, columns=["l", "r", "rank"], dtype="int64")
        merges = pd.DataFrame({"pair": merges["l"] * _PAIR + merges["r"], "rank": merges["rank"], "alone": merges["rank"].isin(early)})
        vocabulary = pd.DataFrame({"id": list(ranks.values()), "piece": [t.decode("latin-1") for t in ranks]})
        self.con = duckdb.connect(config={"threads": 1})
        for name, frame in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("frame", frame)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM frame")
            self.con.unregister("frame")
        self.forget()

    def forget(self) -> None:
        """Starts the table of known words anew: number of each, and where its ids lie in ``ids``."""
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.sizes = np.zeros(1 << 14, dtype=np.int64)

    def _query(self, sql: str, name: str, frame: pd.DataFrame, values: dict | None = None) -> dict:
        self.con.register(name, frame)
        try:
            return self.con.execute(sql, values or {}).fetchnumpy()
        finally:
            self.con.unregister(name)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) rows of all words, in order: what the recursive query leaves of their bytes."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        rows = pd.DataFrame({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": np.arange(len(flat), dtype=np.int32), "token": self.byte_tokens[flat],
        })
        done = []
        while len(rows):
            rounds = max(8, QUERY_ROWS // len(rows))
            found = self._query(ENCODE, "start", rows, {"rounds": rounds})
            live = found["live"]
            columns = {c: np.asarray(found[c]) for c in ("word", "pos", "token")}
            done.append({c: v[~live] for c, v in columns.items()})
            rows = pd.DataFrame({c: v[live] for c, v in columns.items()})
        word = np.concatenate([d["word"] for d in done]) if done else np.zeros(0, dtype=np.int64)
        token = np.concatenate([d["token"] for d in done]) if done else np.zeros(0, dtype=np.int64)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _learn(self, new: list[str]) -> None:
        part: list[str] = []
        size = 0
        for text in [*new, None]:
            if part and (text is None or size + len(text) > QUERY_BYTES):
                self._learn_part(part)
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)

    def _learn_part(self, part: list[str]) -> None:
        spelled = [w.encode("utf-8", "surrogatepass") for w in part]
        whole = np.array([self.tokens.get(w, -1) for w in spelled], dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        word, token = self.contract([spelled[i] for i in rest])
        word, token = np.concatenate([np.flatnonzero(whole >= 0), rest[word]]), np.concatenate([whole[whole >= 0], token])
        order = np.argsort(word, kind="stable")
        word, token = word[order], token[order]
        first = len(self.number)
        need = first + len(part)
        if need > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(need, dtype=np.int64)])
            self.sizes = np.concatenate([self.sizes, np.zeros(need, dtype=np.int64)])
        if self.used + len(token) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(token), dtype=np.uint32)])
        sizes = np.bincount(word, minlength=len(part))
        self.sizes[first:need] = sizes
        self.starts[first:need] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used:self.used + len(token)] = token
        self.used += len(token)
        self.number.update(zip(part, range(first, need)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if len(self.number) > CACHE_WORDS:
            self.forget()
        split = [self.words.findall(t) for t in texts]
        flat = [w for words in split for w in words]
        self._learn(sorted(set(flat).difference(self.number)))
        at = np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], ends])[np.cumsum([0] + [len(w) for w in split])]
        return self.ids[places], np.diff(bounds)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        out: list[bytes] = []
        ends = np.cumsum(counts)
        first = 0
        while first < len(counts):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + DECODE_IDS, side="right")))
            part = ids[before:int(ends[last - 1])]
            docs = np.repeat(np.arange(last - first), counts[first:last])
            found = self._query(DECODE, "given", pd.DataFrame({"doc": docs, "pos": np.arange(len(part)), "id": part}))
            decoded = dict(zip(found["doc"].tolist(), found["decoded"], strict=True))
            out += [decoded.get(i, "").encode("latin-1") for i in range(last - first)]
            first = last
        return out


@functools.lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> RecursiveBpe:
    """One codec per worker process; known words outlive a task."""
    return RecursiveBpe(path, pattern)


def _digests(path: str, pattern: str):
    coder = codec(path, pattern)

    def run(texts: list) -> pd.DataFrame:
        ids, counts = coder.encode([t or "" for t in texts])
        ends = np.cumsum(counts)
        packed = ids.astype("<u4")
        return pd.DataFrame({
            "n_tokens": pd.Series(counts, dtype="int64"),
            "ids_sha256": pd.Series([hashlib.sha256(packed[e - c:e].tobytes()).hexdigest() for e, c in zip(ends, counts, strict=True)], dtype=object),
            "decoded_sha256": pd.Series([hashlib.sha256(b).hexdigest() for b in coder.decode(ids, counts)], dtype=object),
        })

    return run


def _ids(path: str, pattern: str):
    coder = codec(path, pattern)

    def run(texts: list) -> pd.DataFrame:
        ids, counts = coder.encode([t or "" for t in texts])
        return pd.DataFrame({"ids": pd.Series(np.split(ids.astype(np.int64), np.cumsum(counts)[:-1]) if len(texts) else [], dtype=object)})

    return run


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of long)."""
    tmp = fresh_name(df, "encoded")
    made = text_udf(lambda: _ids(path, pattern), "ids array<long>")(F.col(text))
    return df.withColumn(tmp, made).withColumn("ids", F.col(tmp)["ids"]).drop(tmp)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary; NULL ids decode to nothing)."""

    def run(lists: pd.Series) -> pd.Series:
        rows = [np.asarray(x if x is not None else [], dtype=np.int64) for x in lists]
        return pd.Series(codec(path, pattern).decode(np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(r) for r in rows], dtype=np.int64)), dtype=object)

    run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return df.withColumn("decoded", F.pandas_udf(run, "binary")(F.col(ids)))


def bpe_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (of what ``decode`` makes of the ids)."""
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    tmp = fresh_name(df, "encoded")
    made = text_udf(lambda: _digests(path, pattern), "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col(text))
    return df.withColumn(tmp, made).withColumns({n: F.col(tmp)[n] for n in names}).drop(tmp)
