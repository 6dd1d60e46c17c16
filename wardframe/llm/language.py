"""Language identification: known words first, character n-grams for the others.

A word of the learned vocabulary adds its log frequency in each language. An unseen word falls back
to its character n-grams: those of the longest length of which any is known are averaged; if none
is, the next shorter length is tried, down to single characters; a word without any known character
says nothing. The scores of a text are sums over all its words; softmax gives the confidence.

The model is fitted on at most ``fit_texts`` labelled texts (chosen by a hash of the text, so the
choice does not depend on partitions) and keeps at most ``words`` words and ``grams`` n-grams of
each length over all languages together, the most frequent ones of each language. These bounds make
it small enough to travel with the tasks. Prediction reads whole texts.

Defined results: a text that is NULL or has no letter is ``und`` with score 0, and so is every text
when nothing was learned; equal scores go to the alphabetically first language; texts without a
language or NULL texts teach nothing; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.llm.texts import slices, text_udf

FIT_TEXTS = 30_000
WORDS = 120_000
GRAMS = 40_000
LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Added to every count, so that a word seen in one language only does not exclude the others.
SMOOTHING = 0.5
#: Parts in which the words of a language are ranked before they meet.
PARTS = 32
#: Distinct words whose scores a worker keeps; then it starts over.
CACHE_WORDS = 300_000
#: Rows that a task holds before it hands partial word counts on.
FLUSH = 400_000


def letter_words():
    import regex

    return regex.compile(r"\p{L}+").findall


@dataclass
class LanguageModel:
    """Log frequencies by language for known words and for n-grams of each length."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]

    def word_scores(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        padded = f"^{word[:256]}$" if len(word) <= 256 else f"^{word}$"
        for n in LENGTHS:
            table = self.grams[n]
            found = [table[g] for i in range(len(padded) - n + 1) if (g := padded[i:i + n]) in table]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find = letter_words()
    counts: Counter = Counter()

    def out() -> pd.DataFrame:
        keys = list(counts)
        frame = pd.DataFrame({
            "lang": [k[0] for k in keys], "word": [k[1] for k in keys],
            "n": pd.Series([counts[k] for k in keys], dtype="int64"),
        })
        counts.clear()
        return frame

    for batch in batches:
        at = 0
        for part in slices(batch["text"].tolist()):
            for lang, text in zip(batch["lang"].iloc[at:at + len(part)], part, strict=True):
                for word, n in Counter(find(text.lower())).items():
                    counts[lang, word] += n
                if len(counts) > FLUSH:
                    yield out()
            at += len(part)
    if counts:
        yield out()


def _log_frequencies(counts: dict[str, Counter], languages: list[str], keep: int) -> dict[str, np.ndarray]:
    """The most frequent entries of each language with their smoothed log frequency in all of them."""
    share = max(1, keep // max(1, len(languages)))
    chosen = sorted({e for lang in languages for e, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:share]})
    table = np.array([[counts[lang].get(e, 0) for lang in languages] for e in chosen], dtype=float).reshape(len(chosen), len(languages))
    totals = np.array([sum(counts[lang].values()) for lang in languages], dtype=float)
    logs = np.log(table + SMOOTHING) - np.log(totals + SMOOTHING * (len(chosen) + 1))
    return dict(zip(chosen, logs, strict=True))


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang",
    fit_texts: int = FIT_TEXTS, words: int = WORDS, grams: int = GRAMS,
) -> LanguageModel:
    """Learns from the texts with a language, or from a hashed share of ``fit_texts`` of them."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    total = rows.count()
    if total > fit_texts:
        part = int(fit_texts / total * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < part)
    counted = rows.mapInPandas(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    share = max(1, words // max(1, len(languages)))
    # A language's words are ranked in salted parts first, so that the last window is bounded by the parts.
    first = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "word")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    parted = counted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    few = parted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= share)
    top = few.withColumn("place", F.row_number().over(best)).where(F.col("place") <= share).drop("place", "part").toPandas()
    by_word: dict[str, Counter] = {x: Counter() for x in languages}
    by_gram: dict[int, dict[str, Counter]] = {n: {x: Counter() for x in languages} for n in LENGTHS}
    for code, word, n in zip(top["lang"], top["word"], top["n"], strict=True):
        by_word[code][word] = int(n)
        padded = f"^{word}$"
        for size in LENGTHS:
            table = by_gram[size][code]
            for i in range(len(padded) - size + 1):
                table[padded[i:i + size]] += int(n)
    return LanguageModel(
        languages,
        _log_frequencies(by_word, languages, words),
        {n: _log_frequencies(by_gram[n], languages, grams) for n in LENGTHS},
    )


class _Cached(dict):
    """Word to row number of a growing score table."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.table = np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = self.model.word_scores(word)
        self[word] = row
        return row


def _kernel(model: LanguageModel):
    find = letter_words()
    cache = _Cached(model)
    languages = model.languages

    def run(texts: list) -> pd.DataFrame:
        langs, scores = [], []
        for text in texts:
            words = find(text.lower()) if text and languages else []
            if not words:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            if len(cache) > CACHE_WORDS:
                cache.clear()
            rows = [cache[w] for w in words]
            sums = cache.table[rows].sum(axis=0)
            best = int(np.argmax(sums))
            langs.append(languages[best])
            scores.append(float(1.0 / np.exp(np.clip(sums - sums[best], -700.0, 0.0)).sum()))
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    return run


def predict(model: LanguageModel, text: str | Column = "text") -> Column:
    """Struct with ``lang_pred`` and ``score`` for each text."""
    shared = _shared(model)
    return text_udf(lambda: _kernel(shared.value), "lang_pred string, score double")(text)


def _shared(model: LanguageModel):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)
