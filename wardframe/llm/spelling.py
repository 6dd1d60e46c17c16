"""Spelling variants: words one edit apart, found through sorted rotations (a permuterm index).

Every word is closed by a terminator and turned: ``word$`` gives ``ord$w``, ``rd$wo`` and so on. A
word with a hole, ``wo?d``, turned until the hole is last, reads ``d$wo?``: all words that differ
in that character only share the prefix ``d$wo``, and the word that lacks the character has
exactly ``d$wo`` among its own rotations. So a replaced, inserted or deleted character turns
into a range of sorted rotations with a common prefix, and the edited character is the one skipped.

``rotations`` writes, for a word of n characters, n + 1 whole rotations and n with the last character
skipped. Rows of one prefix lie together after the sort; each such group is scanned once and emits
its neighbours. A group holds at most one word for each letter of the alphabet and one word that lacks
it (91 in all), whatever the table: no group grows with the data. A deleted character of a run
of equal ones (``aab``) gives the same word at each place of the run, so only the run's first place
may meet a whole rotation; with that, each pair of neighbours is found in exactly one group.

Defined results: NULL and empty texts hold no words; a NULL doc_id counts as the empty text in the
drawing of typos; repeated rows count repeatedly; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.session import cut_lineage

#: Runs of ASCII and Latin-1 letters (with the two signs that stand among them).
RUN = "[A-Za-zÀ-ÿ]+"
NOT_RUN = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Closes a word; not a letter.
END = "$"
#: One run in so many loses a character.
TYPO = 199
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as the word it stands for.
FORM_RATIO = 5


def runs_with_typos(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", typo: int = TYPO) -> DataFrame:
    """``word`` for each run of the texts, lower-cased in A-Z; a hash of id and run deletes a character of some."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    split = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.split(lowered, NOT_RUN)).alias("r"))
    h = F.crc32(F.concat_ws(":", "d", "r"))
    place = (h % F.length("r")).cast("int")
    short = F.concat(F.expr("substring(r, 1, p)"), F.expr("substring(r, p + 2)"))
    runs = split.where("r <> ''").select("r", h.alias("h"), place.alias("p"))
    return runs.select(F.when(F.col("h") % typo == 0, short).otherwise(F.col("r")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n`` for the words long and frequent enough; counts combine before the shuffle."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix``, ``word``, ``n``, ``whole`` (nothing skipped) and ``meets`` (may meet a whole rotation)."""
    marked = f"concat(word, '{END}')"
    whole = F.expr(
        f"transform(sequence(0, length(word)), i -> struct(concat(substring({marked}, i + 1), substring(word, 1, i)) AS prefix,"
        " true AS whole, true AS meets))"
    )
    skipping = F.expr(
        f"transform(sequence(1, length(word)), i -> struct(concat(substring({marked}, i + 1), substring(word, 1, i - 1)) AS prefix,"
        " false AS whole, i = 1 OR substring(word, i, 1) <> substring(word, i - 1, 1) AS meets))"
    )
    turned = words.where("word <> ''").select("word", "n", F.inline(F.concat(whole, skipping)))
    return turned.select("prefix", F.struct("word", "n", "whole", "meets").alias("at"))


def _are_near(a: str, b: str) -> Column:
    """Two members of one group: both skipped (a replacement), or one skipped and one whole (an indel)."""
    return F.expr(f"({a}.whole = false AND {b}.whole = false AND {a}.word <> {b}.word) OR ({a}.whole <> {b}.whole AND {a}.meets AND {b}.meets)")


def neighbours(words: DataFrame) -> DataFrame:
    """Every ordered pair of words one edit apart: ``word``, ``n``, ``near``, ``near_n``; each pair once."""
    groups = rotations(words).groupBy("prefix").agg(F.collect_list("at").alias("group")).where(F.size("group") > 1)
    ones = groups.select(F.explode("group").alias("a"), "group")
    pairs = ones.select("a", F.explode("group").alias("b")).where(_are_near("a", "b"))
    return pairs.select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain, for rows (word, form). Chains halve in each round; forms never form a ring."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        now = step.drop("next")
        if step.where("next IS NOT NULL").isEmpty():
            return now


def group_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for each row (word, n) of distinct words."""
    words = cut_lineage(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = neighbours(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    found = cut_lineage(found.select(
        "word", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")
    ))
    ends = roots(found.where("form IS NOT NULL"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
