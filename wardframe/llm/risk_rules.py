"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected, per stratum.

Base statistics come from SQL functions over the whole text. On top of a fixed base rule, each rule
below rejects a document whose statistic exceeds a cutoff. Cutoffs are chosen per stratum (the
document's language) from a fixed ladder, on labelled good documents: of n of them, k would be
rejected; the cutoff may be used if the exact (Clopper-Pearson) upper bound on the true rejection
rate is at most the rule's share of ``max_loss``, which is the case exactly when
``P(Binomial(n, share) <= k) <= level``. ``level`` is ``error`` divided by the number of tests made
(rules x ladder steps x strata), so all guarantees hold together with probability ``1 - error``; by
the union over rules a stratum loses at most ``max_loss`` of its good documents. Each rule takes the
strictest cutoff that passes; a rule that has none in a stratum (too few labels) rejects nothing there.

Everything is DataFrame and SQL functions.

Defined results: NULL is the empty text, which has no words and fails the base rule; a NULL stratum
is a stratum of its own; labels repeated or in conflict count by their minimum; no labels: only the
base rule rejects; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.llm.texts import WORD_SPACE
from wardframe.session import cut_lineage

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW_WORDS = 8
MAX_LOSS = 0.05
ERROR = 0.05
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Everything but the counted symbols and the exclamation mark.
NOT_MARK = r"[^#*$%&|<>!]+"
STRATUM_NONE = "none"


@dataclass(frozen=True)
class Rule:
    """Rejects where ``statistic`` (SQL over the base columns) exceeds a cutoff of ``ladder``."""

    name: str
    statistic: str
    ladder: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8)),
    Rule("exclamations", "n_exclaims / n_words", (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0)),
    Rule("repeats", "n_repeat_words / n_words", (0.0, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2, 0.25, 0.275)),
    Rule("lines", "n_dup_lines / n_words", (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.2, 0.3)),
    Rule("long_words", "word_chars / n_words", (5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    Rule("short_words", "-1.0 * word_chars / n_words", (-6.0, -5.5, -5.0, -4.5, -4.0, -3.75, -3.5, -3.25, -3.0, -2.5, -2.0, -1.0)),
    Rule("brevity", "-1.0 * n_words", (-150.0, -100.0, -80.0, -60.0, -50.0, -45.0, -40.0, -35.0, -30.0, -27.0, -24.0, -21.0)),
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, though ``use`` names it often."""
    return F.transform(F.array(value), use)[0]


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of every window of eight words; equal windows have equal hashes."""
    def of_hashes(h: Column) -> Column:
        last = F.size(h) - (WINDOW_WORDS - 1)
        starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW_WORDS)]))

    return once(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _covered(windows: Column) -> Column:
    """Words inside a window that occurs at least twice: sorted hashes bring equal windows together."""
    def repeated(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        return F.filter(
            pairs,
            lambda x, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(pairs, k + 1)["h"] == x["h"])),
        )

    def covered(starts: Column) -> Column:
        state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            starts, state,
            lambda s, p: F.struct(
                (p + WINDOW_WORDS).alias("end"), (s["n"] + p + WINDOW_WORDS - F.greatest(p, s["end"])).alias("n")
            ),
        )["n"]

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.sort_array(F.transform(once(pairs, repeated), lambda x: x["i"]))
    return once(starts, covered)


def base_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_exclaims, n_dup_lines, n_repeat_words, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, WORD_SPACE), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE))
    marks = F.regexp_replace(body, NOT_MARK, "")  # one pass; what is left is short
    repeats = once(words, lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        once(_window_hashes(ws), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))
        .cast("long").alias("n_repeat_words"),
    ))
    out = df.select(
        *keep,
        repeats.alias("r"),
        once(marks, lambda m: F.struct(
            F.length(F.replace(m, F.lit("!"), F.lit(""))).cast("long").alias("symbols"), F.length(m).cast("long").alias("all"),
        )).alias("m"),
        once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.select(
        *keep, "r.n_words", "r.word_chars", F.col("m.symbols").alias("n_symbols"),
        (F.col("m.all") - F.col("m.symbols")).alias("n_exclaims"), "n_dup_lines", "r.n_repeat_words",
    ).withColumn("base_failed", failed)


def log_factorial(n: Column) -> Column:
    """ln n! to about 1e-12: Stirling's series, shifted up by eight so that it holds from zero."""
    x = n.cast("double") + 9
    shift = F.lit(0.0)
    for i in range(1, 9):
        shift = shift + F.log(n.cast("double") + i)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k below the mean: terms from k downwards, the rest by its geometric bound."""
    last = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p) + 100)).cast("int")
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")), state,
        lambda s, i: once(
            s["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p),
            lambda t: F.struct(t.alias("term"), (s["total"] + t).alias("total")),
        ),
    )
    ratio = k * (1 - p) / ((n - k + 1) * p)
    rest = F.when((steps < k) & (ratio < 1), summed["term"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.when(k >= n * p, 1.0).otherwise(F.exp(last) * (summed["total"] + rest))


def _levels() -> Column:
    """Per rule, how many steps of its ladder the document exceeds."""
    steps = []
    for i, rule in enumerate(RULES):
        value = F.expr(rule.statistic)
        level = sum((F.when(value > g, 1).otherwise(0) for g in rule.ladder), F.lit(0))
        steps.append(F.struct(F.lit(i).alias("rule"), level.alias("level")))
    return F.array(*steps)


def certified_cutoffs(good: DataFrame, stratum: str = "stratum", max_loss: float = MAX_LOSS, error: float = ERROR) -> DataFrame:
    """Rows of stratum, rule, step: the strictest certified step of the rule's ladder in the stratum.

    ``good`` holds the statistics of labelled good documents that pass the base rule.
    """
    share = max_loss / len(RULES)
    counted = (
        good.select(stratum, F.explode(_levels()).alias("l")).groupBy(stratum, "l.rule", "l.level").agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(stratum, "rule"))
    strata = counted.select(stratum).distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    ladder = (
        counted.withColumn("total", total)
        .groupBy(stratum, "rule").agg(F.collect_list(F.struct("level", "n")).alias("seen"), F.max("total").alias("total"))
        .select(stratum, "rule", "total", "seen", F.explode(F.sequence(F.lit(1), F.lit(max(len(r.ladder) for r in RULES)))).alias("step"))
    )
    lost = F.aggregate("seen", F.lit(0).cast("long"), lambda s, x: s + F.when(x["level"] >= F.col("step"), x["n"]).otherwise(0))
    tests = len(RULES) * max(len(r.ladder) for r in RULES)
    tested = ladder.withColumn("lost", lost).crossJoin(F.broadcast(strata))  # one row
    sure = binomial_tail(F.col("lost"), F.col("total"), share) <= error / (tests * F.col("n_strata"))
    return tested.where(sure).groupBy(stratum, "rule").agg(F.min("step").alias("step"))


def judge(statistics: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """``statistics`` with ``kept``: passes the base rule and every certified cutoff of its stratum."""
    own = cutoffs.groupBy(stratum).agg(F.collect_list(F.struct("rule", "step")).alias("cuts"))
    levels = F.transform(_levels(), lambda x: x["level"])
    over = F.exists(
        F.coalesce(F.col("cuts"), F.array().cast("array<struct<rule:int,step:int>>")),
        lambda c: F.get(F.col("levels"), c["rule"]) >= c["step"],
    )
    return (
        statistics.join(own, stratum, "left").withColumn("levels", levels)
        .withColumn("kept", ~F.col("base_failed") & ~over).drop("cuts", "levels")
    )


def apply_rules(
    documents: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS, error: float = ERROR
) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every document."""
    stratum = F.coalesce(F.col("lang"), F.lit(STRATUM_NONE)).alias("stratum")
    measured = cut_lineage(base_statistics(documents.select("doc_id", "text", stratum), "text", ["doc_id", "stratum"]))
    marked = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    good = measured.where("not base_failed").join(marked.select("doc_id"), "doc_id", "left_semi")
    return judge(measured, certified_cutoffs(good, max_loss=max_loss, error=error))
