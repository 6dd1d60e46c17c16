"""Binary classification scores as aggregations; labels 0/1 and probability scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardframe.functions.ranks import value_buckets
from wardframe.session import cut_lineage


def class_ratio(rows: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive, rounded, and the balanced weight of each class."""
    counts = rows.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("negatives"),
        F.count(F.when(F.col(label) == 1, 1)).alias("positives"),
    )
    n = F.col("negatives") + F.col("positives")
    return counts.select(
        "negatives", "positives",
        F.round(F.try_divide("negatives", "positives"), 3).alias("ratio"),
        F.try_divide(n, 2 * F.col("negatives")).alias("weight_negative"),
        F.try_divide(n, 2 * F.col("positives")).alias("weight_positive"),
    )


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight = n / (k * count of the class)``; as many rows as classes are joined."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy()
    weights = counts.select(
        label, (F.sum("__c").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("__c"))).alias("weight")
    )
    return rows.join(F.broadcast(weights), label)


def threshold_scores(rows: DataFrame, keys: Sequence[str] = (), label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy and support-weighted F1 from one confusion count."""
    y, p = F.col(label), F.col(predicted)
    counts = rows.groupBy(*keys).agg(
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
        F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
        F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def f1(hit, wrong, missed):
        return F.coalesce(F.try_divide(2 * hit, 2 * hit + wrong + missed), F.lit(0.0))

    return counts.select(
        *keys, "tp", "fp", "fn", "tn",
        ((tp + tn) / n).alias("accuracy"),
        ((f1(tp, fp, fn) * (tp + fn) + f1(tn, fn, fp) * (tn + fp)) / n).alias("f1_weighted"),
    )


def curve_points(rows: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """True and false positives at every distinct score, highest first.

    Equal scores are counted together first, so a score shared by very many rows is one
    row. Running totals are taken inside score buckets of about equal size and shifted by the
    totals of the higher buckets: no window spans the whole table.
    """
    y = F.col(label)
    counted = rows.groupBy(*keys, score).agg(F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg"))
    points = value_buckets(cut_lineage(counted), keys, score)
    above = Window.partitionBy(*keys).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    sums = points.groupBy(*keys, "__bucket").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    offsets = sums.select(
        *keys, "__bucket",
        (F.sum("__p").over(above) - F.col("__p")).alias("__p0"), (F.sum("__n").over(above) - F.col("__n")).alias("__n0"),
        F.sum("__p").over(whole).alias("positives"), F.sum("__n").over(whole).alias("negatives"),
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        points.withColumn("__tp", F.sum("pos").over(inside)).withColumn("__fp", F.sum("neg").over(inside))
        .join(offsets, [*keys, "__bucket"])
        .select(
            *keys, F.col(score).alias("threshold"), "pos", "neg",
            (F.col("__tp") + F.col("__p0")).alias("tp"), (F.col("__fp") + F.col("__n0")).alias("fp"),
            "positives", "negatives",
        )
        .withColumn("tpr", F.try_divide("tp", "positives"))
        .withColumn("fpr", F.try_divide("fp", "negatives"))
        .withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    )


def curve_areas(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision; NULL where only one
    class is present."""
    won = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)
    return points.groupBy(*keys).agg(
        F.try_divide(F.sum(won), F.max("positives") * F.max("negatives")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("positives")).alias("average_precision"),
    )


def report(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, weighted F1, AUC and average precision of scored rows."""
    hard = rows.withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    base = threshold_scores(hard, keys)
    areas = curve_areas(curve_points(rows, keys), keys)
    if keys:
        return base.join(areas, list(keys))
    return base.withColumn("__one", F.lit(1)).join(areas.withColumn("__one", F.lit(1)), "__one").drop("__one")
