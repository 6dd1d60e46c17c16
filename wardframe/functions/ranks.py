"""Deterministic pseudo-random keys and exact global ranks without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash keys lie in [0, KEY_RANGE): twelve hexadecimal digits of a digest.
KEY_RANGE = 2**48
#: Buckets of the key range when the n smallest of a group are sought.
SELECT_BUCKETS = 4096


def hash_key(ident: Column, seed: Column | int = 0) -> Column:
    """Integer in [0, 2**48) from a digest of ``ident`` and ``seed`` as text.

    A digest mixes: draws of different seeds, or of neighbouring ids, are independent of each
    other. Any SQL engine with md5 can repeat it.
    """
    offset = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat_ws(":", ident.cast("string"), offset.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def unit_draw(ident: Column, seed: Column | int = 0) -> Column:
    """Uniform draw in (0, 1)."""
    return (hash_key(ident, seed) + 1) / F.lit(float(KEY_RANGE) + 1)


def normal_draw(ident: Column, seed: Column | int = 0) -> Column:
    """Standard normal draw by the Box-Muller transform of two independent hash draws."""
    angle = unit_draw(F.concat(ident.cast("string"), F.lit(":angle")), seed)
    return F.sqrt(-2 * F.log(unit_draw(ident, seed))) * F.cos(2 * F.pi() * angle)


def exact_rank(
    df: DataFrame,
    key: str,
    ties: Sequence[str],
    groups: Sequence[str] = (),
    key_max: int = KEY_RANGE,
    buckets: int | None = None,
    rank: str = "rank",
    total: str | None = "total",
) -> DataFrame:
    """Row number of each row by ``(key, ties)`` within ``groups``, at any size.

    One window over a whole group would run in a single task. Instead the key range
    [0, key_max) is cut into buckets; rows are numbered inside their bucket and the
    number of rows in earlier buckets (a table of at most ``buckets`` rows per group)
    is added. ``key`` must spread over its range, as ``hash_key`` does. Unless given, the
    number of buckets follows the shuffle partitions, which a cluster sets to its data.
    """
    bucket = "__bucket"
    if buckets is None:
        buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn(
        bucket, F.least(F.floor(F.col(key) / F.lit(key_max / buckets)), F.lit(buckets - 1))
    )
    within = Window.partitionBy(*groups, bucket).orderBy(key, *ties)
    before = Window.partitionBy(*groups).orderBy(bucket)
    whole = Window.partitionBy(*groups)
    offsets = (
        cut.groupBy(*groups, bucket)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
        .withColumn("__total", F.sum("__n").over(whole))
        .drop("__n")
    )
    out = (
        cut.withColumn("__local", F.row_number().over(within))
        .join(offsets, [*groups, bucket])
        .withColumn(rank, (F.col("__local") + F.col("__before")).cast("long"))
    )
    if total:
        out = out.withColumn(total, F.col("__total").cast("long"))
    return out.drop(bucket, "__local", "__before", "__total")


def among_first(
    df: DataFrame, key: str, ties: Sequence[str], groups: Sequence[str], wanted: Column, name: str, where: Column | None = None,
) -> DataFrame:
    """Adds ``name``: is the row among the ``wanted`` smallest by ``(key, ties)`` of its group?

    No row is shuffled for it. Counts per group and bucket of the key range show which bucket holds the
    last wanted row; only that bucket's rows are sorted, and every row is compared with the one found.
    ``wanted`` may use the group columns and ``__total``, the group's rows; rows outside ``where`` are
    neither counted nor chosen. ``key`` must spread over [0, KEY_RANGE), as ``hash_key`` does. The
    table of last rows has one row a group: groups are meant to be few (features x repetitions).
    """
    by = list(groups) or ["__all"]
    rows = df if groups else df.withColumn("__all", F.lit(0))
    bucket = F.least(F.floor(F.col(key) / F.lit(KEY_RANGE / SELECT_BUCKETS)), F.lit(SELECT_BUCKETS - 1)).alias("__bucket")
    counted = rows if where is None else rows.where(where)
    counted = counted.select(*by, bucket, F.col(key).alias("__key_of"), *[F.col(t).alias(f"__tie_{t}") for t in ties])
    before, whole = Window.partitionBy(*by).orderBy("__bucket"), Window.partitionBy(*by)
    sizes = counted.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumns({
        "__upto": F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, 0)), "__total": F.sum("__n").over(whole)
    }).withColumn("__wanted", wanted.cast("long"))
    holding = sizes.where("__upto - __n < __wanted AND (__wanted <= __upto OR (__upto = __total AND __wanted > __total))")
    holding = holding.select(*by, "__bucket", F.least(F.col("__wanted"), F.col("__total")).alias("__wanted"), (F.col("__upto") - F.col("__n")).alias("__before"))
    inside = counted.join(F.broadcast(holding), [*by, "__bucket"])
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__key_of", *[f"__tie_{t}" for t in ties]))
    at = F.struct("__key_of", *[f"__tie_{t}" for t in ties]).alias("__last")
    last = inside.withColumn("__place", place).where("__place = __wanted - __before").select(*by, at)
    mine = F.struct(F.col(key).alias("__key_of"), *[F.col(t).alias(f"__tie_{t}") for t in ties])
    chosen = F.coalesce(mine <= F.col("__last"), F.lit(False))
    return rows.join(F.broadcast(last), by, "left").withColumn(name, chosen if where is None else where & chosen).drop("__last", "__all")


def value_buckets(df: DataFrame, keys: Sequence[str], value: str, name: str = "__bucket", buckets: int | None = None) -> DataFrame:
    """Adds a bucket number that rises with ``value`` within ``keys`` (equal values share one).

    The bounds are approximate quantiles of the rows, so buckets hold about equally many rows
    whatever the distribution: neither a far outlier nor values that lie close together fill one
    bucket. The sketch combines on the map side; each row finds its place by binary search in
    the array of bounds. NULL values fall into bucket 0.
    """
    if buckets is None:
        wanted = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = 2 ** min(12, max(6, math.ceil(math.log2(wanted))))
    by = list(keys) or ["__all"]
    rows = df if keys else df.withColumn("__all", F.lit(0))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.groupBy(*by).agg(F.percentile_approx(value, shares, 20 * buckets).alias("__bounds"))
    halves = F.array(*[F.lit(2**i) for i in reversed(range(int(math.log2(buckets))))])
    place = F.aggregate(
        halves, F.lit(0), lambda at, s: at + F.when(F.get("__bounds", at + s - 1) < F.col(value), s).otherwise(0)
    )
    return rows.join(bounds, by).withColumn(name, place).drop("__bounds", "__all")


def positions(df: DataFrame, block: Sequence[str], name: str = "position") -> DataFrame:
    """Zero-based line position of a scan, for formats that carry meaning by row order.

    ``block`` orders the input blocks (file and offset); inside a block
    ``monotonically_increasing_id`` follows the read order. Only one row per block goes
    through the offset window.
    """
    marked = df.withColumn("__seq", F.monotonically_increasing_id())
    order = Window.orderBy(*block)
    offsets = (
        marked.groupBy(*block)
        .agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    )
    return (
        marked.join(offsets, list(block))
        .withColumn(name, F.col("__seq") - F.col("__first") + F.col("__before"))
        .drop("__seq", "__first", "__n", "__before")
    )
