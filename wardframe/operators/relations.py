"""Small relational helpers: unions, conditional update, row insertion, renaming."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.sources import codes


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Union of many branches with a single duplicate elimination at the top."""
    return union_all(*frames).distinct()


def update_where(df: DataFrame, condition: Column, **values: object) -> DataFrame:
    """``UPDATE ... SET ... WHERE`` as a projection."""
    for name, value in values.items():
        new = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(name, F.when(condition, new).otherwise(F.col(name)))
    return df


def insert_rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """``INSERT ... VALUES`` of a few literal rows."""
    return df.union(df.sparkSession.createDataFrame(list(rows), df.schema))


def spanish_labels(df: DataFrame) -> DataFrame:
    """Series columns in report order with display labels."""
    keep = [c for c in df.columns if c not in codes.VITALS_ES]
    return df.select(*keep, *[F.col(c).alias(label) for c, label in codes.VITALS_ES.items()])
