"""Shared helpers: reading tables, running a text kernel in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handed to a kernel at once; a single longer text forms its own slice.
SLICE_CHARS = 4_000_000
#: Words are runs of anything but these six characters.
WORD_SPACE = r"[\x20\x09-\x0D]+"

Kernel = Callable[[list], pd.DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list) -> Iterator[list]:
    """Consecutive sublists of bounded total length, so that a batch of long texts never piles up."""
    part: list = []
    size = 0
    for text in texts:
        length = len(text) if text else 0
        if part and size + length > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += length
    if part:
        yield part


def text_udf(make: Callable[[], Kernel], schema: str) -> Callable[[str | Column], Column]:
    """Struct column from a text column; ``make`` builds the kernel once per Python worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kernel = make()
        for batch in batches:
            parts = [kernel(part) for part in slices(batch.tolist())]
            yield pd.concat(parts, ignore_index=True) if parts else kernel([])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (NULL for a NULL id)."""
    return F.crc32(F.col(column).cast("string")) % modulus


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet, whatever it carries along."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
