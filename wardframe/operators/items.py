"""Search of the item dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.sources import codes


def discover_items(d_items: DataFrame, terms: Sequence[str] = codes.DISCOVERY_TERMS) -> DataFrame:
    """Items whose label contains a search term, one row per (item, term), in one scan."""
    label = F.lower("label")
    hits = F.array_compact(F.array(*[F.when(F.contains(label, F.lit(t)), F.lit(t)) for t in terms]))
    return d_items.select("itemid", "label", "dbsource", "linksto", F.explode(hits).alias("term"))
