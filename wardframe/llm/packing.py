"""Best-fit packing of documents into bins, under conflicts.

A bin never holds two pieces of the same source or of the same duplicate cluster. Within a packing
group pieces are taken by falling length; bins are kept ordered by what room they have left, each
with a bitmap of its sources and one of its clusters. The search starts at the tightest bin that
has room and moves on to the next larger residual until one is compatible; if none is, a new bin
opens. Texts longer than a bin are cut into full pieces, which need no search, and a rest.

Spark deals documents to packing groups of bounded expected size by a salted hash of the id, so one
hot source or cluster spreads over all groups; only ids, lengths and codes travel, never texts.

Defined results: a NULL or empty text has length 0 and still gets one piece; NULL sources are no
conflict, nor are NULL clusters; repeated rows are packed each, in different bins if their cluster
is the same; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a bin: about 2,048 tokens of a byte-level vocabulary.
CAPACITY = 8192
#: Documents of a packing group, on average.
GROUP_DOCUMENTS = 4096
SCHEMA = "group long, doc_id {kind}, piece int, start long, length long, bin int, room long"


class Bins:
    """Open bins ordered by residual room, with conflict bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (room, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def open(self, length: int, source: int, cluster: int) -> int:
        number = len(self.sources)
        self.sources.append(source)
        self.clusters.append(cluster)
        if self.capacity > length:
            insort(self.order, (self.capacity - length, number))
        return number

    def place(self, length: int, source: int, cluster: int) -> int:
        """The compatible bin of least sufficient room; ties to the older bin; else a new bin."""
        order, sources, clusters = self.order, self.sources, self.clusters
        for at in range(bisect_left(order, (length, -1)), len(order)):
            room, number = order[at]
            if not (sources[number] & source or clusters[number] & cluster):
                del order[at]
                sources[number] |= source
                clusters[number] |= cluster
                if room > length:
                    insort(order, (room - length, number))
                return number
        return self.open(length, source, cluster)


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Per document its pieces as (piece, start, length, bin). NULL sources and clusters never conflict."""
    bit_of_source = {s: 1 << i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    shared = [c for c, n in seen.items() if n > 1 and c is not None]
    bit_of_cluster = {c: 1 << i for i, c in enumerate(sorted(shared))}
    bins = Bins(capacity)
    out: list[list] = [[] for _ in lengths]
    rests = []
    for d, length in enumerate(lengths):
        full, rest = divmod(length, capacity)
        for piece in range(full):
            number = bins.open(capacity, bit_of_source.get(sources[d], 0), bit_of_cluster.get(clusters[d], 0))
            out[d].append((piece, piece * capacity, capacity, number))
        if rest or not full:
            rests.append((-rest, d, full))
    for negative, d, full in sorted(rests):
        number = bins.place(-negative, bit_of_source.get(sources[d], 0), bit_of_cluster.get(clusters[d], 0))
        out[d].append((full, full * capacity, -negative, number))
    return out


def best_fit(
    items: DataFrame, key: str, length: str, source: str, cluster: str,
    capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS,
) -> DataFrame:
    """Rows of ``key``, piece, start, length, bin_id and room (what the bin has left in the end)."""
    kind = items.schema[key].dataType.simpleString()
    small = items.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"),
        F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"),
    )
    groups = max(1, -(-small.count() // group_documents))
    spread = small.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "length", "source", "cluster"], kind="stable").reset_index(drop=True)
        codes = [frame[c].where(frame[c].notna(), None).tolist() for c in ("source", "cluster")]
        placed = pack(frame["length"].tolist(), *codes, capacity)
        used: dict[int, int] = {}
        for pieces in placed:
            for _, _, n, number in pieces:
                used[number] = used.get(number, 0) + n
        at = [d for d, pieces in enumerate(placed) for _ in pieces]
        flat = [p for pieces in placed for p in pieces]
        return pd.DataFrame({
            "group": frame["group"].iloc[0], "doc_id": frame["doc_id"].iloc[at].to_numpy(),
            "piece": pd.Series([p[0] for p in flat], dtype="int32"), "start": pd.Series([p[1] for p in flat], dtype="int64"),
            "length": pd.Series([p[2] for p in flat], dtype="int64"), "bin": pd.Series([p[3] for p in flat], dtype="int32"),
            "room": pd.Series([capacity - used[p[3]] for p in flat], dtype="int64"),
        })

    packed = spread.groupBy("group").applyInPandas(run, SCHEMA.format(kind=kind))
    return packed.select(
        F.col("doc_id").alias(key), "piece", "start", "length",
        F.concat_ws("-", "group", "bin").alias("bin_id"), "room",
    )


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Packs documents by bytes of UTF-8; texts that are equal but for the case of letters form a cluster."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cluster = F.md5(F.lower(text))
    items = documents.select("doc_id", F.octet_length(text).alias("length"), "source", cluster.alias("cluster"))
    return best_fit(items, "doc_id", "length", "source", "cluster", capacity, group_documents)
