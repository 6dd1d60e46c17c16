"""SimHash near-duplicates: fingerprints, and exact search of all links within a few differing bits.

Search by the generalised pigeonhole principle. The 64 bits are dealt into partitions, correlated
bits together, so that a partition that says little does not weaken the others. A fingerprint within
``reach`` bits of a query differs by at most t_i bits in some partition i for any thresholds t_i >= -1
with sum(t_i) = reach - partitions + 1. For each fingerprint a dynamic programme picks the
thresholds of least estimated cost: probes sent plus candidates met, the latter from the distances
to a bounded hashed sample of fingerprints, partition by partition. Probes (the partition's value
with up to t_i bits flipped) meet the index by an equality join; candidates are verified on all bits.

Where even the best thresholds promise more than ``PROBE_COST`` (a dense crowd of near copies, whose
pairs would grow with the square of its size), two such fingerprints are linked without pairs: each
sends itself and its 64 one-bit neighbours as meeting points. Two fingerprints within two bits share
one, and all that meet at one are within two bits of each other, so they are linked to their
smallest. At most 65 fingerprints meet at a point. Links between a dense and another fingerprint are
found by the latter's probes. The result is therefore exact whatever the estimate says; the sample
only steers the cost.

All work is on distinct fingerprints: equal texts fold before any search, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.llm.components import components
from wardframe.llm.texts import text_udf
from wardframe.session import cut_lineage

SEED = 42
BITS = 64
PARTITIONS = 3
#: Fingerprints that steer partitions and thresholds; a hashed share of all.
SAMPLE = 2048
#: Estimated probes and candidates of one fingerprint beyond which meeting points are cheaper.
PROBE_COST = 260.0


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """Majority bits of the shingles' XXH64; zero for a text without words."""
    import xxhash

    lowered = (text or "").encode("utf-8", "replace").lower()  # bytes: lower-cases A-Z only
    words = lowered.split()  # bytes: splits at the six white-space characters only
    if not words:
        return 0
    hashed = xxhash.xxh64_digest
    n = len(words)
    if n <= words_per_shingle:
        digests = hashed(b" ".join(words), SEED)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = words_per_shingle - 1
        digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts[:n - k].tolist(), ends[k:].tolist(), strict=True)])
    values = np.frombuffer(digests, dtype=">u8")
    bits = 0
    for at in range(BITS):
        bits |= int(2 * np.count_nonzero(values & np.uint64(1 << at)) > len(values)) << at
    return bits


def _fold(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _kernel(words_per_shingle: int):
    def run(texts: list) -> pd.DataFrame:
        found = np.array([fingerprint(t, words_per_shingle) for t in texts], dtype=np.uint64)
        return pd.DataFrame({"f": pd.Series(_fold(found), dtype="int64")})

    return run


def fingerprint_column(text: str | Column, words_per_shingle: int) -> Column:
    """The fingerprint as a (signed) long."""
    return text_udf(lambda: _kernel(words_per_shingle), "f long")(text)["f"]


def correlated_partitions(sample: np.ndarray, parts: int = PARTITIONS) -> list[list[int]]:
    """Deals the 64 bits into ``parts`` equal groups, each bit to the group it correlates with most.

    Groups grow in turn from the most correlated bit left over, which keeps their sizes equal.
    """
    bits = (sample[:, None].view(np.uint64) >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    centred = bits.astype(float) - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    near = np.abs(centred.T @ centred) / np.outer(spread, spread)
    np.fill_diagonal(near, 0.0)
    left = list(range(BITS))
    sizes = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    groups = []
    for size in sizes:
        first = max(left, key=lambda b: (near[b, left].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (near[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


class Prober:
    """Values, thresholds and probes of fingerprints under one partitioning."""

    def __init__(self, groups: list[list[int]], sample: np.ndarray, total: int, reach: int):
        self.groups = groups
        self.reach = reach
        self.masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
        self.sample = sample.view(np.uint64)
        self.scale = total / max(1, len(sample))
        self.flips = [
            [np.array([sum(1 << b for b in c) for c in combinations(g, t)] or [0], dtype=np.uint64) for t in range(reach + 1)]
            for g in groups
        ]

    def _costs(self, fps: np.ndarray) -> np.ndarray:
        """[fingerprint, partition, threshold + 1]: probes sent plus candidates expected."""
        out = np.zeros((len(fps), len(self.groups), self.reach + 2))
        for i, mask in enumerate(self.masks):
            apart = np.bitwise_count((fps[:, None] ^ self.sample[None, :]) & mask)
            probes = 0
            for t in range(self.reach + 1):
                probes += len(self.flips[i][t])
                out[:, i, t + 1] = probes + self.scale * (apart <= t).sum(axis=1)
        return out

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best thresholds per fingerprint and their cost, by dynamic programming over the partitions."""
        costs = self._costs(fps)
        parts = len(self.groups)
        goal = self.reach + 1  # sum of (t + 1) over the partitions
        best = np.full((len(fps), goal + 1), np.inf)
        best[:, 0] = 0.0
        choice = np.zeros((len(fps), parts, goal + 1), dtype=int)
        for i in range(parts):
            after = np.full_like(best, np.inf)
            for used in range(goal + 1):
                options = np.stack([best[:, used - u] + costs[:, i, u] for u in range(min(used, self.reach + 1) + 1)])
                choice[:, i, used] = options.argmin(axis=0)
                after[:, used] = options.min(axis=0)
            best = after
        picked = np.zeros((len(fps), parts), dtype=int)
        left = np.full(len(fps), goal)
        rows = np.arange(len(fps))
        for i in range(parts - 1, -1, -1):
            picked[:, i] = choice[rows, i, left]
            left = left - picked[:, i]
        return picked - 1, best[:, goal]

    def probes(self, fps: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, partition and value of every probe."""
        f, p, v = [], [], []
        for i, mask in enumerate(self.masks):
            for t in range(self.reach + 1):
                own = fps[picked[:, i] >= t]
                flips = self.flips[i][t]
                if len(own):
                    f.append(np.repeat(own, len(flips)))
                    v.append(((own & mask)[:, None] ^ flips[None, :]).ravel())
                    p.append(np.full(len(own) * len(flips), i))
        if not f:
            return np.array([], np.uint64), np.array([], int), np.array([], np.uint64)
        return np.concatenate(f), np.concatenate(p), np.concatenate(v)


def _probe_rows(prober: Prober, use_meeting: bool):
    """Rows of kind 0 (probe at partition and value) or 1 (meeting point of a dense fingerprint)."""
    around = np.array([0] + [1 << b for b in range(BITS)], dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                fps = batch["f"].to_numpy()[start:start + 1024].view(np.uint64)
                picked, cost = prober.thresholds(fps)
                dense = (cost > PROBE_COST) & use_meeting
                f, p, v = prober.probes(fps[~dense], picked[~dense])
                yield pd.DataFrame({"kind": 0, "part": p.astype("int32"), "value": _fold(v), "f": _fold(f)})
                if dense.any():
                    own = fps[dense]
                    yield pd.DataFrame({
                        "kind": 1, "part": np.int32(0), "value": _fold((own[:, None] ^ around[None, :]).ravel()),
                        "f": _fold(np.repeat(own, len(around))),
                    })

    return run


def links(distinct: DataFrame, reach: int = 2, partitions: int = PARTITIONS, sample_size: int = SAMPLE) -> DataFrame:
    """Edges (x, y) between distinct fingerprints in column ``f`` that connect all links within ``reach`` bits.

    Every pair within reach is an edge or joined by edges through a meeting point of theirs, so the
    components are those of the full link graph.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    share = min(1.0, sample_size / max(1, total))
    chosen = distinct.where(F.pmod(F.xxhash64("f", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = np.array(sorted(r["f"] for r in chosen.collect()), dtype=np.int64)
    prober = Prober(correlated_partitions(sample, partitions), sample, total, reach)
    sent = spark.sparkContext.broadcast(prober)
    meet = reach == 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _probe_rows(sent.value, meet)(batches)

    rows = cut_lineage(distinct.select("f").mapInPandas(run, "kind int, part int, value long, f long"))
    signed = [int(_fold(np.array([m]))[0]) for m in prober.masks]
    index = distinct.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m)) for m in signed])).alias("part", "value"))
    probes = rows.where("kind = 0").select("part", "value", F.col("f").alias("x"))
    met = probes.join(index.withColumnRenamed("f", "y"), ["part", "value"]).where("x <> y")
    pairs = met.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= reach).select("x", "y")
    points = rows.where("kind = 1").select("value", "f")
    least = points.groupBy("value").agg(F.min("f").alias("x"), F.max("f").alias("last")).where("x < last").select("value", "x")
    stars = points.join(least, "value").where("f <> x").select("x", F.col("f").alias("y"))
    return pairs.union(stars)


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3, reach: int = 2
) -> DataFrame:
    """``key``, ``fingerprint`` (hexadecimal) and ``component_id``, the smallest key reachable over links.

    Defined results: a NULL or wordless text has fingerprint zero and is linked like any other; a
    text of fewer words than a shingle is one shingle; repeated keys give repeated rows; rows with a
    NULL key are in no component of their own: they take that of their fingerprint's other rows,
    else NULL; an empty table gives an empty table.
    """
    marked = cut_lineage(documents.select(F.col(key).alias("key"), fingerprint_column(F.col(text), words_per_shingle).alias("f")))
    folded = cut_lineage(marked.groupBy("f").agg(F.min("key").alias("first")))
    found = components(links(folded.select("f"), reach), "x", "y")
    by_print = (
        folded.join(found, folded["f"] == found["node"], "left")
        .select("f", "first", F.coalesce("component", "f").alias("component"))
    )
    least = by_print.groupBy("component").agg(F.min("first").alias("component_id"))
    named = by_print.join(least, "component").select("f", "component_id")
    return marked.join(named, "f").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )
