"""Nearest neighbours by inner product: a forest of random-projection trees with one shared queue.

Largest inner product becomes smallest distance by one extra coordinate, sqrt(M^2 - |x|^2) with M the
largest norm (zero for queries). Trees are fitted on at most ``fit_rows`` distinct vectors (a hashed
share): each node draws vectors at random, lets them pull apart two centres in a few rounds and
splits midway between these. Every distinct vector is then sent down every tree, so the index holds
all rows. A query walks all trees through one priority queue ordered by the worst margin on the way,
until the leaves it has opened hold its budget of vectors and some tree alone holds enough for a full
answer. The budget is a share of the table, the smallest that reaches ``recall`` for sampled queries
searched within the sample: small for vectors with structure, large for vectors without any (directions
drawn at random, as in the supplied tables, where neighbours hardly stand out). Leaf contents are
scored by blocks in tasks; the survivors are scored again, exactly, on the original vectors.

Skew: equal vectors fold to one class that carries its k + 1 smallest ids (no answer needs more);
a leaf of more than ``LEAF_CHUNK`` classes is cut into chunks by a salted hash and scored in several
places. The trees and the leaf counts are bounded by ``fit_rows``; for tables far larger than that,
raise it (leaves grow with the table otherwise, which costs time, not recall).

Defined results: vectors that are NULL, zero or hold NULL or non-finite components take no part, nor
do those of a length other than the most common one; a repeated id counts once, with its smallest
vector; ties go to the smaller id; fewer candidates than k: all of them; an empty table: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.session import cut_lineage

TREES = 8
LEAF = 512
FIT_ROWS = 32_768
#: Recall that the budget must reach for sampled queries within the sample.
RECALL = 0.95
TRIALS = 128
#: Budgets tried: vectors in the opened leaves of all trees, as a share of the table.
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0)
LEAF_CHUNK = 2048
#: Answers that a task holds before it combines them.
COMBINE_ROWS = 400_000
SEED = 5
#: Vectors drawn to place the plane of a node.
DRAWN = 256


@dataclass
class Tree:
    """Inner nodes: direction, threshold, children (an inner node, or ``~leaf``)."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray


def _between(drawn: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit direction and threshold of the plane midway between two centres of ``drawn``."""
    a, b = drawn[0], drawn[1]
    for _ in range(3):
        nearer = drawn @ (a - b) > (a @ a - b @ b) / 2
        if nearer.all() or not nearer.any():
            break
        a, b = drawn[nearer].mean(axis=0), drawn[~nearer].mean(axis=0)
    w = a - b
    w = w / (np.linalg.norm(w) or 1.0)
    return w, float((a + b) @ w / 2)


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple[Tree, int]:
    """One tree over ``points`` and its number of leaves."""
    directions, thresholds, children = [], [], []
    leaves = 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        if len(rows) > leaf:
            for _ in range(4):
                w, cut = _between(points[rng.choice(rows, min(len(rows), DRAWN), replace=False)])
                below = points[rows] @ w < cut
                if 0 < below.sum() < len(rows):
                    split = w, cut, below
                    break
        if split is None:
            at, leaves = ~leaves, leaves + 1
        else:
            at = len(directions)
            directions.append(split[0])
            thresholds.append(split[1])
            children.append([0, 0])
            todo += [(rows[split[2]], at, 0), (rows[~split[2]], at, 1)]
        if parent >= 0:
            children[parent][side] = at
    d = points.shape[1]
    return Tree(np.array(directions).reshape(-1, d), np.array(thresholds), np.array(children, dtype=np.int64).reshape(-1, 2)), leaves


@dataclass
class Forest:
    """Trees whose leaves are numbered across the forest."""

    trees: list[Tree]
    first_leaf: np.ndarray
    norm: float

    @classmethod
    def fit(cls, vectors: np.ndarray, norm: float, trees: int, leaf: int) -> "Forest":
        rng = np.random.default_rng(SEED)
        points = cls.lifted(vectors, norm)
        grown = [grow(points, leaf, rng) for _ in range(trees)]
        return cls([t for t, _ in grown], np.cumsum([0] + [n for _, n in grown]), norm)

    @staticmethod
    def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
        rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0.0))
        return np.column_stack([vectors, rest])

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """[row, tree] leaf numbers of indexed vectors."""
        points = self.lifted(vectors, self.norm)
        out = np.zeros((len(points), len(self.trees)), dtype=np.int64)
        for t, tree in enumerate(self.trees):
            at = np.zeros(len(points), dtype=np.int64) if len(tree.directions) else np.full(len(points), -1)
            while (open_rows := np.nonzero(at >= 0)[0]).size:
                node = at[open_rows]
                right = (points[open_rows] * tree.directions[node]).sum(axis=1) >= tree.thresholds[node]
                at[open_rows] = tree.children[node, right.astype(int)]
            out[:, t] = self.first_leaf[t] + ~at
        return out

    def open_leaves(self, query: np.ndarray, counts: np.ndarray, budget: float, least: int) -> list[int]:
        """Leaves in the order of the shared queue until enough vectors are in them."""
        point = np.append(query, 0.0)
        margins = [tree.directions @ point - tree.thresholds for tree in self.trees]
        heap = [(0.0, t, 0 if len(tree.directions) else -1) for t, tree in enumerate(self.trees)]
        heapq.heapify(heap)
        opened, total = [], 0
        per_tree = [0] * len(self.trees)
        while heap and (total < budget or max(per_tree) < least):
            worst, t, node = heapq.heappop(heap)
            children, margin = self.trees[t].children, margins[t]
            while node >= 0:  # the near side keeps the priority, the far side is queued
                m = margin[node]
                right = m >= 0
                heapq.heappush(heap, (max(worst, abs(m)), t, int(children[node, 0 if right else 1])))
                node = int(children[node, 1 if right else 0])
            leaf = int(self.first_leaf[t]) + ~node
            if counts[leaf]:
                opened.append(leaf)
                total += int(counts[leaf])
                per_tree[t] += int(counts[leaf])
        return opened

    def share_needed(self, vectors: np.ndarray, k: int, recall: float) -> float:
        """The smallest of ``SHARES`` with this recall for some of ``vectors`` searched among all of them."""
        n = len(vectors)
        leaves = self.leaves_of(vectors)
        counts = np.bincount(leaves.ravel(), minlength=int(self.first_leaf[-1]))
        asked = np.random.default_rng(SEED).choice(n, min(TRIALS, n), replace=False)
        wanted = np.argsort(-(vectors[asked] @ vectors.T), axis=1, kind="stable")[:, :k]
        opened = [self.open_leaves(vectors[q], counts, np.inf, n) for q in asked]
        sums = [np.cumsum(counts[o]) for o in opened]
        for share in SHARES:
            hits = []
            for o, total, want in zip(opened, sums, wanted, strict=True):
                seen = o[:int(np.searchsorted(total, share * n)) + 1]
                hits.append(np.isin(leaves[want], seen).any(axis=1).mean())
            if np.mean(hits) >= recall:
                return share
        return float(len(self.trees))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in component order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def _best(parts: list[pd.DataFrame], keep: int) -> pd.DataFrame:
    """The ``keep`` nearest distinct classes of each query."""
    rows = pd.concat(parts, ignore_index=True).sort_values(["query", "class", "near"], ascending=[True, True, False])
    rows = rows.drop_duplicates(["query", "class"]).sort_values(["query", "near", "class"], ascending=[True, False, True])
    return rows[rows.groupby("query").cumcount() < keep]


def _scored(keep: int):
    """Streams rows sorted by (leaf, chunk, kind): first a chunk's classes, then the queries at it.

    Answers of the leaves that meet in a task are combined per query before they leave it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, ids, vectors, matrix = None, [], [], None
        out: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            for (leaf, chunk, kind), part in batch.groupby(["leaf", "chunk", "kind"], sort=True):
                if (leaf, chunk) != place:
                    place, ids, vectors, matrix = (leaf, chunk), [], [], None
                if kind == 0:
                    ids.append(part["id"].to_numpy())
                    vectors.append(_stack(part["vec"]))
                    matrix = None
                    continue
                if not ids:
                    continue
                if matrix is None:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    matrix = vectors[0]
                for start in range(0, len(part), 256):
                    own = part.iloc[start:start + 256]
                    scores = _stack(own["vec"]) @ matrix.T
                    n = min(keep, scores.shape[1])
                    top = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < scores.shape[1] else np.tile(np.arange(n), (len(own), 1))
                    out.append(pd.DataFrame({
                        "query": np.repeat(own["id"].to_numpy(), n), "class": ids[0][top.ravel()],
                        "near": np.take_along_axis(scores, top, axis=1).ravel(),
                    }))
                    held += top.size
            if held > COMBINE_ROWS:
                out = [_best(out, keep)]
                held = len(out[0])
                if held > COMBINE_ROWS // 2:
                    yield out[0]
                    out, held = [], 0
        if out:
            yield _best(out, keep)

    return run


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
    trees: int = TREES, leaf: int = LEAF, fit_rows: int = FIT_ROWS, recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    asked = F.max(F.coalesce(is_query, F.lit(False))).alias("asked")
    rows = (
        vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vec_col).alias("vec"), asked)
    )
    rows = cut_lineage(rows)
    size = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("vec") == (size[0]["d"] if size else 0))
    few = Window.partitionBy("vec").orderBy("id")
    classes = (
        rows.withColumn("at", F.row_number().over(few)).where(F.col("at") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("class"), "ids", "vec")
    )
    classes = cut_lineage(classes)
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(inner_product(F.col("vec"), F.col("vec"))).alias("m")).first()
    total = stats["n"]
    share = int(min(1.0, fit_rows / max(1, total)) * (1 << 30))
    chosen = classes.where(F.pmod(F.xxhash64("class", F.lit(3)), F.lit(1 << 30)) < share).select("class", "vec").toPandas().sort_values("class")
    sample = _stack(chosen["vec"]) if len(chosen) else np.zeros((1, size[0]["d"] if size else 1))
    forest = Forest.fit(sample, float(np.sqrt(stats["m"] or 0.0)), trees, leaf)
    budget = forest.share_needed(sample, k + 1, recall) * total
    shared = spark.sparkContext.broadcast(forest)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                leaves = shared.value.leaves_of(_stack(batch["vec"]))
                yield pd.DataFrame({"class": batch["class"], "vec": batch["vec"], "leaves": list(leaves)})

    kind = classes.schema["vec"].dataType.simpleString()
    index = cut_lineage(classes.select("class", "vec").mapInPandas(placed, f"class long, vec {kind}, leaves array<long>"))
    counted = index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(int(forest.first_leaf[-1]), dtype=np.int64)
    counts[counted["leaf"].to_numpy(dtype=int)] = counted["n"].to_numpy(dtype=int)
    shared_counts = spark.sparkContext.broadcast(counts)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                opened = [shared.value.open_leaves(q, shared_counts.value, budget, k + 1) for q in _stack(part["vec"])]
                yield pd.DataFrame({"query": part["query"], "vec": part["vec"], "leaves": opened})

    queries = rows.where("asked").groupBy("vec").agg(F.min("id").alias("query"))
    probes = queries.select("query", "vec").mapInPandas(walked, f"query long, vec {kind}, leaves array<long>")
    chunks = spark.createDataFrame(
        pd.DataFrame({"leaf": np.arange(len(counts)), "chunks": np.maximum(1, -(-counts // LEAF_CHUNK))}), "leaf long, chunks long"
    )
    members = (
        index.select(F.col("class").alias("id"), "vec", F.explode("leaves").alias("leaf")).join(F.broadcast(chunks), "leaf")
        .select("leaf", F.pmod(F.xxhash64("id", F.lit(9)), "chunks").alias("chunk"), F.lit(0).alias("kind"), "id", "vec")
    )
    asking = (
        probes.select(F.col("query").alias("id"), "vec", F.explode("leaves").alias("leaf")).join(F.broadcast(chunks), "leaf")
        .select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "id", "vec")
    )
    found = (
        members.union(asking).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "kind")
        .mapInPandas(_scored(k + 1), "query long, class long, near double")
    )
    ranked = Window.partitionBy("query").orderBy(F.desc("near"), "class")
    best = (
        found.repartition("query").groupBy("query", "class").agg(F.max("near").alias("near"))
        .withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1).select("query", "class")
    )
    exact = (
        best.join(classes.select("class", "ids", F.col("vec").alias("other")), "class").join(queries, "query")
        .select("query", F.explode("ids").alias("vec_id"), inner_product(F.col("vec"), F.col("other")).alias("score"))
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = (
        exact.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("answer"))
    )
    asking_rows = rows.where("asked").select(F.col("id").alias("query_id"), "vec").join(queries, "vec").select("query_id", "query")
    own = F.slice(F.filter("answer", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asking_rows.join(answers, "query").select("query_id", F.posexplode(own).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
    )
