"""Newton-boosted trees for 0/1 outcomes, grown level by level from histograms that Spark sums.

Values are replaced once by the numbers of their bins (quantile bounds of each input; NULL has a bin of its
own), and rows are packed into blocks of bytes, so that a pass over them is a pass over few large cells.
For each level of a tree, tasks add up first and second derivatives of the logistic loss per (node,
input, bin); the sums of a node meet in one task, which returns the node's best split. The driver sees
one row per node. Several models (real and synthetic series, cohorts) grow side by side in the
same passes under a key.

A split's gain is 1/2 (GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) - gamma, a leaf's weight -G/(H+l), with the
L2 weight l; rows without a value go to the side with more gain. Positives weigh negatives/positives.
Margins are stored anew every few rounds; between, tasks add the trees grown since.

Defined results: rows with a NULL label take no part in the fit; a model whose rows are of one class or none
has no trees (score 0.5); NULL inputs are allowed; an empty table gives no models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.session import cut_lineage

ROUNDS, DEPTH, BINS = 100, 6, 64
L2, GAMMA, MIN_CHILD = 1.0, 0.0, 1.0
BLOCK_ROWS = 8192
#: Blocks that one task reads at least; a table of no more than these is one task, which needs no shuffle.
TASK_BLOCKS = 16
#: Rounds after which the margins of all rows are stored anew.
STORE_ROUNDS = 20
_BLOCK = "model string, codes binary, label binary, weight binary, margin binary"
_SPLIT = "model string, node int, input int, bin int, null_left boolean, gain double, g double, h double, gl double, hl double"


@dataclass
class Tree:
    """A tree as a heap: node i has children 2i + 1 and 2i + 2; ``input`` is -1 at leaves."""

    depth: int
    input: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    null_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = 2 ** (self.depth + 1) - 1
        self.input = np.full(size, -1, dtype=np.int64)
        self.bin = np.zeros(size, dtype=np.int64)
        self.null_left = np.zeros(size, dtype=bool)
        self.value = np.zeros(size)

    def nodes(self, codes: np.ndarray, null_bin: int) -> np.ndarray:
        """The node in which each row ends."""
        at = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        for _ in range(self.depth):
            split = self.input[at] >= 0
            code = codes[rows, np.maximum(self.input[at], 0)]
            left = np.where(code == null_bin, self.null_left[at], code <= self.bin[at])
            at = np.where(split, 2 * at + 2 - left, at)
        return at


@dataclass
class Booster:
    """Bounds of the bins of each input, and the trees; margins start from 0."""

    inputs: list[str]
    bounds: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def codes(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape, dtype=np.uint8)
        for j, bounds in enumerate(self.bounds):
            out[:, j] = np.where(np.isnan(values[:, j]), BINS, np.searchsorted(bounds, values[:, j], side="left"))
        return out

    def margins(self, values: np.ndarray) -> np.ndarray:
        return _margins(self.trees, self.codes(values), BINS)


def _margins(trees: Sequence[Tree], codes: np.ndarray, null_bin: int) -> np.ndarray:
    total = np.zeros(len(codes))
    for tree in trees:
        total += tree.value[tree.nodes(codes, null_bin)]
    return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _packed(boosters: dict[str, Booster], weights: dict[str, float], inputs: Sequence[str]):
    """Task function: rows in, blocks of bin numbers, labels, weights and margins out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, rows in batch.groupby("model"):
                for start in range(0, len(rows), BLOCK_ROWS):
                    part = rows.iloc[start:start + BLOCK_ROWS]
                    label = part["label"].to_numpy(dtype=np.float64)
                    codes = boosters[model].codes(part[list(inputs)].to_numpy(dtype=float))
                    weight = np.where(label > 0, weights[model], 1.0)
                    cells = [x.tobytes() for x in (codes, label, weight, np.zeros(len(part)))]
                    yield pd.DataFrame([(model, *cells)], columns=["model", "codes", "label", "weight", "margin"])

    return run


def _opened(block, width: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(block.codes, dtype=np.uint8).reshape(-1, width)
    return codes, *(np.frombuffer(x) for x in (block.label, block.weight, block.margin))


def _histograms(recent: dict[str, list[Tree]], growing: dict[str, Tree], level: int, width: int):
    """Task function: blocks in, sums of both derivatives per (node, input, bin) of the level out."""
    first, count, bins = 2**level - 1, 2**level, BINS + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in batch.itertuples(index=False):
                tree = growing.get(block.model)
                if tree is None:
                    continue
                codes, label, weight, margin = _opened(block, width)
                p = _sigmoid(margin + _margins(recent[block.model], codes, BINS))
                g, h = weight * (p - label), weight * p * (1 - p)
                at = tree.nodes(codes, BINS) - first
                here = at >= 0  # rows of leaves above this level are done
                if block.model not in sums:
                    sums[block.model] = np.zeros((2, count, width, bins))
                cells = (at[here, None] * width + np.arange(width)) * bins + codes[here]
                for i, d in enumerate((g, h)):
                    flat = np.bincount(cells.ravel(), np.repeat(d[here], width), minlength=count * width * bins)
                    sums[block.model][i] += flat.reshape(count, width, bins)
        rows = [(m, first + n, s[:, n].tobytes()) for m, s in sums.items() for n in range(count) if s[1, n].any()]
        yield pd.DataFrame(rows, columns=["model", "node", "sums"])

    return run


def best_split(sums: np.ndarray, l2: float, gamma: float, min_child: float) -> tuple:
    """(input, bin, null_left, gain, g, h, gl, hl) of the best split of a node; input -1 without any."""
    total = sums[:, 0].sum(axis=1)
    known, nulls = np.cumsum(sums[:, :, :-1], axis=2), sums[:, :, -1:]
    best = (-1, 0, False, 0.0, total[0], total[1], 0.0, 0.0)
    for null_left in (False, True):
        left = known + nulls if null_left else known
        gl, hl = left
        gr, hr = total[0] - gl, total[1] - hl
        score = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total[0] ** 2 / (total[1] + l2)
        gain = np.where((hl >= min_child) & (hr >= min_child), score / 2 - gamma, -np.inf)
        at = int(np.argmax(gain))
        j, b = divmod(at, gain.shape[1])
        if gain[j, b] > best[3] + 1e-9:
            best = (j, b, null_left, float(gain[j, b]), total[0], total[1], float(gl[j, b]), float(hl[j, b]))
    return best


def _splits(width: int, l2: float, gamma: float, min_child: float):
    """Task function: a node's sums of all tasks in, its best split out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for model, node, cell in zip(batch["model"], batch["node"], batch["sums"], strict=True):
                part = np.frombuffer(cell).reshape(2, width, BINS + 1)
                whole[model, node] = whole[model, node] + part if (model, node) in whole else part
        rows = [(m, n, *best_split(s, l2, gamma, min_child)) for (m, n), s in whole.items()]
        yield pd.DataFrame(rows, columns=["model", "node", "input", "bin", "null_left", "gain", "g", "h", "gl", "hl"])

    return run


def _chained(first, second):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return second(first(batches))

    return run


def _with_margins(recent: dict[str, list[Tree]], width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = []
            for block in batch.itertuples(index=False):
                codes, *_, margin = _opened(block, width)
                new.append((margin + _margins(recent[block.model], codes, BINS)).tobytes())
            yield batch.assign(margin=new)

    return run


def _start(rows: DataFrame, inputs: Sequence[str]) -> tuple[dict[str, Booster], dict[str, float]]:
    """Empty boosters with the bounds of their bins, and the weight of positives, for models with both classes."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.groupBy("model").agg(
        F.count(F.when(F.col("label") > 0, 1)).alias("pos"), F.count(F.lit(1)).alias("n"),
        F.array(*[F.percentile_approx(F.col(c).cast("double"), shares, 20 * BINS) for c in inputs]).alias("bounds"),
    ).collect()
    boosters = {r["model"]: Booster(list(inputs), [np.unique(np.array(b or [], dtype=float)) for b in r["bounds"]]) for r in found}
    return boosters, {r["model"]: (r["n"] - r["pos"]) / r["pos"] for r in found if 0 < r["pos"] < r["n"]}


def fit_boosters(
    rows: DataFrame, inputs: Sequence[str], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = 0.3,
    l2: float = L2, gamma: float = GAMMA, min_child: float = MIN_CHILD,
) -> dict[str, Booster]:
    """One booster for each value of ``model`` in rows (model, label, inputs...)."""
    own = rows.where("label IS NOT NULL AND model IS NOT NULL").select(
        F.col("model").cast("string").alias("model"), F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in inputs]
    )
    boosters, weights = _start(own, inputs)
    live = {m: boosters[m] for m in weights}
    if not live:
        return boosters
    width = len(inputs)
    chosen = own.where(F.col("model").isin(*live))
    blocks = cut_lineage(chosen.mapInPandas(_packed(live, weights, inputs), _BLOCK))
    tasks = -(-blocks.count() // TASK_BLOCKS)
    if tasks < blocks.rdd.getNumPartitions():
        blocks = cut_lineage(blocks.coalesce(tasks))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    recent: dict[str, list[Tree]] = {m: [] for m in live}
    for turn in range(rounds):
        growing = {m: Tree(depth) for m in live}
        trees = dict(growing)
        for level in range(depth + 1):
            add, split = _histograms(recent, growing, level, width), _splits(width, l2, gamma, min_child)
            if tasks == 1:
                found = blocks.mapInPandas(_chained(add, split), _SPLIT)
            else:
                sums = blocks.mapInPandas(add, "model string, node int, sums binary")
                found = sums.repartition(min(parts, 2**level * len(growing)), "model", "node").mapInPandas(split, _SPLIT)
            open_models = set()
            for s in found.collect():
                tree, node = trees[s["model"]], s["node"]
                tree.value[node] = -rate * s["g"] / (s["h"] + l2)
                if s["input"] < 0 or level == depth:
                    continue
                tree.input[node], tree.bin[node], tree.null_left[node] = s["input"], s["bin"], s["null_left"]
                for child, g, h in ((2 * node + 1, s["gl"], s["hl"]), (2 * node + 2, s["g"] - s["gl"], s["h"] - s["hl"])):
                    tree.value[child] = -rate * g / (h + l2)
                open_models.add(s["model"])
            # The sums of the last level's nodes are known from their parents.
            growing = {m: t for m, t in growing.items() if m in open_models}
            if not growing or level == depth - 1:
                break
        for m, tree in trees.items():
            live[m].trees.append(tree)
            recent[m].append(tree)
        if (turn + 1) % STORE_ROUNDS == 0 and turn + 1 < rounds:
            blocks = cut_lineage(blocks.mapInPandas(_with_margins(recent, width), _BLOCK))
            recent = {m: [] for m in live}
    return boosters


def score(booster: Booster, rows: DataFrame, name: str = "score") -> DataFrame:
    """Adds the probability of label 1."""
    shared = rows.sparkSession.sparkContext.broadcast(booster)

    def run(values: pd.DataFrame) -> pd.Series:
        return pd.Series(_sigmoid(shared.value.margins(values.to_numpy(dtype=float))))

    run.__annotations__ = {"values": pd.DataFrame, "return": pd.Series}
    return rows.withColumn(name, F.pandas_udf(run, "double")(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(booster.inputs)])))


def score_models(boosters: dict[str, Booster], rows: DataFrame, name: str = "score") -> DataFrame:
    """Adds the probability of label 1 by the booster that the row's ``model`` names; NULL without one."""
    shared = rows.sparkSession.sparkContext.broadcast(boosters)
    inputs = list(dict.fromkeys(c for b in boosters.values() for c in b.inputs))

    def run(models: pd.Series, values: pd.DataFrame) -> pd.Series:
        out = pd.Series(np.nan, index=models.index)
        for model, at in models.groupby(models).groups.items():
            booster = shared.value.get(model)
            if booster is not None:
                own = values.loc[at].to_numpy(dtype=float)[:, [inputs.index(c) for c in booster.inputs]]
                out.loc[at] = _sigmoid(booster.margins(own))
        return out.astype(object).where(out.notna(), None)

    run.__annotations__ = {"models": pd.Series, "values": pd.DataFrame, "return": pd.Series}
    if not inputs:
        return rows.withColumn(name, F.lit(None).cast("double"))
    cells = F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)])
    return rows.withColumn(name, F.pandas_udf(run, "double")(F.col("model").cast("string"), cells))


def trees_table(spark: SparkSession, booster: Booster) -> DataFrame:
    """The model as rows: one per node in use, with the threshold as a value (NULL at leaves)."""
    rows = []
    for t, tree in enumerate(booster.trees):
        todo = [0]
        while todo:
            i = todo.pop()
            j = int(tree.input[i])
            if j < 0:
                rows.append((t, i, tree.depth, None, None, None, float(tree.value[i])))
                continue
            bounds, b = booster.bounds[j], int(tree.bin[i])
            limit = float(bounds[b]) if b < len(bounds) else float("inf")
            rows.append((t, i, tree.depth, booster.inputs[j], limit, bool(tree.null_left[i]), None))
            todo += [2 * i + 1, 2 * i + 2]
    return spark.createDataFrame(rows, "tree int, node int, depth int, input string, threshold double, null_left boolean, value double")


def save_booster(spark: SparkSession, booster: Booster, path: str) -> None:
    """Trees as a table, bounds beside it."""
    trees_table(spark, booster).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    bounds = [(i, c, [float(x) for x in b]) for i, (c, b) in enumerate(zip(booster.inputs, booster.bounds, strict=True))]
    spark.createDataFrame(bounds, "place int, input string, bounds array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def load_booster(spark: SparkSession, path: str) -> Booster:
    bounds = sorted(spark.read.parquet(f"{path}/bounds").collect(), key=lambda r: r["place"])
    booster = Booster([r["input"] for r in bounds], [np.array(r["bounds"]) for r in bounds])
    place = {c: i for i, c in enumerate(booster.inputs)}
    for r in sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r["tree"], r["node"])):
        if r["tree"] == len(booster.trees):
            booster.trees.append(Tree(r["depth"]))
        tree, i = booster.trees[-1], r["node"]
        if r["input"] is None:
            tree.value[i] = r["value"]
            continue
        j = place[r["input"]]
        tree.input[i], tree.null_left[i] = j, r["null_left"]
        tree.bin[i] = np.searchsorted(booster.bounds[j], r["threshold"], side="left")
    return booster
