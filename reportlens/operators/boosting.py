"""Gradient boosting for any number of classes: softmax gradients, histograms of binned features, second-order leaves.

Rows are binned once and written; a level of all class trees of a round is one pass. A task adds gradients and
hessians into (class, node, feature, bin) cells, the cells are summed by one shuffle whose size depends on classes,
nodes, features and bins only, and one group per (class, node) picks its split. The driver sees splits and leaves.
Scores of rows are written again every KEEP rounds; a task adds the trees grown since.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

KEEP = 10           # rounds between two written score tables
CELL = "cls int, node int, feature int, bin int, g double, h double"
SPLIT = "cls int, node int, feature int, bin int, gain double, left double, right double"


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def root(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node each row of bins reaches."""
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.bin[at]), at)


@dataclass
class Boosted:
    """Cut points per feature and the trees per round and class (one tree a round for two classes)."""

    cuts: list[np.ndarray]
    classes: int
    rounds: list[list[Tree]] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return self.classes if self.classes > 2 else 1

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value: the number of cut points below it; no number is bin 0."""
        out = np.zeros(x.shape, dtype=np.uint8)
        for j, c in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j], side="left"))
        return out

    def scores(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.outputs))
        for trees in self.rounds[since:]:
            for k, t in enumerate(trees):
                out[:, k] += t.value[t.nodes(bins)]
        return out

    def probability(self, scores: np.ndarray) -> np.ndarray:
        if self.outputs == 1:
            p = 1 / (1 + np.exp(-np.clip(scores[:, 0], -500, 500)))
            return np.stack([1 - p, p], axis=1)
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """Adds probability and prediction; ties go to the smaller class, rows without a vector get nulls."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            model, known = sent.value, x.notna()
            if not known.any():
                return pd.Series([None] * len(x), dtype=object)
            bins = model.binned(np.array(x[known].tolist(), dtype=np.float64))
            found = iter(model.probability(model.scores(bins)))
            return pd.Series([next(found) if k else None for k in known], dtype=object)

        out = df.withColumn("probability", run(F.col(vec).cast("array<double>")))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", best.cast("double"))


def feature_cuts(train: DataFrame, vec: str, bins: int) -> list[np.ndarray]:
    """At most bins - 1 cut points per feature from mergeable quantile sketches; the largest value is no cut."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cells = train.select(F.posexplode(F.col(vec).cast("array<double>")).alias("j", "x")).where("not isnan(x)")
    found = {r.j: r for r in cells.groupBy("j").agg(
        F.percentile_approx("x", shares, 100 * bins).alias("q"), F.max("x").alias("top"), F.min("x").alias("low")).collect()}
    width = len(train.select(vec).first()[0])
    cuts = []
    for j in range(width):
        r = found.get(j)
        q = np.array([]) if r is None else np.unique([r.low, *r.q])
        cuts.append(q[q < r.top][-(bins - 1):] if len(q) else q)
    return cuts


def _best_splits(l2: float, least: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        """The best split of one node, its leaf sums in 'left' and 'right'; without a gain the node's own leaf."""
        cells = cells.sort_values(["feature", "bin"], ignore_index=True)
        one = cells[cells["feature"] == cells["feature"].iloc[0]]
        g, h = one["g"].sum(), one["h"].sum()
        by = cells.groupby("feature")
        gl, hl = by["g"].cumsum(), by["h"].cumsum()
        gr, hr = g - gl, h - hl
        gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - g ** 2 / (h + l2)
        gain = gain.where((hl >= least) & (hr >= least), -1.0).round(9)     # equal gains stay equal in any order of sums
        at = int(gain.to_numpy().argmax())
        cls, node = cells["cls"].iloc[0], cells["node"].iloc[0]
        if gain[at] <= 0:
            row = (cls, node, -1, 0, 0.0, -g / (h + l2), 0.0)
        else:
            row = (cls, node, cells["feature"][at], cells["bin"][at], gain[at],
                   -gl[at] / (hl[at] + l2), -gr[at] / (hr[at] + l2))
        return pd.DataFrame([row], columns=["cls", "node", "feature", "bin", "gain", "left", "right"])

    return run


def _cells(model: Boosted, trees: list[Tree], open_nodes: list[list[int]], since: int, width: int):
    sizes = max((len(c) for c in model.cuts), default=0) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros((len(o), width, sizes, 2)) for o in open_nodes]
        for pdf in batches:
            if not len(pdf):
                continue
            bins = np.frombuffer(b"".join(pdf["bins"]), dtype=np.uint8).reshape(len(pdf), width)
            kept = np.frombuffer(b"".join(pdf["scores"])).reshape(len(pdf), model.outputs)
            p = model.probability(kept + model.scores(bins, since))
            y = pdf["label"].to_numpy().astype(np.int64)
            for k, nodes in enumerate(open_nodes):
                cls = k if model.outputs > 1 else 1
                place = np.full(len(trees[k].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[trees[k].nodes(bins)]
                inside = at >= 0
                if not inside.any():
                    continue
                q = p[inside, cls]
                for side, amount in enumerate((q - (y[inside] == cls), q * (1 - q))):
                    for j in range(width):
                        cell = at[inside] * sizes + bins[inside, j]
                        total[k][:, j, :, side] += np.bincount(
                            cell, weights=amount, minlength=len(nodes) * sizes).reshape(len(nodes), sizes)
        for k, nodes in enumerate(open_nodes):
            i, j, b = np.nonzero(total[k][..., 1])
            yield pd.DataFrame({"cls": k, "node": np.array(nodes, dtype=np.int64)[i], "feature": j, "bin": b,
                                "g": total[k][i, j, b, 0], "h": total[k][i, j, b, 1]})

    return run


def fit(train: DataFrame, classes: int, rounds: int = 200, depth: int = 6, step: float = 0.1, bins: int = 64,
        l2: float = 1.0, least: float = 1.0, vec: str = "vec", label: str = "label") -> Boosted:
    """Boosted trees of rows with a vector and a label 0 .. classes - 1; other rows take no part.

    bins is at most 256. Growing ends early when no tree of a round finds a split. A table without rows gives
    equal probabilities.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    train = train.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    if train.isEmpty():
        return Boosted([], classes)
    model = Boosted(feature_cuts(train, vec, bins), classes)
    width, empty = len(model.cuts), np.zeros(model.outputs).tobytes()

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return pd.Series([b.tobytes() for b in model.binned(np.array(x.tolist(), dtype=np.float64))]) if len(x) else x

    rows = cut_lineage(train.select(F.col(label).cast("double").alias("label"), pack(F.col(vec).cast("array<double>")).alias("bins"),
                                    F.lit(empty).alias("scores")))
    since = 0
    for r in range(rounds):
        if r - since >= KEEP:
            rows, since = _with_scores(rows, model, since, width), r
        trees = [Tree.root(depth) for _ in range(model.outputs)]
        open_nodes = [[0] for _ in trees]
        for level in range(depth):
            cells = rows.mapInPandas(_cells(model, trees, open_nodes, since, width), CELL)
            summed = cells.groupBy("cls", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            found = summed.groupBy("cls", "node").applyInPandas(_best_splits(l2, least), SPLIT).collect()
            open_nodes = [[] for _ in trees]
            for s in sorted(found):
                t, i = trees[s.cls], s.node
                if s.feature < 0:
                    t.value[i] = step * s.left
                    continue
                t.feature[i], t.bin[i] = s.feature, s.bin
                t.value[2 * i + 1], t.value[2 * i + 2] = step * s.left, step * s.right
                if level + 1 < depth:
                    open_nodes[s.cls] += [2 * i + 1, 2 * i + 2]
            if not any(open_nodes):
                break
        if all(t.feature[0] < 0 for t in trees):
            break
        model.rounds.append(trees)
    return model


def _with_scores(rows: DataFrame, model: Boosted, since: int, width: int) -> DataFrame:
    """Rows whose scores hold all trees so far, written to the shared folder."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                bins = np.frombuffer(b"".join(pdf["bins"]), dtype=np.uint8).reshape(len(pdf), width)
                kept = np.frombuffer(b"".join(pdf["scores"])).reshape(len(pdf), model.outputs)
                yield pdf.assign(scores=[s.tobytes() for s in kept + model.scores(bins, since)])

    return cut_lineage(rows.mapInPandas(run, rows.schema))
