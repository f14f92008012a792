"""Exact path-dependent Shapley values of a fitted forest, read from its table of nodes.

On the way to a leaf each feature has a cover ratio r (the share of training weight that takes its edges) and a row
meets them or not (o). The value of a feature at that leaf is leaf * (o - r) * integral over t in [0, 1] of the product
of o' t + r' (1 - t) over the other features of the path: the integral weighs every coalition by its Shapley weight.
The product is a polynomial, so Gauss-Legendre nodes integrate it exactly. Values and the mean prediction sum to the
forest's probability.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

CELLS = 1 << 21         # rows x path steps worked on at once in a task


@dataclass(frozen=True)
class TreePaths:
    """One tree as flat arrays: its tests, the edges of each (leaf, feature) step, the steps of each leaf."""

    feature: np.ndarray         # per test
    threshold: np.ndarray
    left: list                  # per test: categories that go left, None for a threshold
    edge_test: np.ndarray       # per edge, steps in order
    edge_left: np.ndarray
    step_start: np.ndarray      # per step: its first edge
    step_feature: np.ndarray
    ratio: np.ndarray
    step_value: np.ndarray      # per step: value of its leaf
    leaf_start: np.ndarray      # per leaf: its first step
    leaf_steps: np.ndarray
    mean: float


def node_table(model) -> DataFrame:
    """(tree, node, cover, stats, left, right, feature, split, categories) of a fitted forest.

    The forest is saved to the shared folder and read as a table, so nodes are not fetched one by one.
    """
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n.id.alias("node"),
        F.aggregate(n.impurityStats, F.lit(0.0), lambda a, x: a + x).alias("cover"), n.impurityStats.alias("stats"),
        n.leftChild.alias("left"), n.rightChild.alias("right"), n.split.featureIndex.alias("feature"),
        n.split.leftCategoriesOrThreshold.alias("split"), n.split.numCategories.alias("categories"))


def tree_paths(nodes: pd.DataFrame, cls: int) -> TreePaths:
    """The paths of one tree; a child without training weight has ratio 0 and its leaf no value."""
    table = {r.node: r for r in nodes.itertuples()}
    tests, feature, threshold, left = {}, [], [], []
    edges, signs, step_start, step_feature, ratio, value, leaf_start, leaf_steps, mean = [], [], [], [], [], [], [], [], 0.0
    stack: list[tuple] = [(0, ())]
    while stack:
        at, path = stack.pop()
        r = table[at]
        if r.left < 0:
            v = float(r.stats[cls]) / r.cover if r.cover > 0 else 0.0
            weight, steps = 1.0, {}
            for f, test, goes_left, share in path:
                weight *= share
                steps.setdefault(f, []).append((test, goes_left, share))
            mean += v * weight
            if not steps or v == 0:
                continue
            leaf_start.append(len(step_feature))
            leaf_steps.append(len(steps))
            for f, taken in steps.items():
                step_start.append(len(edges))
                step_feature.append(f)
                ratio.append(float(np.prod([s for _, _, s in taken])))
                value.append(v)
                edges.extend(t for t, _, _ in taken)
                signs.extend(g for _, g, _ in taken)
            continue
        tests[at] = len(feature)
        feature.append(r.feature)
        threshold.append(r.split[0] if r.categories < 0 else 0.0)
        left.append(None if r.categories < 0 else np.array(r.split))
        for child, goes_left in ((r.left, True), (r.right, False)):
            share = table[child].cover / r.cover if r.cover > 0 else 0.0
            stack.append((child, (*path, (r.feature, tests[at], goes_left, share))))
    i = lambda x: np.array(x, dtype=np.int64)
    return TreePaths(i(feature), np.array(threshold), left, i(edges), np.array(signs, dtype=bool), i(step_start),
                     i(step_feature), np.array(ratio), np.array(value), i(leaf_start), i(leaf_steps), mean)


def forest_paths(model, cls: int | None = None) -> list[TreePaths]:
    """All trees of a forest, for one class (the last one if none is named).

    As large as the forest itself, which Spark ML also keeps on the driver and sends to every task.
    """
    nodes = node_table(model).toPandas()
    cls = model.numClasses - 1 if cls is None else cls
    return [tree_paths(part, cls) for _, part in nodes.groupby("tree")]


def expected(trees: list[TreePaths]) -> float:
    """The mean prediction over the training weight: what all values of a row are added to."""
    return float(np.mean([t.mean for t in trees]))


def _tree_values(t: TreePaths, x: np.ndarray, out: np.ndarray) -> None:
    goes_left = x[:, t.feature] <= t.threshold
    for i, cats in enumerate(t.left):
        if cats is not None:
            goes_left[:, i] = np.isin(x[:, t.feature[i]], cats)
    hit = np.logical_and.reduceat(goes_left[:, t.edge_test] == t.edge_left, t.step_start, axis=1)
    o, leaf = hit.astype(np.float64), np.repeat(np.arange(len(t.leaf_start)), t.leaf_steps)
    weight = np.zeros_like(o)
    at, w = np.polynomial.legendre.leggauss(int(t.leaf_steps.max() + 1) // 2)
    for point, mass in zip((at + 1) / 2, w / 2):
        factor = o * point + t.ratio * (1 - point)
        weight += mass * np.multiply.reduceat(factor, t.leaf_start, axis=1)[:, leaf] / factor
    order = np.argsort(t.step_feature, kind="stable")
    features, first = np.unique(t.step_feature[order], return_index=True)
    out[:, features] += np.add.reduceat((t.step_value * (o - t.ratio) * weight)[:, order], first, axis=1)


def values(trees: list[TreePaths], x: np.ndarray) -> np.ndarray:
    """Rows x features."""
    out = np.zeros(x.shape)
    for t in trees:
        steps = len(t.step_feature)
        if steps:
            block = max(1, CELLS // max(steps, len(t.edge_test)))
            for a in range(0, len(x), block):
                _tree_values(t, x[a:a + block], out[a:a + block])
    return out / len(trees)


def shapley_values(rows: DataFrame, model, features: str = "features", out: str = "shapley", cls: int | None = None) -> DataFrame:
    """Adds an array with the exact value of each feature; no shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(forest_paths(model, cls))

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(values(sent.value, np.array(x.tolist(), dtype=np.float64)))) if len(x) else pd.Series([], dtype=object)

    return rows.withColumn(out, run(vector_to_array(features)))


def mean_absolute(rows: DataFrame, model, features: str = "features", cls: int | None = None) -> DataFrame:
    """(feature, importance): mean absolute value per vector index; a task sends one row per feature."""
    sent = rows.sparkSession.sparkContext.broadcast(forest_paths(model, cls))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for pdf in batches:
            if len(pdf):
                part = np.abs(values(sent.value, np.array(pdf["x"].tolist(), dtype=np.float64))).sum(axis=0)
                total, n = part if total is None else total + part, n + len(pdf)
        if total is not None:
            yield pd.DataFrame({"feature": np.arange(len(total)), "s": total, "n": n})

    parts = rows.select(vector_to_array(features).alias("x")).mapInPandas(run, "feature int, s double, n long")
    return parts.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("importance"))
