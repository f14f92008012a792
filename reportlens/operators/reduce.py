"""Dimension reduction of array vectors with Spark ML, and a wide form for long vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import constant
from . import tables

MAX_NARROW = 4096      # Spark's PCA keeps a dim x dim matrix on the driver: 128 MB at this width


def safe_dims(n: int, d: int, intermediate: int, final: int) -> tuple[int, int]:
    """Intermediate and final dimension that n rows of width d can bear."""
    inter = min(intermediate, n - 1, d - 1)
    return inter, max(1, min(final, inter - 1) if inter > 1 else 1)


def shape(df: DataFrame, vec: str) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    return row[0], row[1] or 0


@dataclass
class Reduced:
    rows: DataFrame
    model: PipelineModel | None
    shares: list[float]


def pca(df: DataFrame, vec: str, k: int, out: str = "reduced", centre: bool = True) -> Reduced:
    """Centred PCA to min(k, width, rows - 1); wider vectors take the randomised form."""
    n, d = shape(df, vec)
    k = max(1, min(k, d, n - 1))
    if d > MAX_NARROW:
        rows, shares = wide_pca(df, vec, k, out=out, centre=centre)
        return Reduced(rows, None, shares)
    ready = df.withColumn("_v", array_to_vector(V.as_double(F.col(vec))))
    fit = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_c", withMean=centre, withStd=False),
                           PCA(k=k, inputCol="_c", outputCol="_p")]).fit(ready)
    rows = fit.transform(ready).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")
    return Reduced(rows, fit, [float(x) for x in fit.stages[-1].explainedVariance])


def apply_pca(df: DataFrame, vec: str, model: PipelineModel, out: str = "reduced") -> DataFrame:
    """Project new rows with a fitted model; works on a stream as well."""
    ready = df.withColumn("_v", array_to_vector(V.as_double(F.col(vec))))
    return model.transform(ready).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")


def two_stage_pca(df: DataFrame, vec: str, intermediate: int, final: int, out: str = "reduced") -> Reduced:
    """PCA of a PCA keeps the leading components of the first, so one fit is enough.

    shares holds stage one, stage two and their product.
    """
    n, d = shape(df, vec)
    stage1 = max(1, min(intermediate, d, n - 1))
    fit = pca(df, vec, stage1, "_inter")
    k = min(final, len(fit.shares))
    rows = fit.rows.withColumn(out, F.slice("_inter", 1, k)).drop("_inter")
    one, kept = sum(fit.shares), sum(fit.shares[:k])
    two = kept / one if one else 0.0
    return Reduced(rows, fit.model, [one, two, one * two])


def high_variance_pca(df: DataFrame, vec: str, target_dim: int, target: float = 0.95, out: str = "reduced") -> Reduced:
    """Components that reach the target share, at least target_dim, cut to target_dim at the end."""
    n, d = shape(df, vec)
    fit = pca(df, vec, min(d, n - 1), "_all")
    spark = df.sparkSession
    shares = spark.createDataFrame([(i + 1, s) for i, s in enumerate(fit.shares)], "i int, share double")
    need = tables.components_needed(shares, target).first().k
    k = min(max(need, target_dim), len(fit.shares))
    final = min(target_dim, k)
    rows = fit.rows.withColumn(out, F.slice("_all", 1, final)).drop("_all")
    return Reduced(rows, fit.model, fit.shares[:final])


def svd(df: DataFrame, vec: str, k: int, out: str = "reduced") -> Reduced:
    """Truncated SVD: the same projection without centring."""
    rows, shares = wide_pca(df, vec, k, out=out, centre=False)
    return Reduced(rows, None, shares)


def map_2d(df: DataFrame, vec: str, id_col: str, label: str) -> DataFrame:
    """(id, label, x, y): coordinates of the first two components."""
    fit = pca(df, vec, 2)
    return fit.rows.select(id_col, label, F.element_at("reduced", 1).alias("x"),
                           F.try_element_at("reduced", F.lit(2)).alias("y"))


def _gram_times(df: DataFrame, vec: str, q: np.ndarray) -> np.ndarray:
    """X'X q, summed from one partial product per Arrow batch; the result has width x k numbers."""
    basis = df.sparkSession.sparkContext.broadcast(q)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=np.float64)
            y = x.T @ (x @ basis.value)
            total = y if total is None else total + y
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "y": list(total)})

    partial = df.select(F.col(vec).alias("v")).mapInPandas(part, "i int, y array<double>")
    rows = partial.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("y"))).alias("y")) \
        .orderBy("i").collect()
    return np.array([r.y for r in rows])


def wide_pca(df: DataFrame, vec: str, k: int, passes: int = 6, extra: int = 10, seed: int = 42,
             out: str = "reduced", centre: bool = True) -> tuple[DataFrame, list[float]]:
    """Randomised subspace iteration (Halko, Martinsson, Tropp 2011) for vectors of any width.

    The driver holds width x (k + extra) numbers; the covariance itself is never built.
    """
    v = array_to_vector(V.as_double(F.col(vec)))
    stats = df.agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(v)).alias("mean"),
                   F.sum(V.dot(F.col(vec), F.col(vec))).alias("sq")).first()
    n, mu = stats.n, np.array(stats.mean)
    if not centre:
        mu = np.zeros_like(mu)
    d = len(mu)
    k = max(1, min(k, d, n - 1))
    size = min(d, k + extra)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]

    def times(b):
        return _gram_times(df, vec, b) - n * np.outer(mu, mu @ b)

    for _ in range(passes):
        q = np.linalg.qr(times(q))[0]
    z = times(q)
    values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    order = np.argsort(values)[::-1][:k]
    basis, values = q @ turn[:, order], values[order]
    total = stats.sq - n * float(mu @ mu)
    sent = df.sparkSession.sparkContext.broadcast((basis, mu))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        b, m = sent.value
        return pd.Series(list((np.array(x.tolist(), dtype=np.float64) - m) @ b))

    return df.withColumn(out, project(F.col(vec))), [float(x / total) if total else 0.0 for x in values]


def add_noise(df: DataFrame, vec: str, id_col: str, ratio: float, iteration: int | Column, seed: int = 42,
              out: str = "noisy", spread: Column | None = None) -> DataFrame:
    """Gaussian noise of ratio x feature spread (of these rows, if not given), fixed by (seed, iteration, id) alone."""
    from . import metrics
    spread = constant(metrics.feature_std(df, vec)) if spread is None else spread
    iteration = F.lit(iteration) if isinstance(iteration, int) else iteration

    @F.pandas_udf("array<double>")
    def shake(x: pd.Series, ids: pd.Series, std: pd.Series, iterations: pd.Series) -> pd.Series:
        def one(v, i, s, at):
            key = np.frombuffer(f"{seed}:{at}:{i}".encode().ljust(8, b"\0"), dtype=np.uint8)
            rng = np.random.default_rng(key.tolist())
            return np.asarray(v, dtype=np.float64) + rng.standard_normal(len(v)) * np.asarray(s) * ratio

        return pd.Series([one(*row) for row in zip(x, ids, std, iterations)])

    return df.withColumn(out, shake(F.col(vec), F.col(id_col).cast("string"), spread, iteration))
