"""How stable a clustering is: subsample consensus, noise, bootstrap, agreement."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vectors as V
from ..session import constant, cut_lineage
from . import cluster, metrics, pairs, reduce, refits
from .ranking import bootstrap, shuffled_rank, subsample


REFIT_ROWS = 2_000_000      # rows of several iterations that are refitted at once
REFIT_FLOATS = 1 << 22      # numbers of their covariances


def _refit(rows: DataFrame, id_col: str, vec: str, method: str, k: int, intermediate: int, final: int,
           params: Mapping) -> DataFrame:
    """Labels of a fresh reduction and clustering."""
    n, d = reduce.shape(rows, vec)
    inter, dim = reduce.safe_dims(n, d, intermediate, final)
    small = reduce.two_stage_pca(rows, vec, inter, dim).rows.select(id_col, "reduced").persist()
    try:
        return cut_lineage(cluster.cluster(small, id_col, "reduced", method, k, **params).labels)
    finally:
        small.unpersist()


def _refits(df: DataFrame, id_col: str, vec: str, draw: Callable[[DataFrame, Column], DataFrame], n_iter: int, method: str, k: int,
            intermediate: int, final: int, params: Mapping) -> DataFrame:
    """(iter, id, label) of all iterations; draw(rows, iterations) gives their (iter, id, vec).

    k-means on vectors of bounded width is fitted for many iterations at once, other methods one by one.
    """
    n, d = reduce.shape(df, vec)
    rows = df.select(F.col(id_col).alias("id"), V.as_double(F.col(vec)).alias("vec"))
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "id").withColumn("_row", F.monotonically_increasing_id())
    rows, many, out = cut_lineage(rows), method.lower() == "kmeans" and 0 < d <= reduce.MAX_NARROW, []
    at_once = max(1, min(n_iter, REFIT_ROWS // max(n, 1), REFIT_FLOATS // d ** 2)) if many else 1
    middle = np.array(rows.agg(vector_to_array(Summarizer.mean(array_to_vector("vec")))).first()[0]) if many else None
    for first in range(0, n_iter, at_once):
        some = draw(rows, F.explode(F.sequence(F.lit(first), F.lit(min(first + at_once, n_iter) - 1))))
        if many:
            out.append(cut_lineage(refits.kmeans_each(refits.reduced_each(some, middle, intermediate, final), k, **params)))
        else:
            found = _refit(some.select("id", "vec"), "id", "vec", method, k, intermediate, final, params)
            out.append(found.select(F.lit(first).alias("iter"), "id", "label"))
    return fold(DataFrame.unionByName, out)


def subsample_labels(df: DataFrame, id_col: str, vec: str, method: str = "kmeans", k: int = 2, n_iter: int = 200,
                     frac: float = 0.8, intermediate: int = 2500, final: int = 300, seed: int = 42,
                     **params) -> DataFrame:
    """(iter, id, label): a fresh reduction and clustering of every subsample."""
    def draw(rows, iterations):
        keys = rows.select("_row", "id", iterations.alias("iter"))
        drawn = cut_lineage(subsample(keys, frac, ["id"], F.lit(seed) + F.col("iter"), ["iter"]).select("_row", "iter"))
        return drawn.join(rows, "_row").select("iter", "id", "vec")

    return _refits(df, id_col, vec, draw, n_iter, method, k, intermediate, final, params)


def noise_labels(df: DataFrame, id_col: str, vec: str, method: str = "kmeans", k: int = 2, n_iter: int = 100,
                 ratio: float = 0.01, intermediate: int = 2500, final: int = 300, seed: int = 42, **params) -> DataFrame:
    """(iter, id, label): the same after adding noise to every row."""
    spread = constant(metrics.feature_std(df, vec))

    def draw(rows, iterations):
        each = rows.select("id", "vec", iterations.alias("iter"))
        noisy = reduce.add_noise(each, "vec", "id", ratio, F.col("iter"), seed, "_noisy", spread)
        return noisy.select("iter", "id", F.col("_noisy").alias("vec"))

    return _refits(df, id_col, vec, draw, n_iter, method, k, intermediate, final, params)


def bootstrap_labels(df: DataFrame, id_col: str, vec: str, k: int = 2, n_iter: int = 200, ratio: float = 0.8,
                     dims: int = 50, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(reference labels, (iter, id, label)): mixtures fitted on bootstraps that then label all rows."""
    small = cut_lineage(reduce.pca(df, vec, dims).rows.select(id_col, "reduced"))
    ref = cut_lineage(cluster.gaussian_mixture(small, id_col, "reduced", k, 3, seed).labels)
    n = small.count()
    ready = small.select(F.col(id_col).alias("id"), array_to_vector("reduced").alias("features"))
    out = []
    for i in range(n_iter):
        draw = bootstrap(ready, max(10, int(n * ratio)), ["id"], seed + i)
        model = GaussianMixture(k=k, seed=seed + i).fit(draw.select("features"))
        out.append(cut_lineage(model.transform(ready).select(
            F.lit(i).alias("iter"), "id", F.col("prediction").cast("int").alias("label"))))
    return ref, fold(DataFrame.unionByName, out)


def iteration_agreement(assignments: DataFrame, ref: DataFrame) -> DataFrame:
    """(iter, ari, nmi) of every iteration against the reference labels, noise left out."""
    both = assignments.join(ref.select("id", F.col("label").alias("ref")), "id").where("label >= 0 and ref >= 0")
    return metrics.agreement(both, "ref", "label", "iter").select("iter", "ari", "nmi")


def agreement_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n_iter"), F.avg("ari").alias("mean_ari"),
                      F.stddev_pop("ari").alias("std_ari"), F.avg("nmi").alias("mean_nmi"),
                      F.stddev_pop("nmi").alias("std_nmi"))


def label_arrays(assignments: DataFrame, ref: DataFrame, n_iter: int) -> DataFrame:
    """(id, ref, labels): the label of each row per iteration, null where it was not drawn.

    A group holds at most one entry per iteration.
    """
    per = assignments.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("iter", "label"))).alias("m"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(n_iter - 1)), lambda i: F.try_element_at(F.col("m"), i))
    return per.select("id", labels.alias("labels")).join(ref.select("id", F.col("label").alias("ref")), "id")


def _codes(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrices: drawn per iteration, and one column per (iteration, label)."""
    lab = np.array(frame["vec"].tolist(), dtype=np.float64).reshape(len(frame), -1)
    drawn = ~np.isnan(lab) & (lab >= 0)
    return drawn.astype(np.float32), np.where(drawn, lab, -1)


def _together(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per pair: iterations that drew both, and iterations that put both in one cluster."""
    (da, la), (db, lb) = _codes(left), _codes(right)
    both, same = da @ db.T, np.zeros((len(left), len(right)), dtype=np.float32)
    for value in np.union1d(np.unique(la), np.unique(lb)):
        if value >= 0:
            same += (la == value).astype(np.float32) @ (lb == value).astype(np.float32).T
    return both, same


def consensus_counts(arrays: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(same_ref, n_both, n_same, pairs): the consensus matrix as an exact table of its distinct entries.

    Every pair i < j that was drawn together is counted. Rows of one reference label and the same labels in every
    iteration count alike, so they are one row with a weight. The table has at most n_iter^2 rows whatever n is.
    """
    def kernel(left, right, same):
        both, together = _together(left, right)
        ref = left["ref"].to_numpy()[:, None] == right["ref"].to_numpy()[None, :]
        w = left["w"].to_numpy()
        weight = w[:, None] * right["w"].to_numpy()[None, :]
        if same:
            weight = np.triu(weight, 1)
            np.fill_diagonal(weight, w * (w - 1) // 2)
        take = (both > 0) & (weight > 0)
        most = int(both.max(initial=0)) + 1
        code = (both[take].astype(np.int64) * most + together[take].astype(np.int64)) * 2 + ref[take]
        pairs_of = np.bincount(code, weight[take])      # whole numbers below 2^53
        found = np.flatnonzero(pairs_of)
        return pd.DataFrame({"same_ref": found % 2 == 1, "n_both": found // 2 // most, "n_same": found // 2 % most,
                             "pairs": pairs_of[found].astype(np.int64)})

    alike = arrays.groupBy("ref", "labels").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    part = pairs.tiles(alike, "id", "labels", ["ref", "w"], kernel,
                       "same_ref boolean, n_both int, n_same int, pairs bigint", block_rows)
    return part.groupBy("same_ref", "n_both", "n_same").agg(F.sum("pairs").alias("pairs"))


def consensus_to_labels(arrays: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(id, ref, label, consensus, n): mean consensus of each row with the rows of each reference label.

    The row-by-label form of the ordered consensus matrix.
    """
    def sums(rows, cols, both, together, drop):
        both, together = both.astype(np.float64), together.astype(np.float64)
        value = np.divide(together, both, out=np.zeros(both.shape), where=both > 0)
        seen = both > 0
        if drop:
            np.fill_diagonal(seen, False)
        codes, names = pd.factorize(cols["ref"].to_numpy(), sort=True)
        hot = np.zeros((len(cols), len(names)))
        hot[np.arange(len(cols)), codes] = 1
        return pd.DataFrame({
            "id": np.repeat(rows["id"].to_numpy(), len(names)), "ref": np.repeat(rows["ref"].to_numpy(), len(names)),
            "label": np.tile(names, len(rows)), "c": ((value * seen) @ hot).ravel(),
            "n": (seen @ hot).astype(np.int64).ravel()})

    def kernel(left, right, same):
        both, together = _together(left, right)
        out = [sums(left, right, both, together, same)]
        if not same:
            out.append(sums(right, left, both.T, together.T, False))
        return pd.concat(out, ignore_index=True)

    id_type = arrays.schema["id"].dataType.simpleString()
    part = pairs.tiles(arrays, "id", "labels", ["ref"], kernel, f"id {id_type}, ref int, label int, c double, n bigint",
                       block_rows)
    return part.groupBy("id", "ref", "label").agg((F.sum("c") / F.sum("n")).alias("consensus"),
                                                  F.sum("n").alias("n")).where("n > 0")


def consensus_summary(counts: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """One row: share of ambiguous pairs, mean consensus within and between reference labels."""
    c = F.col("n_same") / F.col("n_both")
    pairs_if = lambda cond: F.sum(F.when(cond, F.col("pairs")))
    mean_if = lambda cond: F.sum(F.when(cond, c * F.col("pairs"))) / pairs_if(cond)
    return counts.agg(
        (F.coalesce(pairs_if((c > low) & (c < high)), F.lit(0)) / F.sum("pairs")).alias("pac"),
        mean_if(F.col("same_ref")).alias("within"), mean_if(~F.col("same_ref")).alias("between"),
        F.sum("pairs").alias("pairs"))


def matrix_order(ref: DataFrame, label: str = "label", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """((id, label, position), (label, start, size)): rows of a matrix put in label order."""
    sizes = ref.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    bounds = sizes.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    ranked = shuffled_rank(ref.select(id_col, label), [id_col], 42, [label], "_r").join(bounds.select(label, "start"), label)
    return ranked.select(id_col, label, (F.col("start") + F.col("_r")).alias("position")), bounds


def robustness_table(subsampled: DataFrame, consensus: DataFrame, noisy: DataFrame, frac: float, ratio: float) -> DataFrame:
    """Two rounded rows: subsampling with its consensus figures, and noise."""
    def row(scores, name, setting):
        return agreement_summary(scores).select(
            F.lit(name).alias("analysis"), "n_iter", F.lit(setting).alias("setting"),
            *[F.round(c, 3).alias(c) for c in ("mean_ari", "std_ari", "mean_nmi", "std_nmi")])

    con = consensus.select(F.lit("Subsampling consensus stability").alias("analysis"), F.round("within", 3).alias("within"),
                           F.round("between", 4).alias("between"), F.round("pac", 3).alias("pac"))
    rows = row(subsampled, "Subsampling consensus stability", f"subsample_frac={frac}").unionByName(
        row(noisy, "Perturbation stability", f"noise_std_ratio={ratio}"))
    return rows.join(con, "analysis", "left")


def method_table(scores: DataFrame) -> DataFrame:
    return scores.select(text.method_name(F.col("method")).alias("method"), F.round("silhouette", 3).alias("silhouette"),
                         "n_clusters_found")


def agreement_table(scores: DataFrame) -> DataFrame:
    return scores.select(text.method_name(F.col("method_1")).alias("method_1"),
                         text.method_name(F.col("method_2")).alias("method_2"),
                         F.round("ari", 3).alias("ari"), F.round("nmi", 3).alias("nmi"))
