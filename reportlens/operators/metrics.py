"""Scores of a clustering and agreement between clusterings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import constant, cut_lineage
from . import pairs
from .ranking import running_totals


def valid(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows that are not noise."""
    return df.where(F.col(label) >= 0)


def centroids(df: DataFrame, vec: str, *group: str) -> DataFrame:
    """(group, mean, n): vector means with map-side partial sums."""
    v = array_to_vector(V.as_double(F.col(vec)))
    return df.groupBy(*group).agg(vector_to_array(Summarizer.mean(v)).alias("mean"), F.count(F.lit(1)).alias("n"))


def feature_std(df: DataFrame, vec: str, floor: float = 1e-8) -> DataFrame:
    """One row: sample standard deviation per dimension, zero replaced by floor."""
    v = array_to_vector(V.as_double(F.col(vec)))
    std = df.agg(vector_to_array(Summarizer.std(v)).alias("std"))
    return std.select(F.transform("std", lambda x: F.when(x == 0, floor).otherwise(x)).alias("std"))


def run_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Points, noise, share of noise, number of clusters."""
    good = F.col(label) >= 0
    return df.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(good).alias("valid_points"),
        F.count_if(~good).alias("n_noise"), (F.count_if(~good) / F.count(F.lit(1))).alias("noise_ratio"),
        F.countDistinct(F.when(good, F.col(label))).alias("n_clusters"),
    )


def cosine_silhouette(df: DataFrame, vec: str, label: str = "label") -> float | None:
    """Mean cosine silhouette without noise; linear in the rows. Null below 2 clusters or 4 rows.

    A zero vector is at distance 1 from every row, as in the row form.
    """
    rows = valid(df, label)
    shape = rows.agg(F.countDistinct(label), F.count(F.lit(1))).first()
    if shape[0] < 2 or shape[1] < 4:
        return None
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), vec, label)
    return cosine_silhouette_rows(numbered, "_row", vec, label).agg(F.avg("s")).first()[0]


def cosine_silhouette_rows(df: DataFrame, id_col: str, vec: str, label: str = "label") -> DataFrame:
    """(id, label, s): cosine silhouette per row from the unit-vector sums of the clusters."""
    rows = valid(df, label).select(F.col(id_col).alias("id"), F.col(label).alias("label"),
                                   V.normalize(F.col(vec)).alias("u"))
    sums = rows.groupBy(F.col("label").alias("other")).agg(
        vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("total"), F.count(F.lit(1)).alias("size"))
    packed = constant(sums.agg(F.collect_list(F.struct("other", "total", "size")).alias("c")))
    wide = rows.withColumn("c", packed)
    mean = F.transform("c", lambda c: F.struct(
        c.other.alias("other"),
        F.when(c.other == F.col("label"), F.try_divide(c["size"] - V.dot(c.total, F.col("u")), c["size"] - 1))
        .otherwise(1 - V.dot(c.total, F.col("u")) / c["size"]).alias("d")))
    wide = wide.withColumn("m", mean)
    a = F.filter("m", lambda e: e.other == F.col("label"))[0].d
    b = F.array_min(F.transform(F.filter("m", lambda e: e.other != F.col("label")), lambda e: e.d))
    return wide.select("id", "label", a.alias("a"), b.alias("b")).select(
        "id", "label", F.when(F.col("a").isNull(), 0.0).otherwise(
            F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("s"))


def euclidean_silhouette_rows(df: DataFrame, id_col: str, vec: str, label: str = "label",
                              block_rows: int | None = None) -> DataFrame:
    """(id, label, s): exact Euclidean silhouette per row without noise."""
    rows = valid(df, label)
    far = pairs.distance_to_labels(rows, id_col, vec, label, "euclidean", block_rows)
    own = rows.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("own"))
    means = own.join(far.withColumn("d", F.col("dist") / F.col("n")), "id", "left")
    both = means.groupBy("id", "own").agg(
        F.max(F.when(F.col("label") == F.col("own"), F.col("d"))).alias("a"),
        F.min(F.when(F.col("label") != F.col("own"), F.col("d"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return both.select("id", F.col("own").alias("label"), F.when(F.col("a").isNull(), 0.0).otherwise(s).alias("s"))


def euclidean_silhouette(df: DataFrame, id_col: str, vec: str, label: str = "label",
                         block_rows: int | None = None) -> DataFrame:
    """One row: the mean, null below 3 rows or 2 clusters."""
    s = euclidean_silhouette_rows(df, id_col, vec, label, block_rows)
    return s.agg(F.when((F.count(F.lit(1)) >= 3) & (F.countDistinct("label") >= 2), F.avg("s")).alias("silhouette"),
                 F.count(F.lit(1)).alias("n"))


def calinski_harabasz(df: DataFrame, vec: str, label: str = "label") -> DataFrame:
    """One row: between over within sum of squares, each by its degrees of freedom."""
    rows = valid(df, label)
    mu = constant(centroids(rows, vec).select("mean"))
    shifted = rows.withColumn("_mu", mu).select(
        F.col(label).alias("label"), V.subtract(F.col(vec), F.col("_mu")).alias("x"))
    v = array_to_vector("x")
    by = shifted.groupBy("label").agg(
        vector_to_array(Summarizer.sum(v)).alias("s"), F.count(F.lit(1)).alias("n"),
        F.sum(V.dot(F.col("x"), F.col("x"))).alias("sq"))
    between = V.dot(F.col("s"), F.col("s")) / F.col("n")
    t = by.agg(F.sum(between).alias("b"), F.sum(F.col("sq") - between).alias("w"),
               F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return t.select((F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1)))
                    .alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vec: str, label: str = "label") -> DataFrame:
    """One row: mean over clusters of the worst (scatter_i + scatter_j) / centroid distance."""
    rows = valid(df, label).select(F.col(label).alias("label"), F.col(vec).alias("x"))
    mid = centroids(rows, "x", "label")
    far = rows.join(mid, "label").withColumn("d", V.norm2(V.subtract(F.col("x"), F.col("mean"))))
    scatter = far.groupBy("label").agg(F.avg("d").alias("s"))
    c = mid.join(scatter, "label").select("label", "mean", "s")
    packed = constant(c.agg(F.collect_list(F.struct("label", "mean", "s")).alias("all")))
    ratios = F.transform(
        F.filter("all", lambda o: o.label != F.col("label")),
        lambda o: (F.col("s") + o.s) / V.norm2(V.subtract(F.col("mean"), o["mean"])))
    return c.withColumn("all", packed).agg(F.avg(F.array_max(ratios)).alias("davies_bouldin"))


def size_stats(df: DataFrame, label: str = "label") -> DataFrame:
    """Smallest, largest, mean, spread and median of the cluster sizes."""
    sizes = valid(df, label).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"),
                     F.stddev_pop("n").alias("std_size"), F.median("n").alias("median_size"))


# --- agreement --------------------------------------------------------------

def _pairs_of(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def agreement(df: DataFrame, a: str, b: str, *group: str) -> DataFrame:
    """(group, n, k_a, k_b, ari, nmi) from the table of counts of two labelings.

    Only the counts are shuffled. Both scores are 1 when each side has a single cluster.
    """
    cells = df.groupBy(*group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = cut_lineage(cells)
    rows = cells.groupBy(*group, "a").agg(F.sum("n").alias("n"))
    cols = cells.groupBy(*group, "b").agg(F.sum("n").alias("n"))
    xlogx = F.col("n") * F.log(F.col("n").cast("double"))

    def side(t, tag):
        return t.groupBy(*group).agg(F.sum(_pairs_of(F.col("n"))).alias(f"p_{tag}"), F.sum(xlogx).alias(f"e_{tag}"),
                                     F.count(F.lit(1)).alias(f"k_{tag}"))

    cell = cells.groupBy(*group).agg(F.sum(_pairs_of(F.col("n"))).alias("p"), F.sum(xlogx).alias("e"),
                                     F.sum("n").alias("n"))
    if group:
        t = cell.join(side(rows, "a"), list(group)).join(side(cols, "b"), list(group))
    else:
        one = F.lit(1).alias("_one")
        t = cell.select("*", one).join(side(rows, "a").select("*", one), "_one") \
            .join(side(cols, "b").select("*", one), "_one").drop("_one")
    n = F.col("n").cast("double")
    expected = F.col("p_a") * F.col("p_b") / _pairs_of(n)
    top = (F.col("p_a") + F.col("p_b")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("p") - expected) / (top - expected))
    h_a, h_b = F.log(n) - F.col("e_a") / n, F.log(n) - F.col("e_b") / n
    mutual = F.log(n) + (F.col("e") - F.col("e_a") - F.col("e_b")) / n
    nmi = F.when((F.col("k_a") == 1) & (F.col("k_b") == 1), 1.0) \
        .when((F.col("k_a") == 1) | (F.col("k_b") == 1), 0.0) \
        .otherwise(F.greatest(mutual, F.lit(0.0)) / ((h_a + h_b) / 2))
    return t.select(*group, F.col("n").cast("bigint").alias("n"), "k_a", "k_b", ari.alias("ari"), nmi.alias("nmi"))


def method_agreement(wide: DataFrame, methods: Sequence[str]) -> DataFrame:
    """(method_1, method_2, ari, nmi) for all pairs of label columns.

    Noise on either side is left out; both scores are null below 3 rows or 2 clusters. The number
    of methods is small and known; each row is expanded once per pair of methods.
    """
    two = [F.struct(F.lit(x).alias("method_1"), F.lit(y).alias("method_2"), F.col(x).alias("a"), F.col(y).alias("b"))
           for i, x in enumerate(methods) for y in methods[i + 1:]]
    long = wide.select(F.explode(F.array(*two)).alias("e")).select("e.*")
    scored = agreement(long.where("a >= 0 and b >= 0"), "a", "b", "method_1", "method_2")
    ok = (F.col("n") > 2) & (F.col("k_a") > 1) & (F.col("k_b") > 1)
    names = wide.sparkSession.createDataFrame(
        [(x, y) for i, x in enumerate(methods) for y in methods[i + 1:]], "method_1 string, method_2 string")
    return names.join(scored, ["method_1", "method_2"], "left").select(
        "method_1", "method_2", F.when(ok, F.col("ari")).alias("ari"), F.when(ok, F.col("nmi")).alias("nmi"))


def align_labels(df: DataFrame, ref: str, pred: str) -> DataFrame:
    """(pred, ref, n): the reference label each predicted label overlaps most; ties to the smaller."""
    cells = df.groupBy(F.col(pred).alias("pred"), F.col(ref).alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("ref")).alias("low"))).alias("m")
    return cells.groupBy("pred").agg(best).select("pred", (-F.col("m.low")).alias("ref"), F.col("m.n").alias("n"))


# --- prediction scores ------------------------------------------------------

def roc_auc(df: DataFrame, y: str, score: str, *group: str) -> DataFrame:
    """(group, n, auc) for a 0/1 target; ties count half."""
    by = df.groupBy(*group, score).agg(F.sum(F.col(y).cast("bigint")).alias("pos"),
                                       F.sum((1 - F.col(y)).cast("bigint")).alias("neg"))
    by = cut_lineage(by)
    ranked = running_totals(by, score, ["neg"], group)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    total = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*group).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"),
                                      F.try_divide(wins, total).alias("auc"))


def roc_auc_ovr(df: DataFrame, y: str, probability: str, n_classes: int) -> DataFrame:
    """Macro mean of the one-versus-rest AUCs of a probability array."""
    long = df.select(F.col(y).alias("_y"), F.posexplode(probability).alias("cls", "p")) \
        .withColumn("hit", (F.col("_y") == F.col("cls")).cast("int")).where(F.col("cls") < n_classes)
    return roc_auc(long, "hit", "p", "cls").agg(F.avg("auc").alias("auc"))


def accuracy(df: DataFrame, y: str, pred: str, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"),
                                  F.count(F.lit(1)).alias("n"))


def fold_scores(df: DataFrame, y: str, pred: str, fold: str = "fold") -> DataFrame:
    """Mean and population spread of the accuracy over folds."""
    return accuracy(df, y, pred, fold).agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))
