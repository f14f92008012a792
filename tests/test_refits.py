"""Many refits at once against one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlens.operators import metrics, ranking, reduce, refits, stability
from reportlens.plans import vector_queries
from reportlens.plans.registry import Tables

RNG = np.random.default_rng(11)
X = np.concatenate([RNG.normal(c, 0.5, (30, 6)) for c in (0, 3, 6)])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, [float(v) for v in x], i // 30) for i, x in enumerate(X)], "id bigint, vec array<double>, label int").cache()


def test_reduction_of_each_iteration(spark, rows):
    """The rows of an iteration on the main axes of these rows alone."""
    each = rows.select(F.explode(F.array(F.lit(0), F.lit(3))).alias("iter"), "id", "vec").where("iter = 0 or id % 2 = 1")
    got = refits.reduced_each(each.repartition(3), X.mean(axis=0), 5, 2).collect()
    for i, of in ((0, np.arange(90)), (3, np.arange(1, 90, 2))):
        mine = sorted((r.id, r.vec) for r in got if r.iter == i)
        x = X[of] - X[of].mean(axis=0)
        want = x @ np.linalg.svd(x, full_matrices=False)[2][:2].T
        assert [a for a, _ in mine] == of.tolist()
        assert np.allclose(np.abs([v for _, v in mine]), np.abs(want))


def test_kmeans_of_each_iteration(spark, rows):
    """Every iteration finds its own groups, and its labels are those of the nearest means."""
    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("iter"), "id", "vec")
    each = each.withColumn("vec", F.transform("vec", lambda v: v * (1 + F.col("iter")))).where("id % (iter + 2) <> 1")
    labels = refits.kmeans_each(each.repartition(4), 3, n_init=4).cache()
    assert labels.count() == each.count()
    ref = rows.select("id", F.col("label").alias("ref"))
    for r in metrics.agreement(labels.join(ref, "id"), "ref", "label", "iter").collect():
        assert r.ari == pytest.approx(1)
    two = refits.kmeans_each(each.where("iter = 0"), 2, n_init=6).toPandas().sort_values("id")
    x, lab = X[two["id"]], two["label"].to_numpy()
    means = np.array([x[lab == c].mean(axis=0) for c in (0, 1)])
    assert (((x[:, None] - means[None]) ** 2).sum(2).argmin(1) == lab).all()
    few = spark.createDataFrame([(0, 1, [1.0]), (0, 2, [1.0]), (1, 1, [2.0])], "iter int, id int, vec array<double>")
    assert refits.kmeans_each(few, 3, 2).count() == 3


def test_subsamples_and_noise_are_those_of_single_iterations(rows, monkeypatch):
    """The rows of an iteration do not depend on how many are worked on at once."""
    seen = {}
    monkeypatch.setattr(refits, "reduced_each", lambda some, *a: some)
    monkeypatch.setattr(refits, "kmeans_each", lambda some, *a, **kw: some.select("iter", "id", F.to_json("vec").alias("label")))
    for at_once in (1000, 1):
        monkeypatch.setattr(stability, "REFIT_ROWS", at_once)
        parts = stability.subsample_labels(rows, "id", "vec", n_iter=3, frac=0.7), stability.noise_labels(rows, "id", "vec", n_iter=2)
        seen[at_once] = [sorted(map(tuple, p.collect())) for p in parts]
    assert seen[1000] == seen[1]
    for i in range(3):
        assert sorted(r[1] for r in seen[1][0] if r[0] == i) == sorted(r.id for r in ranking.subsample(rows, 0.7, ["id"], 42 + i).collect())
    for i in range(2):
        want = reduce.add_noise(rows, "vec", "id", 0.01, i).select("id", F.to_json("noisy").alias("j")).collect()
        assert [r[1:] for r in seen[1][1] if r[0] == i] == sorted(map(tuple, want))


def test_other_methods_are_refitted_one_by_one(rows):
    found = stability.subsample_labels(rows, "id", "vec", "gmm", 3, 2, 0.8, 5, 2)
    assert found.groupBy("iter").count().orderBy("iter").collect() == [(0, 72), (1, 72)]


def test_stability_table_does_all_its_iterations(spark, rows, tmp_path):
    """200 subsamples and 100 rounds of noise, as the operators do unless told otherwise."""
    rows.select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.analysis: r for r in vector_queries.stability_table(Tables(spark, str(tmp_path))).collect()}
    assert {a: r.n_iter for a, r in got.items()} == {"Subsampling consensus stability": 200, "Perturbation stability": 100}
    assert all(r.mean_ari == 1 and r.std_ari == 0 for r in got.values())
    table = got["Subsampling consensus stability"]
    assert (table.within, table.between, table.pac) == (1, 0, 0)
