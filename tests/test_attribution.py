"""Exact attribution of forests against every coalition of six features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from reportlens.operators import attribution, explain


def coalition(nodes, x, known, at=0):
    """Prediction of one tree when only the features in known are looked at."""
    r = nodes[at]
    if r.left < 0:
        return np.array(r.stats) / r.cover
    if r.feature in known:
        goes = x[r.feature] <= r.split[0] if r.categories < 0 else x[r.feature] in r.split
        return coalition(nodes, x, known, r.left if goes else r.right)
    lo, hi = nodes[r.left], nodes[r.right]
    return (lo.cover * coalition(nodes, x, known, r.left) + hi.cover * coalition(nodes, x, known, r.right)) / r.cover


def enumerate_values(trees, x, d, cls):
    out = np.zeros(d)
    for f in range(d):
        rest = [g for g in range(d) if g != f]
        for k in range(d):
            w = factorial(k) * factorial(d - k - 1) / factorial(d)
            for s in combinations(rest, k):
                out[f] += w * np.mean([coalition(t, x, {*s, f})[cls] - coalition(t, x, set(s))[cls] for t in trees])
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.standard_normal(3)), "uvw"[int(rng.integers(3))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, k string")
    df = df.withColumn("y", F.expr("cast(case when a + b * c > 0.5 then 2 when k = 'u' or c > 1 then 1 else 0 end as double)"))
    df = df.withColumn("w", F.expr("case when y = 1 then 2.5 else 1.0 end"))
    df = StringIndexer(inputCol="k", outputCol="ki").fit(df).transform(df)
    df = OneHotEncoder(inputCols=["ki"], outputCols=["ko"], dropLast=False).fit(df).transform(df)
    return df.cache()


@pytest.mark.parametrize("columns", [["a", "b", "c", "ko"], ["a", "b", "c", "ki"]])     # flags, and sets of categories
def test_equals_every_coalition(data, columns):
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(data)
    model = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=5, maxDepth=5, seed=3).fit(rows)
    nodes = attribution.node_table(model).toPandas()
    trees = [{r.node: r for r in part.itertuples()} for _, part in nodes.groupby("tree")]
    for cls in (0, 2):
        base = attribution.expected(attribution.forest_paths(model, cls))
        got = attribution.shapley_values(model.transform(rows), model, cls=cls).withColumn("x", vector_to_array("features")) \
            .withColumn("p", vector_to_array("probability")).orderBy("id").collect()
        for r in got:
            assert abs(sum(r.shapley) + base - r.p[cls]) < 1e-9
        for r in got[:12]:
            want = enumerate_values(trees, r.x, len(r.x), cls)
            assert np.allclose(r.shapley, want, atol=1e-9)
        found = {r.feature: r.importance for r in attribution.mean_absolute(rows, model, cls=cls).collect()}
        mean = np.abs([r.shapley for r in got]).mean(axis=0)
        assert np.allclose([found[i] for i in range(len(mean))], mean)


def test_deep_tree_sums_to_its_prediction(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 12))
    rows = spark.createDataFrame([(i, list(map(float, v)), float(np.sin(3 * v).sum() > 0)) for i, v in enumerate(x)],
                                 "id int, v array<double>, y double")
    from pyspark.ml.functions import array_to_vector
    rows = rows.withColumn("features", array_to_vector("v"))
    model = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=18, seed=2).fit(rows)
    base = attribution.expected(attribution.forest_paths(model))
    got = attribution.shapley_values(model.transform(rows), model).withColumn("p", vector_to_array("probability")[1]).collect()
    assert max(abs(sum(r.shapley) + base - r.p) for r in got) < 1e-9


def test_one_leaf_and_no_rows(spark):
    rows = spark.createDataFrame([(float(i), 0.0) for i in range(20)], "a double, y double")
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    model = RandomForestClassifier(labelCol="y", numTrees=2, seed=1).fit(rows)
    assert all(r.shapley == [0.0] for r in attribution.shapley_values(rows, model, cls=0).collect())
    assert attribution.mean_absolute(rows.where("a < 0"), model, cls=0).collect() == []
    assert [tuple(r) for r in attribution.mean_absolute(rows, model, cls=0).collect()] == [(0, 0.0)]


def test_surrogate_names_what_decides(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(rng.standard_normal()), "xyz"[int(rng.integers(3))], "pq"[int(rng.integers(2))]) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, size double, kind string, noise string") \
        .withColumn("label", F.expr("cast(kind = 'x' and size > -0.5 as int)"))
    s = explain.Surrogate(df, "id", "label", trees=15, depth=6)
    encoded = {r.encoded_feature: r.importance for r in s.attribution().collect()}
    assert max(encoded, key=encoded.get) == "cat__kind_x"
    raw = {r.raw_feature: r.importance for r in explain.raw_importance(s.attribution()).collect()}
    assert raw["kind"] > raw["size"] > raw["noise"]
