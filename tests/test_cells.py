"""Pairs through cells against all pairs, with many small tiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from reportlens.operators import cells, cluster, components, pairs
from reportlens.operators.cells import Cells

RNG = np.random.default_rng(21)


def some(spark, kind):
    """Planted groups, copies, zero vectors and far-off rows."""
    centres = RNG.normal(size=(6, 5)) * 10
    points = [centres[i % 6] + RNG.normal(size=5) * 0.3 for i in range(150)]
    points += [points[0]] * 12 + [np.zeros(5)] * 2 + [np.full(5, 1e4)]
    names = [f"k{i:03d}" if kind == "string" else i for i in range(len(points))]
    return np.array(points), names, spark.createDataFrame([(n, [float(x) for x in p], i % 3 == 0) for i, (n, p) in enumerate(zip(names, points))], f"id {kind}, vec array<double>, flag boolean").repartition(4)


def all_distances(points, metric):
    if metric == "cosine":
        unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
        return 1 - unit @ unit.T
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))


@pytest.mark.parametrize("metric,kind,among", [("euclidean", "long", None), ("cosine", "string", None), ("euclidean", "string", "flag")])
def test_nearest(spark, metric, kind, among):
    points, names, rows = some(spark, kind)
    d = all_distances(points, metric)
    got = {}
    for r in pairs.nearest(rows, "id", "vec", 7, metric, block_rows=16, among=among).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["dist"]))
    for i, name in enumerate(names):
        ok = [j for j in range(len(names)) if j != i and (not among or j % 3 == 0)]
        want = sorted(d[i, j] for j in ok)[:7]
        assert np.allclose([x for _, x in got[name]], want, atol=2e-6 if metric == "euclidean" else 1e-9)
        assert len({o for o, _ in got[name]}) == 7 and name not in {o for o, _ in got[name]}


@pytest.mark.parametrize("metric,eps", [("euclidean", 0.9), ("cosine", 0.01), ("cosine", 2.0)])
def test_counts_and_links(spark, metric, eps):
    points, names, rows = some(spark, "long")
    near = all_distances(points, metric) <= eps
    np.fill_diagonal(near, True)
    counts = {r["id"]: r["n"] for r in pairs.neighbour_counts(rows, "id", "vec", eps, metric, block_rows=16).collect()}
    assert [counts[i] for i in names] == near.sum(1).tolist()
    found = {r["id"]: r["label"] for r in cluster.dbscan(rows, "id", "vec", eps, 4, metric).labels.collect()}
    core = near.sum(1) >= 4
    for i in names:
        assert (found[i] >= 0) == bool((near[i] & core).any())
        assert all(found[i] == found[j] for j in np.flatnonzero(near[i] & core) if core[i])


def test_far_cells_receive_nothing(spark):
    points, names, rows = some(spark, "long")
    index = Cells(rows, "id", "vec", "euclidean", block_rows=8)
    to = index.visits(index.rows.withColumn("reach", F.lit(1.0)))
    assert len(index.count) > 20 and to.count() < 0.5 * len(names) * len(index.count)
    one = rows.limit(1)
    assert pairs.nearest(one, "id", "vec", 3).count() == 0
    assert pairs.nearest(rows.where("false"), "id", "vec", 3).count() == 0
    assert pairs.neighbour_counts(one, "id", "vec", 0.5).first()["n"] == 1


def test_rings_and_text_ids(spark):
    """Two rings, one inside the other, are no round groups, but two parts of the neighbour graph."""
    angle = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    points = np.concatenate([np.stack([np.cos(angle), np.sin(angle)], 1) * r for r in (1.0, 5.0)])
    rows = spark.createDataFrame([(f"t{i:03d}", [float(x) for x in p]) for i, p in enumerate(points)], "id string, vec array<double>")
    labels = {r["id"]: r["label"] for r in cluster.spectral(rows, "id", "vec", 2, neighbours=6, n_init=2, max_iter=15).labels.collect()}
    assert {labels[f"t{i:03d}"] for i in range(24)} == {0} and {labels[f"t{i:03d}"] for i in range(24, 48)} == {1}


def test_leading_vectors(spark):
    a = RNG.random((30, 30)) * (RNG.random((30, 30)) < 0.3)
    a = a + a.T + np.eye(30) * 0.1
    d = a.sum(1)
    s = a / np.sqrt(d[:, None] * d[None])
    affinity = spark.createDataFrame([(int(i), int(j), float(s[i, j])) for i, j in zip(*np.nonzero(s))], "id int, other int, s double")
    got = cluster.leading_vectors(affinity, spark.range(30).select(F.col("id").cast("int")), 3, extra=3, tol=1e-7, max_iter=30).orderBy("id").toPandas()
    x = got[["x0", "x1", "x2"]].to_numpy()
    values, vectors = np.linalg.eigh(s)
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6)
    assert np.allclose(np.abs(vectors[:, -1] @ x[:, 0]), 1, atol=1e-4)
    assert np.allclose(np.diag(x.T @ s @ x), values[::-1][:3], atol=1e-2)


def test_default_sweep(spark):
    points = np.concatenate([RNG.normal(size=(12, 3)) * 0.2 + c for c in ([4, 0, 0], [0, 4, 0])])
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    configs = cluster.default_configs(rows, "id", "vec", ("hdbscan", "kmeans", "hierarchical"), n_init=1, max_k=2)
    count = {m: sum(c[0] == m for c in configs) for m in ("hdbscan", "kmeans", "hierarchical")}
    assert count == {"hdbscan": 8, "kmeans": 1, "hierarchical": 3}
    runs, labels = cluster.sweep(rows, "id", "vec", configs[-1:])
    assert runs.first().status == "ok" and labels.groupBy("label").count().count() == 2


def test_rows_travel_once_per_bin(spark):
    """Wide random rows are near to all cells; a row is sent to a few bins, not to each cell."""
    points = RNG.normal(size=(400, 12))
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    index = Cells(rows, "id", "vec", "euclidean", block_rows=8)
    reach = index.rows.select("id", F.lit(100.0).alias("reach"))

    def seen(targets, visitors):
        return pd.DataFrame({"id": visitors["id"], "n": len(targets), "sent": 0})

    def add(found):
        return found.groupby("id", as_index=False)["n"].sum().assign(sent=1)

    got = index.within(reach, seen, "id long, n bigint, sent int", add).groupBy("id").agg(F.sum("n").alias("n"), F.sum("sent").alias("sent")).collect()
    assert len(got) == 400 and {r.n for r in got} == {400}
    assert len(index.count) > 100 and max(r.sent for r in got) <= 40


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_tile_returns_one_tree(spark, monkeypatch, kind):
    """The slices of a tile give one spanning tree, and all tiles hold the least one."""
    monkeypatch.setattr(cells, "SIDES", 2)
    points = RNG.normal(size=(150, 2))
    names = list(range(150)) if kind == "long" else [f"n{i:03d}" for i in range(150)]
    rows = spark.createDataFrame([(n, [float(x) for x in p], 0.0) for n, p in zip(names, points)], f"id {kind}, vec array<double>, core double")
    links = pairs.reach_links(rows, "id", "vec", "core", block_rows=10).toPandas()
    assert len(links) <= 3 * 150
    links = links.sort_values(["w", "a", "b"])
    d, near, total = all_distances(points, "euclidean"), None, 0.0
    near, done = d[0].copy(), {0}
    for _ in range(149):
        at = min((i for i in range(150) if i not in done), key=lambda i: near[i])
        total, near = total + near[at], np.minimum(near, d[at])
        done.add(at)
    joins = components.join_in_order(links["a"].to_numpy(), links["b"].to_numpy())[2]
    assert joins.sum() == 149 and abs(links["w"].to_numpy()[joins].sum() - total) < 1e-6


@pytest.mark.parametrize("kind", ["long", "string"])
def test_few_links_need_no_rounds(spark, kind):
    names = [f"n{i:02d}" if kind == "string" else i for i in range(40)]
    links = spark.createDataFrame([(names[i + 1], names[i]) for i in range(39) if i != 19] + [(names[3], names[3])], f"a {kind}, b {kind}")
    few = {r["id"]: r["root"] for r in components.components(links, max_rounds=0).collect()}
    assert few == {n: names[0] if i < 20 else names[20] for i, n in enumerate(names)}
    assert few == {r["id"]: r["root"] for r in components.components(links, finish=0).collect()}
