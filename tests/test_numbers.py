import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlens.functions import tails
from reportlens.operators import cluster, metrics, outcome, pairs, ranking, reduce, stability, tables
from reportlens.operators.components import components

RNG = np.random.default_rng(5)
POINTS = np.concatenate([RNG.normal(c, 0.4, (40, 5)) for c in (0, 2, 4)]).astype(float)
LABELS = np.repeat([0, 1, 2], 40)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, [float(x) for x in p], int(c)) for i, (p, c) in enumerate(zip(POINTS, LABELS))]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label int").repartition(3).cache()


def dist(metric="euclidean"):
    if metric == "cosine":
        u = POINTS / np.linalg.norm(POINTS, axis=1, keepdims=True)
        return 1 - u @ u.T
    return np.sqrt(((POINTS[:, None] - POINTS[None]) ** 2).sum(-1))


def silhouettes(d, lab):
    out = []
    for i in range(len(lab)):
        means = {c: d[i, (lab == c) & (np.arange(len(lab)) != i)].mean() for c in np.unique(lab)}
        a, b = means[lab[i]], min(v for c, v in means.items() if c != lab[i])
        out.append((b - a) / max(a, b))
    return np.array(out)


# --- ranks ----------------------------------------------------------------------

def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, "hot").otherwise("cold"))
    one = ranking.shuffled_rank(df.repartition(1), ["id"], 3, ["g"]).collect()
    many = ranking.shuffled_rank(df.repartition(16), ["id"], 3, ["g"]).collect()
    assert sorted(one) == sorted(many)
    assert sorted(r["rank"] for r in one if r.g == "hot") == list(range(1, 401))


def test_global_rank(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.col("id") % 10)
    got = {r.id: r["rank"] for r in ranking.global_rank(df, [F.desc("v"), "id"]).collect()}
    order = sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert got == {i: n for n, i in enumerate(order, 1)}


def test_running_totals_and_quantiles(spark):
    values = RNG.integers(0, 60, 800)
    df = spark.createDataFrame([(int(v), int(i % 3 == 0)) for i, v in enumerate(values)], "v int, g int")
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    for r in ranking.running_totals(counts, "v", ["n"], (), [10.0, 20.0, 40.0]).collect():
        assert r.before_n == (values < r.v).sum()
    q = tables.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.99}, "g").collect()
    for r in q:
        part = values[(np.arange(800) % 3 == 0) == bool(r.g)]
        assert np.allclose([r.a, r.b, r.c], np.quantile(part, [0.1, 0.5, 0.99]))


def test_splits_and_draws(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    folds = ranking.stratified_folds(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()
    assert all(max(r["count"] for r in folds if r.y == y) - min(r["count"] for r in folds if r.y == y) <= 1 for y in (0, 1))
    assert ranking.subsample(df, 0.8, ["id"], 1).count() == math.floor(103 * 0.8)
    draw = ranking.bootstrap(df, 200, ["id"], 1)
    assert draw.count() == 200 and draw.select("id").distinct().count() < 103


# --- pairs ----------------------------------------------------------------------

def test_tiles_equal_brute_force(points):
    d = dist()
    near = pairs.nearest(points, "id", "vec", 4, "euclidean", block_rows=25).collect()
    for r in near:
        order = np.argsort(np.where(np.arange(120) == r.id, np.inf, d[r.id]))
        assert r.other == order[r["rank"] - 1]
    counts = {r.id: r.n for r in pairs.neighbour_counts(points, "id", "vec", 0.9, "euclidean", block_rows=25).collect()}
    assert counts == {i: int((d[i] <= 0.9).sum()) for i in range(120)}
    for r in pairs.label_distances(points, "id", "vec", "label", block_rows=25).collect():
        assert math.isclose(r.mean_dist, d[np.ix_(LABELS == r.label_a, LABELS == r.label_b)].mean(), rel_tol=1e-9)


def test_silhouettes(points):
    for block in (25, 500):
        s = {r.id: r.s for r in metrics.euclidean_silhouette_rows(points, "id", "vec", block_rows=block).collect()}
        assert np.allclose([s[i] for i in range(120)], silhouettes(dist(), LABELS))
    c = silhouettes(dist("cosine"), LABELS)
    assert math.isclose(metrics.cosine_silhouette(points, "vec"), c.mean(), rel_tol=1e-9)
    s = {r.id: r.s for r in metrics.cosine_silhouette_rows(points, "id", "vec").collect()}
    assert np.allclose([s[i] for i in range(120)], c)


def test_guards(points):
    one = points.withColumn("label", F.lit(0))
    assert metrics.cosine_silhouette(one, "vec") is None
    assert metrics.euclidean_silhouette(one, "id", "vec").first().silhouette is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200), (100, 102)]
    got = {r.id: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {i: got[i] for i in range(61)} == dict.fromkeys(range(61), 0)
    assert {got[i] for i in (100, 101, 102)} == {100}


def test_components_of_struct_ids(spark):
    """Few links between struct ids, as near-duplicate classes have them: settled by one task, null members first."""
    n = [(None, 7), (4, 2), (5, 1), (8, 1), (9, 0), (9, 1), (6, None)]
    links = spark.createDataFrame([(n[2], n[1]), (n[1], n[0]), (n[3], n[5]), (n[5], n[4]), (n[6], n[6])],
                                  "a struct<id:bigint,f1:bigint>, b struct<id:bigint,f1:bigint>")
    got = {tuple(r.id): tuple(r.root) for r in components(links).collect()}
    assert got == {n[0]: n[0], n[1]: n[0], n[2]: n[0], n[3]: n[3], n[4]: n[3], n[5]: n[3]}
    assert got == {tuple(r.id): tuple(r.root) for r in components(links, finish=0).collect()}
    words = spark.createDataFrame([("b", "é"), ("z", "b"), ("", "q")], "a string, b string")
    assert {r.id: r.root for r in components(words).collect()} == {"b": "b", "z": "b", "é": "b", "": "", "q": ""}
    assert components(links.where("false")).count() == 0


def brute_dbscan(d, eps, m):
    near = d <= eps
    core = near.sum(1) >= m
    label = np.full(len(d), -1)
    n = 0
    for i in range(len(d)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = n
            while stack:
                for j in np.nonzero(near[stack.pop()] & core & (label < 0))[0]:
                    label[j] = n
                    stack.append(j)
            n += 1
    for i in np.nonzero(~core)[0]:
        hit = label[near[i] & core]
        label[i] = hit.min() if len(hit) else -1
    return label


@pytest.mark.parametrize("eps,m", [(0.8, 4), (0.6, 5)])
def test_dbscan(points, monkeypatch, eps, m):
    monkeypatch.setattr(pairs, "TILE_FLOATS", 64 * 5)
    got = {r.id: r.label for r in cluster.dbscan(points, "id", "vec", eps, m, "euclidean").labels.collect()}
    assert [got[i] for i in range(120)] == brute_dbscan(dist(), eps, m).tolist()


def test_reach_links_hold_the_spanning_tree(points):
    core = cluster.neighbour_distance(points, "id", "vec", 4, "euclidean")
    rows = points.join(core.withColumnRenamed("dist", "c"), "id")
    links = pairs.reach_links(rows, "id", "vec", "c", block_rows=25).collect()
    c = {r.id: r.dist for r in core.collect()}
    d = np.maximum(dist(), np.maximum.outer([c[i] for i in range(120)], [c[i] for i in range(120)]))

    def tree(edges):
        root, total = list(range(120)), 0.0
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for w, a, b in sorted(edges):
            if find(a) != find(b):
                root[find(a)] = find(b)
                total += w
        return total

    everything = [(d[i, j], i, j) for i, j in itertools.combinations(range(120), 2)]
    assert math.isclose(tree([(r.w, r.a, r.b) for r in links]), tree(everything), rel_tol=1e-9)


# --- clustering and scores --------------------------------------------------------

@pytest.mark.parametrize("method,params", [
    ("kmeans", {"n_init": 2}), ("gmm", {}), ("hierarchical", {"method": "ward"}), ("hierarchical", {"method": "complete"}),
    ("hierarchical", {"method": "average"}), ("hdbscan", {"min_cluster_size": 10})])
def test_clear_groups_are_found(points, method, params):
    shifted = points.withColumn("vec", F.transform("vec", lambda x, i: F.when(i == 0, 5 - 2 * F.col("label")).otherwise(x)))
    found = cluster.cluster(shifted, "id", "vec", method, 3, **params)
    both = shifted.drop("vec").withColumnRenamed("label", "ref").join(found.labels, "id").where("label >= 0")
    assert both.count() >= 60
    assert metrics.agreement(both, "ref", "label").first().ari > 0.9


def test_sweep_reports_every_run(points):
    runs, labels = cluster.sweep(points, "id", "vec", [("kmeans", {"k": 3, "n_init": 1}), ("gmm", {"k": 2}), ("none", {})])
    status = [r.status for r in runs.orderBy("ordinal").collect()]
    assert status == ["ok", "ok", "failed: ValueError"]
    assert labels.count() == 240


def test_a_failing_method_ends_the_comparison(points, monkeypatch):
    """A job that fails in a task and an unknown method are no rows; one cluster is a row without a score."""
    def broken(df, i, v, k):
        labels = df.select("id", F.raise_error(F.lit("the task failed")).cast("int").alias("label"))
        return cluster.Found(labels, "Broken", {})

    monkeypatch.setitem(cluster.METHODS, "broken", broken)
    for name in ("broken", "none"):
        with pytest.raises(Exception, match="the task failed|unknown method none"):
            cluster.compare_methods(points, "id", "vec", ["kmeans", name], 2)
    monkeypatch.setitem(cluster.METHODS, "one", lambda df, i, v, k: cluster.Found(df.select("id", F.lit(0).alias("label")), "One", {}))
    got = cluster.compare_methods(points.drop("label"), "id", "vec", ["kmeans", "one"], 3).collect()
    assert [(r.method, r.silhouette is None, r.n_clusters_found) for r in got] == [("kmeans", False, 3), ("one", True, 1)]


def test_agreement_properties(points):
    same = points.withColumn("other", 7 - F.col("label"))
    r = metrics.agreement(same, "label", "other").first()
    assert math.isclose(r.ari, 1) and math.isclose(r.nmi, 1)
    single = points.withColumn("other", F.lit(1))
    r = metrics.agreement(single, "label", "other").first()
    assert abs(r.ari) < 1e-12 and r.nmi == 0


def test_auc_with_ties(spark):
    y, s = RNG.integers(0, 2, 300), RNG.integers(0, 20, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, s)], "y int, s int")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert math.isclose(metrics.roc_auc(df, "y", "s").first().auc, want, rel_tol=1e-9)


def test_pca(points):
    x = POINTS - POINTS.mean(0)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    fit = reduce.pca(points, "vec", 3)
    assert np.allclose(fit.shares, (values / values.sum())[:3])
    rows, shares = reduce.wide_pca(points, "vec", 3)
    assert np.allclose(shares, (values / values.sum())[:3], rtol=1e-6)
    a = np.array([r.reduced for r in fit.rows.orderBy("id").collect()])
    b = np.array([r.reduced for r in rows.orderBy("id").collect()])
    assert np.allclose(np.abs(a - a.mean(0)), np.abs(b), atol=1e-6)
    two = reduce.two_stage_pca(points, "vec", 4, 2)
    assert math.isclose(two.shares[2], values[:2].sum() / values.sum(), rel_tol=1e-9)
    assert reduce.safe_dims(6, 100, 5, 3) == (5, 3) and reduce.safe_dims(2, 100, 5, 3) == (1, 1)


def test_noise_is_fixed_by_id(points):
    a = reduce.add_noise(points.repartition(1), "vec", "id", 0.1, 3).select("id", "noisy").orderBy("id").collect()
    b = reduce.add_noise(points.repartition(9), "vec", "id", 0.1, 3).select("id", "noisy").orderBy("id").collect()
    assert np.allclose([r.noisy for r in a], [r.noisy for r in b], rtol=1e-12)
    zero = reduce.add_noise(points, "vec", "id", 0.0, 3).where("noisy <> vec").count()
    assert zero == 0


def test_consensus_tiles_equal_brute_force(spark):
    lab = RNG.integers(-1, 3, (70, 5))
    ref = RNG.integers(0, 2, 70)
    rows = [(i, t, int(lab[i, t])) for i in range(70) for t in range(5) if lab[i, t] >= 0]
    arrays = stability.label_arrays(spark.createDataFrame(rows, "id int, iter int, label int"), spark.createDataFrame(
        [(i, int(r)) for i, r in enumerate(ref)], "id int, label int"), 5)
    for block in (20, 500):
        got = {(r.same_ref, r.n_both, r.n_same): r.pairs for r in stability.consensus_counts(arrays, block).collect()}
        want = {}
        for i, j in itertools.combinations(range(70), 2):
            both = (lab[i] >= 0) & (lab[j] >= 0)
            if both.any():
                key = (bool(ref[i] == ref[j]), int(both.sum()), int((both & (lab[i] == lab[j])).sum()))
                want[key] = want.get(key, 0) + 1
        assert got == want


def test_consensus_of_equal_rows_is_weighted(spark, monkeypatch):
    """Rows with one reference label and the same labels enter the tiles once; their pairs are all counted."""
    patterns = [(0, [0, 1, None]), (0, [0, None, 1]), (1, [1, 1, 1]), (1, [None, None, None])]
    rows = [(i, *patterns[i % 4]) for i in range(403)]
    arrays = spark.createDataFrame(rows, "id long, ref int, labels array<int>")
    sent, plain = [], stability.pairs.tiles
    monkeypatch.setattr(stability.pairs, "tiles", lambda df, *a: (sent.append(df.count()), plain(df, *a))[1])
    for block in (None, 2):
        want = {}
        for a in range(403):
            for b in range(a):
                x, y = rows[a][2], rows[b][2]
                both = sum(p is not None and q is not None for p, q in zip(x, y))
                if both:
                    key = rows[a][1] == rows[b][1], both, sum(p is not None and p == q for p, q in zip(x, y))
                    want[key] = want.get(key, 0) + 1
        assert {(r.same_ref, r.n_both, r.n_same): r.pairs for r in stability.consensus_counts(arrays, block).collect()} == want
    assert sent == [4, 4]



# --- tests and survival -------------------------------------------------------------

def test_tails():
    assert math.isclose(tails.normal_two_sided(1.959963985), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.chi2_tail(3.841458821, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.chi2_tail(18.30703805, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.f_tail(4.964602744, 1, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-6)


def efron_loglik(beta, t, e, x):
    w = np.exp(x @ beta)
    out = 0.0
    for at in np.unique(t[e == 1]):
        dead = (t == at) & (e == 1)
        d, risk, tied = dead.sum(), w[t >= at].sum(), w[dead].sum()
        out += (x[dead] @ beta).sum() - sum(math.log(risk - i / d * tied) for i in range(d))
    return out


def test_cox_maximises_the_efron_likelihood(spark):
    n = 200
    x = np.stack([RNG.normal(size=n), RNG.integers(0, 2, n)], 1)
    t = np.ceil(RNG.exponential(20 * np.exp(-0.5 * x[:, 0])))
    e = RNG.integers(0, 2, n)
    df = spark.createDataFrame([(float(a), int(b), float(c), "yn"[int(d)]) for a, b, (c, d) in zip(t, e, x)],
                               "time double, event int, x double, g string")
    x[:, 1] = 1 - x[:, 1]      # 'n' sorts first, so the dummy is g_y = (d == 0)
    fit = {r.variable: r for r in outcome.cox(df, ["x", "g"], "time", "event").collect()}
    beta = np.array([fit["x"].coef, fit["g_y"].coef])
    best = efron_loglik(beta, t, e, x)
    for step in (1e-3, -1e-3):
        for k in range(2):
            other = beta.copy()
            other[k] += step
            assert efron_loglik(other, t, e, x) < best
    shifted = efron_loglik(beta, t, e, x)
    assert math.isclose(fit["x"].log_likelihood, shifted, rel_tol=1e-6)


def test_efron_closed_form():
    s0, d0, d = 9000.0, 4100.0, 2500
    c = np.arange(d) / d
    r = s0 - c * d0
    want = (np.log(r).sum(), (1 / r).sum(), (c / r).sum(), (1 / r**2).sum(), (c / r**2).sum(), (c * c / r**2).sum())
    assert np.allclose(outcome._efron(s0, d0, d), want, rtol=1e-8)


def test_baseline_text(spark):
    df = spark.createDataFrame([(1.0, "No", "a"), (2.0, "Yes", "a"), (4.0, "Yes", "b"), (None, "No", "b")],
                               "age double, steroid string, g string")
    got = {(r.stratum, r.label): r.value for r in outcome.baseline_table(df, ["age"], ["steroid"], [], "g").collect()}
    assert got[("Overall", "Corticosteroid therapy")] == "2 (50.0)"
    assert got[("Overall", "Age (years)")] == "2.3 (1.5)"
    assert got[("a", "n")] == "2"


def test_kruskal_needs_enough_rows(spark):
    df = spark.createDataFrame([("v", "r", c, float(i)) for i, c in enumerate("aaabb")], "variable string, risk string, c string, x double")
    assert outcome.kruskal(df, "x", "c", "variable", "risk", min_rows=3).count() == 0


def test_t_quantiles():
    """Closed forms for one and two degrees of freedom, and the normal limit."""
    import math
    from reportlens.functions import tails
    assert abs(tails.t_quantile(1) - math.tan(0.475 * math.pi)) < 1e-7
    assert abs(tails.t_quantile(2) - 0.95 * math.sqrt(2 / (1 - 0.95 ** 2))) < 1e-8
    assert abs(tails.t_quantile(1e7) - 1.959963984540054) < 1e-5


def test_tail_columns(spark):
    """Columns equal the numbers over wide degrees of freedom, ends included; nothing known gives null."""
    import random
    random.seed(3)
    rows = [(random.choice([0.001, 0.5, 2.0, 30.0, 400.0, 4000.0]) * random.random() * 2, random.choice([1, 2, 3, 7, 30, 3000]),
             random.choice([1, 5, 40, 1000])) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, a int, b int")
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    got = df.select("x", "a", "b", tails.chi2_p(x, a).alias("c"), tails.f_p(x, a, b).alias("f"), tails.normal_p(x).alias("n"),
                    tails.t_p(x, b).alias("t")).collect()
    for r in got:
        for have, want in ((r.c, tails.chi2_tail(r.x, r.a)), (r.f, tails.f_tail(r.x, r.a, r.b)),
                           (r.n, tails.normal_two_sided(r.x)), (r.t, tails.t_two_sided(r.x, r.b))):
            assert math.isclose(have, want, rel_tol=1e-8, abs_tol=1e-13), r
    ends = spark.createDataFrame([(None, 1), (float("nan"), 1), (-1.0, 1), (0.0, 1), (float("inf"), 1), (1.0, 0), (1.0, None)], "x double, a int")
    got = ends.select(tails.chi2_p(x, a).alias("c"), tails.f_p(x, a, F.lit(3)).alias("f")).collect()
    assert [(r.c, r.f) for r in got] == [(None, None), (None, None), (1, 1), (1, 1), (0, 0), (None, None), (None, None)]
