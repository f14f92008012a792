"""Histogram boosting against a plain version on the same bins."""

import numpy as np
import pytest

from reportlens.operators import boosting


def plain(model, x, y, classes, rounds, depth, step, l2=1.0, least=1.0):
    """Probabilities of boosted trees, every split tried one by one."""
    bins, n_out = model.binned(x), classes if classes > 2 else 1
    score = np.zeros((len(x), n_out))

    def grow(rows, g, h, level):
        best = (0.0, None)
        if level < depth:
            for j in range(x.shape[1]):
                for b in range(int(bins[:, j].max())):
                    left = rows & (bins[:, j] <= b)
                    right = rows & ~left
                    if h[left].sum() < least or h[right].sum() < least:
                        continue
                    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
                    gain = round(part(left) + part(right) - part(rows), 9)
                    if gain > best[0]:
                        best = (gain, (left, right))
        if best[1] is None:
            return np.where(rows, -step * g[rows].sum() / (h[rows].sum() + l2), 0.0)
        return grow(best[1][0], g, h, level + 1) + grow(best[1][1], g, h, level + 1)

    for _ in range(rounds):
        p, add = model.probability(score), np.zeros_like(score)
        for k in range(n_out):
            c = k if n_out > 1 else 1
            q = p[:, c]
            add[:, k] = grow(np.ones(len(x), dtype=bool), q - (y == c), q * (1 - q), 0)
        score = score + add
    return model.probability(score)


@pytest.mark.parametrize("classes", [2, 4])
def test_equals_plain_boosting(spark, classes, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)            # scores are written again within the four rounds
    rng = np.random.default_rng(classes)
    x = rng.standard_normal((240, 4)).round(2)
    x[::17, 1] = np.nan
    y = (np.nan_to_num(x[:, 1]) + x[:, 0] * x[:, 2] > 0).astype(int) + (2 * (x[:, 3] > 0.3) if classes == 4 else 0)
    rows = spark.createDataFrame([(i, list(map(float, v)), float(c)) for i, (v, c) in enumerate(zip(x, y))],
                                 "id int, vec array<double>, label double").repartition(5)
    model = boosting.fit(rows, classes, rounds=4, depth=3, step=0.3, bins=16)
    got = model.predict(rows).orderBy("id").collect()
    want = plain(model, x, y, classes, 4, 3, 0.3)
    assert np.allclose([r.probability for r in got], want, atol=1e-7)
    assert [r.prediction for r in got] == [int(np.argmax(p)) for p in np.array([r.probability for r in got])]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0], 0.0), (2, [1.0], 1.0), (3, None, 1.0), (4, [2.0], None)],
                                 "id int, vec array<double>, label double")
    same = boosting.fit(rows, 2, rounds=3, depth=2)                 # one value: nothing to split
    assert same.rounds == [] and {r.id: r.probability for r in same.predict(rows).collect()}[3] is None
    assert boosting.fit(rows.where("id > 9"), 3).predict(rows.where("id = 1")).first().probability == [1 / 3] * 3
    with pytest.raises(ValueError):
        boosting.fit(rows, 2, bins=1)


def test_one_common_value_and_rare_others(spark):
    """Three quarters of the rows share one value, so most quantiles fall together."""
    x = [0.0] * 300 + [float(i) for i in range(1, 101)]
    rows = spark.createDataFrame([(i, [v], float(v > 50) + float(v > 0)) for i, v in enumerate(x)],
                                 "id int, vec array<double>, label double")
    out = boosting.fit(rows, 3, rounds=6, depth=2, step=0.5).predict(rows)
    assert out.where("prediction <> label").count() <= 3
