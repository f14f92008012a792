"""Many reductions and k-means fits at once: a pass over the rows serves the models of all iterations.

Rows are (iter, id, vec), each iteration with its own. A pass returns a few sums per iteration, so the
driver sees covariances and centres only, however many rows an iteration has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import reduce


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(iter, places in the batch, matrix) of each iteration in an Arrow batch."""
    if batch.num_rows:
        of = batch["iter"].to_numpy()
        x = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1)
        order = of.argsort(kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            yield int(of[at[0]]), at, x[at]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def _sums(rows: DataFrame, work: Callable[[int, np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """Per iteration the sum of the numbers that work(iter, matrix) makes of its rows."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, _, x in _parts(batch):
                part = work(i, x)
                if part is not None:
                    total[i] = total[i] + part if i in total else part
        for i, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), _lists(part[None, :])], ["iter", "s"])

    part = rows.select("iter", "vec").mapInArrow(run, "iter int, s array<double>")
    table = part.groupBy("iter").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).toArrow()
    return {i: s.values.to_numpy() for i, s in zip(table["iter"].to_pylist(), table["s"])}


def reduced_each(rows: DataFrame, middle: np.ndarray, intermediate: int, final: int) -> DataFrame:
    """(iter, id, vec): the two-stage PCA of every iteration's rows; middle is near their means, for better rounding."""
    d = len(middle)

    def moments(_, x):
        x = x - middle
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    models = {}
    for i, s in _sums(rows, moments).items():
        n, mean = s[0], s[1:d + 1] / s[0]
        inter, k = reduce.safe_dims(int(n), d, intermediate, final)
        spread = s[d + 1:].reshape(d, d) - n * np.outer(mean, mean)
        models[i] = middle + mean, np.linalg.eigh(spread)[1][:, ::-1][:, :max(1, min(k, inter))]
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def project(batches):
        for batch in batches:
            out = None
            for i, at, x in _parts(batch):
                mean, basis = sent.value[i]
                out = np.empty((batch.num_rows, basis.shape[1])) if out is None else out
                out[at] = (x - mean) @ basis
            if out is not None:
                yield pa.RecordBatch.from_arrays([batch["iter"], batch["id"], _lists(out)], ["iter", "id", "vec"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.select("iter", "id", "vec").mapInArrow(project, f"iter int, id {id_type}, vec array<double>")


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to centres of any shape (..., width): (rows, ...)."""
    c = centres.reshape(-1, x.shape[1])
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
    return np.maximum(d, 0).reshape(len(x), *centres.shape[:-1])


def _draws(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) fixed by key and salt: (keys, salts)."""
    z = keys.view(np.uint64)[:, None] ^ salts[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0 ** -54


def _next_centres(rows: DataFrame, centres: dict[int, np.ndarray], salts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One more centre per model, drawn with a chance as the squared distance to its nearest one (k-means++): the least of
    one exponential draw per row, so a pass is enough."""
    def race(batches):
        best: dict[int, list] = {}
        for batch in batches:
            keys = batch["key"].to_numpy()
            for i, at, x in _parts(batch):
                score = -np.log(_draws(keys[at], salts[i]))
                if centres[i].shape[1]:
                    score = score / np.maximum(_gaps(x, centres[i]).min(axis=2), 1e-300)
                first = score.argmin(axis=0)
                new = score[first, np.arange(len(first))], keys[at][first], x[first]
                if i in best:
                    was = best[i]
                    nearer = (new[0] < was[0]) | ((new[0] == was[0]) & (new[1] < was[1]))
                    new = [np.where(nearer.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in zip(new, was)]
                best[i] = new
        for i, (score, key, x) in best.items():
            models = np.arange(len(score), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(models), pa.array(score), pa.array(key), _lists(x)],
                                             ["iter", "model", "score", "key", "vec"])

    found = rows.mapInArrow(race, "iter int, model int, score double, key bigint, vec array<double>") \
        .groupBy("iter", "model").agg(F.min_by("vec", F.struct("score", "key")).alias("vec")).orderBy("iter", "model").collect()
    new: dict[int, list] = {}
    for r in found:
        new.setdefault(r.iter, []).append([r.vec])
    return {i: np.concatenate([centres[i], np.array(c)], axis=1) for i, c in new.items()}


def kmeans_each(rows: DataFrame, k: int, n_init: int = 10, max_iter: int = 300, seed: int = 42, tol: float = 1e-6) -> DataFrame:
    """(iter, id, label): for every iteration the best of n_init k-means by cost; a step of all models is one pass."""
    id_type = rows.schema["id"].dataType.simpleString()
    rows = cut_lineage(rows.select("iter", "id", "vec", F.xxhash64("id").alias("key")).sortWithinPartitions("iter"))
    shape = rows.groupBy("iter").agg(F.max(F.size("vec")).alias("d")).collect()
    centres = {r.iter: np.empty((n_init, 0, r.d)) for r in shape}
    for step in range(k):
        salts = {i: np.random.SeedSequence([seed, i, step]).generate_state(n_init, np.uint64) for i in centres}
        centres = _next_centres(rows.select("iter", "vec", "key"), centres, salts)
    live = {i: np.ones(n_init, bool) for i in centres}
    cost = {i: np.zeros(n_init) for i in centres}
    for _ in range(max_iter):
        now = {i: c[live[i]] for i, c in centres.items() if live[i].any()}
        if not now:
            break
        sent = rows.sparkSession.sparkContext.broadcast(now)

        def step_of(i, x):
            c = sent.value.get(i)
            if c is None:
                return None
            d = _gaps(x, c)
            hot = (d.argmin(axis=2)[..., None] == np.arange(k)).reshape(len(x), -1).astype(float)
            return np.concatenate([(hot.T @ x).ravel(), hot.sum(0), d.min(axis=2).sum(0)])

        for i, s in _sums(rows, step_of).items():
            m, d = now[i].shape[0], now[i].shape[2]
            sums, n = s[:m * k * d].reshape(m, k, d), s[m * k * d:m * k * (d + 1)].reshape(m, k, 1)
            new = np.where(n > 0, sums / np.maximum(n, 1), now[i])
            at = np.flatnonzero(live[i])
            centres[i][at], cost[i][at] = new, s[m * k * (d + 1):]
            live[i][at] = ((new - now[i]) ** 2).sum(axis=2).max(axis=1) > tol * tol
        sent.unpersist()
    best = rows.sparkSession.sparkContext.broadcast({i: c[cost[i].argmin()] for i, c in centres.items()})

    def label(batches):
        for batch in batches:
            out = np.empty(batch.num_rows, np.int32)
            for i, at, x in _parts(batch):
                out[at] = _gaps(x, best.value[i]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch["iter"], batch["id"], pa.array(out)], ["iter", "id", "label"])

    return rows.select("iter", "id", "vec").mapInArrow(label, f"iter int, id {id_type}, label int")
