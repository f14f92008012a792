"""A perceptron with one hidden layer that stops early: mini-batches, a validation fold, patience, kept best weights.

An epoch is one pass: each task takes Adam steps over the mini-batches of its own rows, and the weights and moments of
all tasks are averaged by rows. The same pass scores the validation rows with the weights it started from. Rows are dealt
by id into parts of a fixed size and sorted, so the answer depends neither on the cluster nor on lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

CHUNK = 4_096               # numbers of the state in one row of an average


def unpack(w: np.ndarray, d: int, hidden: int, classes: int) -> list[np.ndarray]:
    """Views of the flat weights: first layer and its bias, second layer and its bias."""
    cuts = np.cumsum([d * hidden, hidden, hidden * classes])
    first, b1, second, b2 = np.split(w, cuts)
    return [first.reshape(d, hidden), b1, second.reshape(hidden, classes), b2]


def probabilities(x: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    z = np.maximum(x @ parts[0] + parts[1], 0) @ parts[2] + parts[3]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int, classes: int, penalty: float) -> np.ndarray:
    """Gradient of the mean log loss plus penalty / 2n times the squared layers."""
    first, b1, second, b2 = unpack(w, x.shape[1], hidden, classes)
    n = len(x)
    h = np.maximum(x @ first + b1, 0)
    out = probabilities(x, [first, b1, second, b2])
    out[np.arange(n), y] -= 1
    out /= n
    back = (out @ second.T) * (h > 0)
    return np.concatenate([(x.T @ back + penalty / n * first).ravel(), back.sum(axis=0),
                           (h.T @ out + penalty / n * second).ravel(), out.sum(axis=0)])


@dataclass
class Model:
    weights: np.ndarray
    width: int
    hidden: int
    classes: int
    history: list[float]        # accuracy on the validation fold at the start of each epoch

    def predict(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """Adds probability (array<double>) and prediction (double; the smaller class on ties)."""
        sent = df.sparkSession.sparkContext.broadcast(unpack(self.weights, self.width, self.hidden, self.classes))

        @F.pandas_udf(ArrayType(DoubleType()))
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(list(probabilities(np.array(v.tolist(), dtype=float), sent.value))) if len(v) else pd.Series([], dtype=object)

        out = df.withColumn("probability", score(F.col(vec)))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def fit(train: DataFrame, classes: int, hidden: int = 100, epochs: int = 500, patience: int = 10, share: float = 0.1,
        tol: float = 1e-4, batch: int = 200, step: float = 1e-3, penalty: float = 1e-4, part_rows: int = 20_000,
        seed: int = 42) -> Model:
    """Fit on (id, vec, label 0..classes-1); a share of the ids, by hash, is the validation fold.

    Training ends when patience epochs in a row did not raise the accuracy there by more than tol, and the best weights
    stay. Without validation rows all epochs run. Rows with a null vector or label take no part.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") / 2.0 ** 32
    rows = train.where("vec is not null and label is not null").select("id", "vec", F.col("label").cast("int").alias("y"), (draw < share).alias("valid"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("no rows to train on")
    parts = -(-n // part_rows)
    rows = rows.repartition(parts, "id").sortWithinPartitions("id").drop("id").persist()
    rng = np.random.default_rng(seed)
    bound = [np.sqrt(6 / (width + hidden)), np.sqrt(6 / (hidden + classes))]
    w = np.concatenate([rng.uniform(-b, b, k) for b, k in zip(
        (bound[0], bound[0], bound[1], bound[1]), (width * hidden, hidden, hidden * classes, classes))])
    state, steps, best, kept, stale, history = np.concatenate([w, np.zeros(2 * len(w))]), 0, -1.0, w, 0, []
    sc = train.sparkSession.sparkContext
    for epoch in range(epochs + 1):
        sent = sc.broadcast(state)

        def run(batches: Iterator[pd.DataFrame], epoch=epoch, done=steps, sent=sent) -> Iterator[pd.DataFrame]:
            start = unpack(sent.value[:len(w)], width, hidden, classes)
            now, m, v = (a.copy() for a in np.split(sent.value, 3))
            order, t, trained, hits, seen = np.random.default_rng([seed, epoch]), done, 0, 0, 0
            for pdf in batches:
                x, y, held = np.array(pdf["vec"].tolist(), dtype=float), pdf["y"].to_numpy(), pdf["valid"].to_numpy(dtype=bool)
                if held.any():
                    hits += int((probabilities(x[held], start).argmax(axis=1) == y[held]).sum())
                    seen += int(held.sum())
                mix = order.permutation(np.flatnonzero(~held))
                for at in range(0, len(mix), batch):
                    some = mix[at:at + batch]
                    g = gradient(now, x[some], y[some], hidden, classes, penalty)
                    t, m, v = t + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    now -= step * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m / (np.sqrt(v) + 1e-8)
                trained += len(mix)
            flat = np.concatenate([now, m, v])
            chunks = range(-(-len(flat) // CHUNK))
            yield pd.DataFrame({"chunk": list(chunks), "part": [flat[c * CHUNK:(c + 1) * CHUNK] for c in chunks],
                                "n": float(trained), "steps": t, "hits": hits, "seen": seen})

        passed = rows.mapInPandas(run, "chunk int, part array<double>, n double, steps long, hits long, seen long")
        mean = vector_to_array(Summarizer.mean(array_to_vector("part"), F.col("n")))
        got = passed.groupBy("chunk").agg(mean.alias("part"), F.sum("n").alias("n"), F.max("steps").alias("steps"),
                                          F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).orderBy("chunk").collect()
        sent.unpersist()
        if got[0].seen:
            history.append(got[0].hits / got[0].seen)
            if history[-1] > best + tol:
                best, kept, stale = history[-1], state[:len(w)], 0
            else:
                stale += 1
        else:
            kept = state[:len(w)]
        if stale >= patience or not got[0].n:
            break
        state, steps = np.concatenate([r.part for r in got]), got[0].steps
    rows.unpersist()
    return Model(kept, width, hidden, classes, history)
