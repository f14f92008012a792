"""Supervised models over a vector column, scored the same way."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import Binarizer, Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cached, constant, shared_dir
from . import boosting as gradient
from . import metrics, pairs
from . import perceptron as network
from .ranking import stratified_folds

# A model spec fits (train with id, vec, features, label) and returns a function that adds
# prediction (double) and probability (array<double>) to any table with id, vec and features.
Spec = Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]]


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (classes * n_class); the class counts are one small row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    weights = counts.agg(F.collect_list(F.struct(F.col(label).alias("c"), F.col("n").cast("double").alias("n"))).alias("l")) \
        .select(F.map_from_entries(F.transform("l", lambda e: F.struct(
            e.c, F.aggregate("l", F.lit(0.0), lambda s, x: s + x.n) / F.size("l") / e.n))).alias("m"))
    return df.withColumn(out, F.element_at(constant(weights), F.col(label)))


def ready(df: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """(id, vec, features, label) without rows that lack a label."""
    return df.where(F.col(label).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec).alias("vec"),
        array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))


def sendable(model):
    """The fitted model without its training summary.

    Tasks receive a model with its summary, and that of a two-class model holds the session, which cannot be
    sent once it has tags. A copy of a logistic regression keeps the summary; one that was written has none.
    """
    plain = model.copy()
    if not getattr(plain, "hasSummary", False):
        return plain
    path = f"{shared_dir(SparkSession.active())}/model-{uuid.uuid4().hex}"
    plain.write().save(path)
    return type(model).load(path)


def _fitted(estimator) -> Spec:
    def spec(train: DataFrame, classes: int):
        model = sendable(estimator(train, classes).fit(train))
        return lambda df: model.transform(df).withColumn("probability", vector_to_array("probability"))

    return spec


def logistic(c: float = 1.0, max_iter: int = 1000) -> Spec:
    return _fitted(lambda t, k: LogisticRegression(
        maxIter=max_iter, regParam=1 / (c * max(1, t.count())), standardization=False,
        family="multinomial" if k > 2 else "binomial"))


def forest(trees: int = 100, depth: int = 20, min_leaf: int = 1, weight: str | None = None, seed: int = 42) -> Spec:
    def make(t, k):
        tool = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)
        return tool.setWeightCol(weight) if weight else tool

    return _fitted(make)


def boosting(rounds: int = 200, depth: int = 6, step: float = 0.1, bins: int = 64) -> Spec:
    """Gradient boosted trees on histograms; softmax for more than two classes."""
    return lambda train, classes: gradient.fit(train, classes, rounds, depth, step, bins).predict


def perceptron(hidden: int = 100, max_iter: int = 500, seed: int = 42) -> Spec:
    return _fitted(lambda t, k: MultilayerPerceptronClassifier(
        layers=[len(t.first().vec), hidden, k], maxIter=max_iter, tol=1e-4, seed=seed))


def stopped_perceptron(hidden: int = 100, epochs: int = 500, patience: int = 10, seed: int = 42) -> Spec:
    """The perceptron trained in mini-batches until a validation fold gains nothing more."""
    return lambda train, classes: network.fit(train, classes, hidden, epochs, patience, seed=seed).predict


def bernoulli_bayes() -> Spec:
    """Features cut at zero, then Bernoulli naive Bayes."""
    return _fitted(lambda t, k: Pipeline(stages=[
        Binarizer(threshold=0.0, inputCol="features", outputCol="_bits"),
        NaiveBayes(modelType="bernoulli", featuresCol="_bits", smoothing=1.0)]))


def kernel_svm(width: int = 256, gamma: float | None = None, c: float = 1.0, max_iter: int = 100, seed: int = 42) -> Spec:
    """RBF kernel by random Fourier features (Rahimi and Recht 2007), a linear SVM per class, Platt scaling."""
    def spec(train, classes):
        d = len(train.first().vec)
        if gamma is None:
            var = train.select(F.explode("vec").alias("x")).agg(F.var_pop("x")).first()[0]
            g = 1 / (d * var) if var else 1.0
        else:
            g = gamma
        rng = np.random.default_rng(seed)
        w, b = rng.standard_normal((d, width)) * np.sqrt(2 * g), rng.uniform(0, 2 * np.pi, width)
        sent = train.sparkSession.sparkContext.broadcast((w, b))

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            weights, shift = sent.value
            m = np.array(x.tolist(), dtype=np.float64)
            return pd.Series(list(np.sqrt(2 / width) * np.cos(m @ weights + shift)))

        lifted = lambda df: df.withColumn("_rff", array_to_vector(lift("vec")))
        rows = cached(lifted(train))
        n, fits = rows.count(), []
        for cls in range(classes if classes > 2 else 1):
            target = F.col("label") if classes == 2 else (F.col("label") == cls).cast("double")
            two = rows.withColumn("_y", target)
            svm = sendable(LinearSVC(featuresCol="_rff", labelCol="_y", rawPredictionCol="_raw", predictionCol="_hit",
                                     regParam=1 / (c * n), maxIter=max_iter).fit(two))
            margin = lambda df, m=svm: m.transform(df).withColumn(
                "_m", F.slice(vector_to_array("_raw"), 2, 1)).withColumn("_mv", array_to_vector("_m"))
            platt = sendable(LogisticRegression(featuresCol="_mv", labelCol="_y", probabilityCol="_pr", rawPredictionCol="_r2",
                                                predictionCol="_h2", maxIter=max_iter).fit(margin(two)))
            fits.append((margin, platt))
        rows.unpersist()

        def predict(df):
            out = lifted(df)
            for i, (margin, platt) in enumerate(fits):
                out = platt.transform(margin(out)).withColumn(f"_p{i}", F.element_at(vector_to_array("_pr"), 2)) \
                    .drop("_raw", "_hit", "_m", "_mv", "_pr", "_r2", "_h2")
            if classes == 2:
                prob = F.array(1 - F.col("_p0"), F.col("_p0"))
            else:
                total = sum((F.col(f"_p{i}") for i in range(1, classes)), F.col("_p0"))
                prob = F.array(*[F.col(f"_p{i}") / total for i in range(classes)])
            out = out.withColumn("probability", prob)
            best = F.array_position("probability", F.array_max("probability")) - 1
            return out.withColumn("prediction", best.cast("double")).drop("_rff", *[f"_p{i}" for i in range(len(fits))])

        return predict

    return spec


def neighbours_vote(k: int = 5, metric: str = "euclidean") -> Spec:
    """Vote of the k nearest training rows; ties go to the smaller class."""
    def spec(train, classes):
        known = train.select("id", "vec", "label")

        def predict(df):
            both = df.select("id", "vec").withColumn("ref", F.lit(False)).unionByName(
                known.select("id", "vec").withColumn("ref", F.lit(True)))
            tagged = both.withColumn("key", F.concat(F.when(F.col("ref"), "t:").otherwise("q:"), F.col("id").cast("string")))
            near = pairs.nearest(tagged, "key", "vec", k, metric, among="ref").where("id like 'q:%'")
            tally = near.join(known.select(F.concat(F.lit("t:"), F.col("id").cast("string")).alias("other"), "label"), "other") \
                .groupBy("id").agg(*[F.avg((F.col("label") == c).cast("double")).alias(f"p{c}") for c in range(classes)])
            out = tally.select(F.substr("id", F.lit(3)).alias("_k"), F.array(*[f"p{c}" for c in range(classes)]).alias("probability"))
            best = F.array_position("probability", F.array_max("probability")) - 1
            return df.join(out, F.col("id").cast("string") == F.col("_k")).drop("_k") \
                .withColumn("prediction", best.cast("double"))

        return predict

    return spec


def soft_vote(specs: Sequence[Spec]) -> Spec:
    """Mean of the probabilities of several models."""
    def spec(train, classes):
        fits = [s(train, classes) for s in specs]

        def predict(df):
            out = df
            for i, f in enumerate(fits):
                out = f(out).withColumn(f"_v{i}", F.col("probability"))
                out = out.select(*df.columns, *[f"_v{j}" for j in range(i + 1)])
            mean = F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda c: sum(
                (F.element_at(f"_v{i}", c) for i in range(1, len(fits))), F.element_at("_v0", c)) / len(fits))
            out = out.withColumn("probability", mean).drop(*[f"_v{i}" for i in range(len(fits))])
            best = F.array_position("probability", F.array_max("probability")) - 1
            return out.withColumn("prediction", best.cast("double"))

        return predict

    return spec


def default_specs() -> dict[str, Spec]:
    specs = {
        "Logistic": logistic(), "RandomForest": forest(), "SVM": kernel_svm(), "KN": neighbours_vote(),
        "Boosting": boosting(), "NN": perceptron(), "NaiveBayes": bernoulli_bayes(),
    }
    specs["Ensemble"] = soft_vote([specs["NN"], specs["Logistic"], specs["SVM"]])
    return specs


def score(predicted: DataFrame, classes: int) -> dict[str, float | None]:
    acc = metrics.accuracy(predicted, "label", "prediction").first().accuracy
    if classes > 2:
        auc = metrics.roc_auc_ovr(predicted, "label", "probability", classes).first().auc
    else:
        auc = metrics.roc_auc(predicted.withColumn("_s", F.element_at("probability", 2)), "label", "_s").first().auc
    return {"accuracy": acc, "auc": auc}


def train_and_score(name: str, spec: Spec, train: DataFrame, test: DataFrame, classes: int, folds: int = 5) -> tuple:
    """One result row: accuracy, AUC, fold mean and spread, seconds; a failure is kept as its status."""
    try:
        begun = time.monotonic()
        fitted = spec(train, classes)
        seconds = time.monotonic() - begun
        s = score(fitted(test), classes)
        cv = []
        if folds:
            marked = stratified_folds(train, "label", ["id"], folds).persist()
            for f in range(folds):
                held = spec(marked.where(F.col("fold") != f), classes)(marked.where(F.col("fold") == f))
                cv.append(metrics.accuracy(held, "label", "prediction").first().accuracy)
            marked.unpersist()
        return (name, "ok", s["accuracy"], s["auc"], float(np.mean(cv)) if cv else None,
                float(np.std(cv)) if cv else None, seconds)
    except Exception as err:  # noqa: BLE001
        return name, f"failed: {type(err).__name__}", None, None, None, None, None


RESULTS = ("model string, status string, accuracy double, auc double, cv_mean double, cv_std double, seconds double")


def model_table(train: DataFrame, test: DataFrame, specs: Mapping[str, Spec], folds: int = 5) -> DataFrame:
    """Result rows of all specs; the inputs come from ready()."""
    train, test = cached(train), cached(test)
    classes = int(train.agg(F.max("label")).first()[0]) + 1
    rows = [train_and_score(n, s, train, test, classes, folds) for n, s in specs.items()]
    train.unpersist()
    test.unpersist()
    return train.sparkSession.createDataFrame(rows, RESULTS)


# --- tables with numeric and categorical columns ------------------------------

def encoder(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], out: str = "features") -> PipelineModel:
    """Median for numeric gaps, 'missing' for categorical ones, one column per level, unknown levels ignored."""
    stages = []
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"_n_{c}" for c in numeric]))
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"_i_{c}" for c in categorical],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical],
                                    outputCols=[f"_o_{c}" for c in categorical], dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"_n_{c}" for c in numeric] + [f"_o_{c}" for c in categorical], outputCol=out))
    return Pipeline(stages=stages).fit(prepared(df, numeric, categorical))


def prepared(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    return df.withColumns({
        **{c: F.col(c).cast("double") for c in numeric},
        **{c: F.coalesce(F.col(c).cast("string"), F.lit(fixed.MISSING)) for c in categorical},
    })


def encoded_names(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[int, str, str]]:
    """(index, encoded name, raw name) of the assembled vector, from the fitted levels."""
    levels = next((s.labelsArray for s in model.stages if hasattr(s, "labelsArray")), [])
    names = [(f"num__{c}", c) for c in numeric]
    names += [(f"cat__{c}_{v}", c) for c, vs in zip(categorical, levels) for v in vs]
    return [(i, e, r) for i, (e, r) in enumerate(names)]


def dummy_columns(df: DataFrame, col: str, levels: Sequence[str]) -> list[Column]:
    """0/1 columns of all levels but the first in sorted order."""
    return [(F.col(col) == v).cast("double").alias(f"{col}_{v}") for v in sorted(levels)[1:]]
