"""Downstream use: classifiers trained on real or synthetic rows and tested on real ones."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.operators import transforms


def scores(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision and recall of class 1, from conditional sums; null where undefined."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    count = lambda c: F.sum(c.cast("int")).cast("double")
    hit = count((y == 1) & (p == 1))
    return predictions.agg(F.avg((y == p).cast("double")).alias("accuracy"), F.try_divide(hit, count(p == 1)).alias("precision"), F.try_divide(hit, count(y == 1)).alias("recall"))


def _quadratic(train: DataFrame, features: list[str], label: str):
    """Quadratic discriminant analysis: class means and covariances by aggregation, scores as column expressions."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(features)] + [F.covar_samp(features[i], features[j]).alias(f"s{i}_{j}") for i, j in pairs]
    models, total = [], train.count()
    for r in train.groupBy(label).agg(F.count("*").alias("n"), *aggs).orderBy(label).collect():
        mean = np.array([r[f"m{i}"] for i in range(len(features))])
        cov = np.zeros((len(features),) * 2)
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] or 0.0
        cov += np.eye(len(features)) * 1e-6 * max(1.0, np.trace(cov) / len(features))
        models.append((float(r[label]), mean, np.linalg.inv(cov), float(np.log(r.n / total) - 0.5 * np.linalg.slogdet(cov)[1])))

    def score(model) -> Column:
        _, mean, inv, c = model
        x = [F.col(f) - F.lit(float(m)) for f, m in zip(features, mean)]
        quad = reduce(lambda a, b: a + b, [x[i] * x[j] * F.lit(float(inv[i, j])) for i in range(len(x)) for j in range(len(x))])
        return F.lit(c) - quad / 2

    best = F.greatest(*[F.struct(score(m).alias("s"), F.lit(m[0]).alias("y")) for m in models]) if len(models) > 1 else F.struct(F.lit(0.0).alias("s"), F.lit(models[0][0]).alias("y"))
    return lambda df: df.withColumn("prediction", best.y)


def _fourier(features: list[str], size: int = 64, gamma: float = 0.5, seed: int = 1):
    """Random Fourier features of the Gaussian kernel, as a column expression."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (size, len(features)))
    b = rng.uniform(0, 2 * np.pi, size)
    cells = [F.cos(reduce(lambda p, q: p + q, [F.col(f) * F.lit(float(v)) for f, v in zip(features, row)]) + F.lit(float(o))) * F.lit(float(np.sqrt(2 / size))) for row, o in zip(w, b)]
    return array_to_vector(F.array(*cells))


def classifiers(features: list[str], classes: int = 2) -> dict:
    """name -> function of (train, label) that returns a function adding prediction."""
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")

    def fitted(make):
        def fit(train, label):
            model = make(label).fit(vector.transform(train))
            return lambda df: model.transform(vector.transform(df))

        return fit

    def svm(train, label):
        model = LinearSVC(labelCol=label, maxIter=50, regParam=1e-3).fit(train.withColumn("features", _fourier(features)))
        return lambda df: model.transform(df.withColumn("features", _fourier(features)))

    return {
        "logistic": fitted(lambda y: LogisticRegression(labelCol=y, maxIter=100)),
        "boosted": fitted(lambda y: GBTClassifier(labelCol=y, maxIter=100, stepSize=1.0, maxDepth=3, seed=1)),
        "perceptron": fitted(lambda y: MultilayerPerceptronClassifier(labelCol=y, layers=[len(features), 32, 16, classes], maxIter=100, seed=1)),
        "kernel_svm": svm,
        "naive_bayes": fitted(lambda y: NaiveBayes(labelCol=y, modelType="gaussian")),
        "quadratic": lambda train, label: _quadratic(train, features, label),
    }


def compare(real: DataFrame, synthetic: DataFrame, test: DataFrame, features: list[str], label: str, names: list[str] | None = None) -> DataFrame:
    """(model, trained_on, accuracy, precision, recall): trained on each side, always tested on real rows."""
    scale = transforms.fit_standard(real, features)
    out = None
    for name, fit in classifiers(features).items():
        if names and name not in names:
            continue
        for side, rows in (("real", real), ("synthetic", synthetic)):
            predict = fit(scale.forward(rows), label)
            one = scores(predict(scale.forward(test)), label).select(F.lit(name).alias("model"), F.lit(side).alias("trained_on"), "*")
            out = one if out is None else out.union(one)
    return out
