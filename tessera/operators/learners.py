"""Classifiers of Spark's ML library over (row_id, label, features): linear, random features, projections, trees, votes.

Each function fits on training rows and returns (row_id, label, predicted, p) of the test rows, p the classes' probabilities
in ascending order of the class where the model has them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assembled(wide: DataFrame, row_id: str, label: str, features: str) -> DataFrame:
    """(row_id, label, features) with a vector of the array's numbers; null ones are 0."""
    clean = F.transform(F.col(features).cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return wide.select(F.col(row_id).alias("row_id"), F.col(label).cast("long").alias("label"), array_to_vector(clean).alias("features"))


def balanced(train: DataFrame) -> DataFrame:
    """train with `weight`: n / (classes * rows of the class)."""
    per = train.groupBy("label").agg(F.count("*").alias("nc"))
    per = per.withColumn("weight", F.sum("nc").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("nc")))
    return train.join(F.broadcast(per.select("label", "weight")), "label")  # one row for each class


def _run(train: DataFrame, test: DataFrame, stage, proba: bool = True) -> DataFrame:  # noqa: ANN001
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    scale = StandardScaler(inputCol="features", outputCol="x", withMean=True)
    model = Pipeline(stages=[scale, stage]).fit(index.transform(train))
    out = model.transform(test)
    labels = F.array(*[F.lit(int(v)) for v in index.labels])
    predicted = F.element_at(labels, F.col("prediction").cast("int") + 1).cast("long")
    return out.select("row_id", "label", predicted.alias("predicted"), (vector_to_array("probability") if proba else F.lit(None).cast("array<double>")).alias("p"))


def logistic(train: DataFrame, test: DataFrame, c: float = 1.0, l1: float = 0.0, iterations: int = 100) -> DataFrame:
    """Balanced logistic regression; c is the inverse strength of the penalty over the summed loss, l1 the share of L1."""
    n = train.count()
    return _run(balanced(train), test, LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=1 / (c * max(n, 1)), elasticNetParam=l1, maxIter=iterations, standardization=False))


def linear_svm(train: DataFrame, test: DataFrame, c: float = 1.0, iterations: int = 60) -> DataFrame:
    """A linear support vector machine for each class against the rest, with an L2 penalty."""
    svm = LinearSVC(featuresCol="x", labelCol="y", regParam=1 / (c * max(train.count(), 1)), maxIter=iterations)
    return _run(train, test, OneVsRest(classifier=svm, featuresCol="x", labelCol="y", parallelism=4), proba=False)


def forest(train: DataFrame, test: DataFrame, trees: int = 60, depth: int = 8, seed: int = 7) -> DataFrame:
    return _run(balanced(train), test, RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed))


def boosted(train: DataFrame, test: DataFrame, trees: int = 8, depth: int = 3, seed: int = 7) -> DataFrame:
    """Boosted trees of Spark for each class against the rest; no library of its own stands behind the name."""
    return _run(train, test, OneVsRest(classifier=GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, seed=seed), featuresCol="x", labelCol="y", parallelism=4), proba=False)


def _linear(x: Column, matrix: np.ndarray, shift: np.ndarray | None = None) -> Column:
    """x times a matrix of at most a few thousand numbers, as an array expression."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in column]) for column in matrix.T])
    dot = lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = F.transform(rows, dot)
    return out if shift is None else F.zip_with(out, F.array(*[F.lit(float(v)) for v in shift]), lambda a, b: a + b)


def _size(train: DataFrame) -> tuple[int, int]:
    first = train.first()
    return train.count(), len(first.features) if first else 0


def _scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    model = StandardScaler(inputCol="features", outputCol="x", withMean=True).fit(train)
    return tuple(model.transform(d).select("row_id", "label", vector_to_array("x").alias("x")) for d in (train, test))


def random_features(train: DataFrame, test: DataFrame, seed: int = 7) -> DataFrame:
    """Logistic regression on sqrt(2 / D) cos(x w + b), w normal with the kernel's width 1 / p, D = min(2 ceil(sqrt p), 256,
    max(4, 2 n))."""
    n, p = _size(train)
    d = min(2 * math.ceil(math.sqrt(max(p, 1))), 256, max(4, 2 * n))
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 / max(p, 1)), (p, d)), rng.uniform(0, 2 * math.pi, d)
    a, t = _scaled(train, test)
    made = lambda df: df.select("row_id", "label", array_to_vector(F.transform(_linear(F.col("x"), w, b), lambda z: F.lit(math.sqrt(2 / d)) * F.cos(z))).alias("features"))
    return logistic(made(a), made(t))


def projections(train: DataFrame, test: DataFrame, members: int = 9, most: int = 64, seed: int = 7) -> DataFrame:
    """The mean probability of logistic regressions on `members` Gaussian projections to at most `most` dimensions."""
    n, p = _size(train)
    d = max(1, min(most, p, n - 1 if n > 1 else 1, max(2, p // 4)))
    a, t = _scaled(train, test)
    out = None
    for k in range(members):
        w = np.random.default_rng([seed, k]).normal(0, 1 / math.sqrt(d), (p, d))
        made = lambda df, w=w: df.select("row_id", "label", array_to_vector(_linear(F.col("x"), w)).alias("features"))
        one = logistic(made(a), made(t), iterations=40)
        out = one if out is None else out.unionByName(one)
    labels = [r.label for r in train.select("label").distinct().orderBy(F.col("label").cast("string")).collect()]
    mean = out.select("row_id", "label", F.posexplode("p").alias("i", "q")).groupBy("row_id", "label", "i").agg(F.avg("q").alias("q"))
    g = mean.groupBy("row_id", "label").agg(F.max_by("i", F.struct("q", -F.col("i"))).alias("i"), F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("p"))  # one row's classes
    return g.select("row_id", "label", F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("i") + 1).cast("long").alias("predicted"), "p")


def vote(members: list[DataFrame]) -> DataFrame:
    """The class that most members predict; the smaller one on a tie."""
    every = members[0].select("row_id", "label", "predicted")
    for m in members[1:]:
        every = every.unionByName(m.select("row_id", "label", "predicted"))
    n = every.groupBy("row_id", "label", "predicted").agg(F.count("*").alias("n"))
    return n.groupBy("row_id", "label").agg(F.min_by("predicted", F.struct(-F.col("n"), "predicted")).alias("predicted"))


def two_batches(rows: DataFrame, seed: int = 7) -> DataFrame:
    """(row_id, batch): pseudo-batches 0 and 1 by two means, 0 the one whose centre comes first."""
    model = KMeans(k=2, seed=seed, featuresCol="features", predictionCol="batch").fit(rows)
    swap = [tuple(c) for c in model.clusterCenters()][0] > [tuple(c) for c in model.clusterCenters()][-1]
    return model.transform(rows).select("row_id", (F.lit(1) - F.col("batch") if swap else F.col("batch")).cast("long").alias("batch"))
