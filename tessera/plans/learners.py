"""Queries of greedy choices and learners; iterative, so without SQL. tests/test_learners.py compares with brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import features as FO
from ..operators import greedy as G
from ..operators import learners as L
from ..sources.tables import matrix, table
from .registry import query

BINS, CHOSEN = 8, 16


def _chosen(spark: SparkSession, features: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(features, 1)), "place long, f long")


@query()
def fcbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, G.fcbf(FO.quantile_bins(matrix(spark, sf_dir), BINS), BINS, CHOSEN))


@query()
def cmim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, G.cmim(FO.quantile_bins(matrix(spark, sf_dir), BINS), BINS, CHOSEN))


@query()
def mrmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    relevance = FO.information(FO.quantile_bins(m, BINS)).withColumnRenamed("mi", "score")
    return _chosen(spark, G.mrmr(relevance, FO.correlations(m), CHOSEN))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = L.assembled(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return rows.where("row_id % 5 <> 0"), rows.where("row_id % 5 = 0")


def _learner(name: str, fit: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fit(*_split(spark, sf_dir)).select("row_id", "label", "predicted")

    run.__name__ = f"learn_{name}"
    query()(run)


_learner("logistic", L.logistic)
_learner("elastic_net", lambda a, b: L.logistic(a, b, c=0.4, l1=0.5))
_learner("linear_svm", L.linear_svm)
_learner("forest", L.forest)
_learner("boosted", L.boosted)
_learner("random_features", L.random_features)
_learner("projections", L.projections)
_learner("vote", lambda a, b: L.vote([L.logistic(a, b), L.linear_svm(a, b), L.forest(a, b)]))


@query()
def pseudo_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.two_batches(L.assembled(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"))
