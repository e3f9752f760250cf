"""Analytics over tables of experiment results: paired comparisons, gates, detectors, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import avg_rank

TIE = 1e-12


def paired(results: DataFrame, baseline: Column, candidate: Column, keys: list[str], metric: str, keep: list[str] | None = None) -> DataFrame:
    """Inner join of two arms on the keys with the signed difference and win, loss or tie."""
    a = results.where(baseline).select(*keys, F.col(metric).alias("base"))
    b = results.where(candidate).select(*keys, *(keep or []), F.col(metric).alias("cand"))
    d = F.round(F.col("cand") - F.col("base"), 6)
    return a.join(b, keys).withColumn("delta", d).withColumn("outcome", F.when(F.abs("delta") <= TIE, "tie").when(F.col("delta") > 0, "win").otherwise("loss"))


def outcome_counts() -> list[Column]:
    return [F.count("*").alias("n_pairs"), *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("win", "wins"), ("tie", "ties"), ("loss", "losses"))]]


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks, and n."""
    one = df.withColumn("_all", F.lit(1))
    ranked = one.withColumns({"_ra": avg_rank(a, ["_all"]), "_rb": avg_rank(b, ["_all"])})
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


def tail_mean(df: DataFrame, by: list[str], value: str, alpha: float, tie: str) -> DataFrame:
    """Mean of the worst ceil(alpha * n) values of a group, of one at least."""
    w = Window.partitionBy(*by)
    cut = F.greatest(F.lit(1), F.ceil(F.lit(alpha) * F.count("*").over(w)))
    ranked = df.withColumns({"_rk": F.row_number().over(w.orderBy(value, tie)), "_cut": cut})
    return ranked.where("_rk <= _cut").groupBy(*by).agg(F.avg(value).alias("cvar"))


def hodges_lehmann(deltas: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """Median of the means of all pairs i <= j of a group's few paired differences."""
    numbered = deltas.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)))
    a, b = numbered.select(*by, F.col("_i").alias("_a"), F.col(value).alias("_x")), numbered.select(*by, F.col("_i").alias("_b"), F.col(value).alias("_y"))
    return a.join(b, by).where("_a <= _b").groupBy(*by).agg(F.median((F.col("_x") + F.col("_y")) / 2).alias("shift"))


def best_by_group(df: DataFrame, by: list[str], value: str, tie: list[str], lower: bool = False) -> DataFrame:
    order = F.col(value).asc() if lower else F.col(value).desc()
    return df.withColumn("_rk", F.row_number().over(Window.partitionBy(*by).orderBy(order, *tie))).where("_rk = 1").drop("_rk")


def confusion_scores(predictions: DataFrame, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """Balanced accuracy and macro F1 over the labels that occur in `truth`."""
    g = [*by]
    right = F.sum((F.col(truth) == F.col(predicted)).cast("long"))
    actual = predictions.groupBy(*g, F.col(truth).alias("_l")).agg(F.count("*").alias("_n"), right.alias("_tp"))
    given = predictions.groupBy(*g, F.col(predicted).alias("_l")).agg(F.count("*").alias("_p"))
    j = actual.join(given, [*g, "_l"], "left").withColumn("_p", F.coalesce("_p", F.lit(0)))
    return j.groupBy(*g).agg(F.avg(F.col("_tp") / F.col("_n")).alias("balanced_accuracy"), F.avg(2 * F.col("_tp") / (F.col("_n") + F.col("_p"))).alias("macro_f1"))
