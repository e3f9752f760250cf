"""Discriminant rules, conformal sets, decision policies, distributions and complexity measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import class_moments
from .ordered import cumulative, kth, quantile


def class_scores(train: DataFrame, test: DataFrame, rule: str) -> DataFrame:
    """(row_id, label, class, score), the smaller the better, by class moments joined on the feature.

    dbda: squared distance to the mean less trace / n (sample variances). gqda: d * distance / trace + d ln trace - d / n.
    nb: minus the Gaussian log density with the prior; variances get 1e-9 of the largest added. centroid: distance."""
    c = class_moments(train).select("f", F.col("label").alias("class"), "n", "mu", "var")
    c = c.withColumn("floor", 1e-9 * F.max("var").over(Window.partitionBy()))
    per = c.groupBy("class").agg(F.max("n").alias("nk"), F.count("*").alias("d"), F.sum(F.col("var") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0).cast("long"))).alias("trace")).withColumn("prior", F.col("nk") / F.sum("nk").over(Window.partitionBy()))
    gap = (F.col("v") - F.col("mu")) ** 2
    var = F.col("var") + F.col("floor")
    joined = test.join(F.broadcast(c), "f")  # features times classes
    sums = joined.groupBy("row_id", "label", "class").agg(F.sum(gap).alias("dist"), F.sum(0.5 * F.ln(2 * F.lit(math.pi) * var) + gap / F.nullif(2 * var, F.lit(0.0))).alias("nll"))
    j = sums.join(F.broadcast(per), "class")
    score = {
        "centroid": F.col("dist"),
        "dbda": F.col("dist") - F.coalesce("trace", F.lit(0.0)) / F.col("nk"),
        "gqda": F.col("d") * F.col("dist") / F.nullif("trace", F.lit(0.0)) + F.col("d") * F.ln("trace") - F.col("d") / F.col("nk"),
        "nb": F.col("nll") - F.ln("prior"),
    }[rule]
    return j.select("row_id", "label", "class", score.alias("score"))


def predict(scores: DataFrame) -> DataFrame:
    return scores.groupBy("row_id", "label").agg(F.min_by("class", F.struct(F.round("score", 9), "class")).alias("predicted"))


def softmax_of_negative(scores: DataFrame, scale: Column) -> DataFrame:
    w = Window.partitionBy("row_id")
    e = F.exp(-(F.col("score") - F.min("score").over(w)) / scale)
    return scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def conformal_quantile(scores: DataFrame, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score; null without scores."""
    k = F.least(F.col("all_n"), F.ceil((F.col("all_n") + 1) * F.lit(1 - alpha)))
    return cumulative(scores, [], "s", n=F.count("*")).agg(kth("s", k).alias("q"))


def conformal_p(scores: DataFrame, nulls: DataFrame) -> DataFrame:
    """(1 + nulls at or above) / (1 + nulls), from one cumulative count over both; null for a null score."""
    both = scores.select("score", F.lit(0).alias("is_null")).union(nulls.select("score", F.lit(1)))
    at = cumulative(both, [], "score", nulls=F.sum("is_null"))
    p = at.select("score", ((1 + F.col("all_nulls") - F.col("below_nulls")) / (1 + F.col("all_nulls"))).alias("p"))
    return scores.select("f", "score").join(p, "score", "left").select("f", "score", "p")


def fit_families(m: DataFrame) -> DataFrame:
    """Closed-form maximum likelihood of normal, exponential, uniform, Laplace and lognormal for each feature: parameters,
    log-likelihood and BIC; families whose support the values leave have none."""
    middle = cumulative(m, ["f"], "v", n=F.count("*")).groupBy("f").agg(quantile("v", 0.5).alias("med"))
    dev = m.join(middle, "f").groupBy("f").agg(
        F.count("v").alias("n"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.any_value("med").alias("med"), F.avg(F.abs(F.col("v") - F.col("med"))).alias("b"),
        F.avg(F.ln(F.when(F.col("v") > 0, F.col("v")))).alias("lmu"), F.stddev_pop(F.ln(F.when(F.col("v") > 0, F.col("v")))).alias("lsd"),
    )
    n, log2pi = F.col("n"), math.log(2 * math.pi)
    families = {
        "norm": ("mu", "sd", -n / 2 * (log2pi + 2 * F.ln("sd") + 1)),
        "expon": ("lo", "scale", -n * (F.ln("scale") + 1)),
        "uniform": ("lo", "width", -n * F.ln("width")),
        "laplace": ("med", "b", -n * (F.ln(2 * F.col("b")) + 1)),
        "lognorm": ("lmu", "lsd", F.when(F.col("lo") > 0, -n / 2 * (log2pi + 2 * F.ln("lsd") + 1) - n * F.col("lmu"))),
    }
    dev = dev.withColumns({"scale": F.col("mu") - F.col("lo"), "width": F.col("hi") - F.col("lo")})
    rows = [F.struct(F.lit(k).alias("family"), F.col(a).alias("a"), F.col(b).alias("b"), l.alias("loglik"), (-2 * l + 2 * F.ln(n)).alias("bic")) for k, (a, b, l) in families.items()]
    return dev.select("f", F.explode(F.array(*rows)).alias("r")).select("f", "r.*")
