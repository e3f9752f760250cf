"""Fit on training rows, apply to any rows: scalers, batch corrections, empirical distributions.

A fitted model is a DataFrame, to be written and read like any other. Rows of a batch or feature that the model hasn't
seen stay as they are. Rows are (row_id, f, v) or (row_id, batch, f, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cumulative

#: Bounds of a batch's scale, and of the quantile grid (fixed values).
SCALES, CLIP = (0.2, 5.0), (0.01, 0.99)


def fit_scale(train: DataFrame) -> DataFrame:
    """(f, mu, sd): population deviation, 1 where it is 0."""
    return train.groupBy("f").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))


def apply_scale(rows: DataFrame, model: DataFrame) -> DataFrame:
    return rows.join(model, "f", "left").withColumn("scaled", F.coalesce((F.col("v") - F.col("mu")) / F.col("sd"), F.col("v"))).drop("mu", "sd")


def fit_batches(train: DataFrame, prior: float, log: bool = False) -> DataFrame:
    """(batch, f, mu, gamma, delta): each batch's shift and scale against all rows, drawn to 0 and 1 by n / (n + prior); on
    log(1 + v) with `log`, for counts."""
    x = F.log1p(F.greatest("v", F.lit(0.0))) if log else F.col("v")
    t = train.withColumn("x", x)
    whole = t.groupBy("f").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    own = t.groupBy("batch", "f").agg(F.avg("x").alias("bm"), F.stddev_samp("x").alias("bs"), F.count("*").alias("n"))
    w = F.col("n") / (F.col("n") + prior)
    ratio = F.coalesce(F.col("bs") / F.nullif("sd", F.lit(0.0)), F.lit(1.0))
    delta = F.greatest(F.lit(SCALES[0]), F.least(F.lit(SCALES[1]), 1 + w * (ratio - 1)))
    return own.join(whole, "f").select("batch", "f", "mu", (w * (F.col("bm") - F.col("mu"))).alias("gamma"), delta.alias("delta"))


def apply_batches(rows: DataFrame, model: DataFrame, log: bool = False) -> DataFrame:
    """rows with `adjusted` and `known`: ((x - mu - gamma) / delta) + mu; with `log` back on the scale of v, not below 0."""
    x = F.log1p(F.greatest("v", F.lit(0.0))) if log else F.col("v")
    j = rows.withColumn("_x", x).join(model, ["batch", "f"], "left")
    moved = (F.col("_x") - F.col("mu") - F.col("gamma")) / F.col("delta") + F.col("mu")
    out = F.greatest(F.lit(0.0), F.expm1(moved)) if log else moved
    return j.withColumns({"known": F.col("mu").isNotNull(), "adjusted": F.when(F.col("mu").isNotNull(), out).otherwise(F.col("v"))}).drop("_x", "mu", "gamma", "delta")


def fit_centres(train: DataFrame) -> DataFrame:
    """(batch, f, bm, bs, mu, sd): a batch of one row, or a flat one, has the deviation of all rows."""
    whole = train.groupBy("f").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    own = train.groupBy("batch", "f").agg(F.avg("v").alias("bm"), F.stddev_samp("v").alias("bs"))
    return own.join(whole, "f").withColumn("bs", F.when(F.col("bs") > 0, F.col("bs")).otherwise(F.col("sd")))


def apply_centres(rows: DataFrame, model: DataFrame) -> DataFrame:
    j = rows.join(model, ["batch", "f"], "left")
    moved = F.coalesce((F.col("v") - F.col("bm")) / F.nullif("bs", F.lit(0.0)) * F.col("sd"), F.lit(0.0)) + F.col("mu")
    return j.withColumns({"known": F.col("mu").isNotNull(), "adjusted": F.when(F.col("mu").isNotNull(), moved).otherwise(F.col("v"))}).drop("bm", "bs", "mu", "sd")


def fit_quantiles(train: DataFrame, points: int = 21) -> DataFrame:
    """(batch, f, own, whole): the same quantiles, between the clips, of each batch and of all rows."""
    points = max(7, points)
    lo, hi = CLIP
    grid = F.array(*[F.lit(lo + (hi - lo) * i / (points - 1)) for i in range(points)])
    whole = train.groupBy("f").agg(F.percentile("v", grid).alias("whole"))
    return train.groupBy("batch", "f").agg(F.percentile("v", grid).alias("own")).join(whole, "f")


def apply_quantiles(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with `adjusted`: the value at the same place among all rows' quantiles as v has among its batch's, by linear
    interpolation; values beyond the grid stay at its ends; a flat batch is shifted by the difference of the middles."""
    j = rows.join(model, ["batch", "f"], "left")
    n = F.size("own")
    i = F.least(F.greatest(F.size(F.filter("own", lambda q: q <= F.col("v"))), F.lit(1)), n - 1)
    at = lambda c, k: F.element_at(c, k)
    low, high = at("own", i), at("own", i + 1)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((F.col("v") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))))
    mapped = at("whole", i) + part * (at("whole", i + 1) - at("whole", i))
    middle = F.floor((n + 1) / 2).cast("int")
    flat = F.col("v") + at("whole", middle) - at("own", middle)
    out = F.when(F.col("own").isNull(), F.col("v")).when(at("own", n) - at("own", F.lit(1)) <= 1e-12, flat).otherwise(mapped)
    return j.withColumn("adjusted", out).drop("own", "whole")


def fit_ecdf(train: DataFrame) -> DataFrame:
    """(f, v, below, upto, n): for each value of the training rows, how many are below and at or below it. Counts of distinct
    values are summed, not rows."""
    c = cumulative(train, ["f"], "v", c=F.count("*"))
    return c.select("f", "v", F.col("below_c").alias("below"), (F.col("below_c") + F.col("c")).alias("upto"), F.col("all_c").alias("n"))


def apply_ecdf(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with `p` = (less + less or equal) / 2n among the training rows, within [0.5 / n, 1 - 0.5 / n]; null for a null value
    or an unknown feature."""
    seen = rows.select("f", "v").where("v is not null").distinct()
    both = seen.join(model, ["f", "v"], "full")
    w = Window.partitionBy("f").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    n = F.max("n").over(Window.partitionBy("f"))
    upto = F.coalesce(F.max("upto").over(w), F.lit(0))
    p = both.select("f", "v", n.alias("n"), ((F.coalesce("below", upto) + upto) / (2 * n)).alias("p"))
    p = p.select("f", "v", F.greatest(0.5 / F.col("n"), F.least(1 - 0.5 / F.col("n"), F.col("p"))).alias("p"))
    return rows.join(p, ["f", "v"], "left")
