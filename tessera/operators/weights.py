"""Weights of candidates and oracles: shrinkage, penalties, floors, coalition values and portfolio sizes.

Frames have a name and a weight; there are as many rows as candidates, tens of them, whatever the data's size. Windows
without a partition therefore run over a bounded table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import avg_rank

# Factors of oracles by the tier of a dataset; tiers and oracles that aren't named keep their weight.
TIER_FACTORS = {
    "easy": {"stability": 1.25, "diversity": 0.80, "robustness": 0.90, "complexity": 0.95},
    "hard": {"robustness": 1.20, "complexity": 1.10, "diversity": 1.05, "stability": 0.95},
    "very_hard": {"robustness": 1.25, "complexity": 1.15, "diversity": 0.90, "stability": 1.05},
}


def temperature(rows: DataFrame, value: str, gamma: float = 1.0, tie: float = 0.02, least: float = 1e-4) -> DataFrame:
    """One row: the larger of the values' population deviation, the tie margin and the least, times gamma."""
    spread = F.coalesce(F.stddev_pop(value), F.lit(0.0))
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value)).agg(F.greatest(F.lit(least), F.greatest(spread, F.lit(tie), F.lit(least)) * gamma).alias("temperature"))


def james_stein(weights: DataFrame, weight: str, effective_n: float) -> DataFrame:
    """weights with `shrunk`: each weight drawn to the mean by the positive part of 1 - (k - 3) s2 / ss, with s2 bounded by
    0.25 / n inside [0, 1] and by 1 / n elsewhere. Up to two weights stay as they are, equal ones become the mean."""
    mean, k = F.avg(weight).over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    ss = k * F.var_pop(weight).over(Window.partitionBy())
    unit = (F.min(weight).over(Window.partitionBy()) >= -1e-12) & (F.max(weight).over(Window.partitionBy()) <= 1 + 1e-12)
    s2 = F.when(unit, 0.25).otherwise(1.0) / max(1.0, effective_n)
    keep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (k - 3) * s2 / F.greatest(ss, F.lit(1e-12))))
    return weights.withColumn("shrunk", F.when(k <= 2, F.col(weight)).when(ss <= 1e-12, mean).otherwise(mean + keep * (F.col(weight) - mean)))


def towards_uniform(weights: DataFrame, weight: str, prior_strength: float, folds: int) -> DataFrame:
    """weights with `shrunk`: (1 - l) w + l / k with l = prior / (prior + folds) up to 0.95, summing to 1."""
    l = min(0.95, max(0.0, prior_strength / (prior_strength + folds)))
    mixed = (1 - l) * F.col(weight) + l / F.count("*").over(Window.partitionBy())
    return weights.withColumn("shrunk", mixed).withColumn("shrunk", F.col("shrunk") / F.nullif(F.sum("shrunk").over(Window.partitionBy()), F.lit(0.0)))


def redundancy_penalty(scores: DataFrame, oracles: list[str]) -> DataFrame:
    """(oracle, max_rho, penalty): 1 - the square of the largest absolute rank correlation with another oracle's scores.

    scores: a row for each candidate and a column for each oracle. Flat scores correlate with none."""
    ranked = scores.withColumn("_all", F.lit(1)).select("_all", *[avg_rank(o, ["_all"]).alias(o) for o in oracles])
    pairs = [(a, b) for a in oracles for b in oracles if a < b]
    one = ranked.agg(*[F.coalesce(F.abs(F.corr(a, b)), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    most = lambda o: F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"`{a}|{b}`") for a, b in pairs if o in (a, b)])
    rows = F.array(*[F.struct(F.lit(o).alias("oracle"), most(o).alias("max_rho")) for o in oracles])
    return one.select(F.inline(rows)).withColumn("penalty", F.greatest(F.lit(0.0), 1 - F.col("max_rho") ** 2))


def portfolio_size(weights: DataFrame, weight: str, least: int, most: int, mass: float = 0.85) -> DataFrame:
    """One row: k_mass (first size whose share reaches `mass`), k_elbow (before the largest drop), and the rounded mean of
    the two (half to even) within [least, most] and the number of candidates. Without any weight both are null."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    down = Window.orderBy(F.col("w").desc(), "share")
    s = weights.select(w.alias("w")).withColumn("share", F.col("w") / F.nullif(F.sum("w").over(Window.partitionBy()), F.lit(0.0)))
    s = s.withColumn("rk", F.row_number().over(down)).withColumns({"upto": F.round(F.sum("share").over(Window.orderBy("rk")), 12), "drop": F.round(F.col("share") - F.lead("share").over(Window.orderBy("rk")), 12)})
    g = s.agg(F.count("*").alias("n"), F.min(F.when(F.col("upto") >= mass, F.col("rk"))).alias("k_mass"), F.coalesce(F.min_by("rk", F.when(F.col("drop").isNotNull(), F.struct(-F.col("drop"), "rk"))), F.lit(1)).alias("k_elbow"))
    target = F.bround((F.col("k_mass") + F.col("k_elbow")) * 0.5).cast("long")
    return g.select(F.col("k_mass").cast("long").alias("k_mass"), F.col("k_elbow").cast("long").alias("k_elbow"), F.least(F.least(F.lit(most), F.col("n")), F.greatest(F.lit(least), target)).cast("long").alias("size"))


def prior_floor(weights: DataFrame, weight: str, marked: Column, floor: float) -> DataFrame:
    """weights with `prior`: shares that sum to 1, of which the marked candidates hold at least `floor`; what they lack is
    taken from the others in proportion, and dealt to them in proportion (evenly where they hold nothing)."""
    n = F.count("*").over(Window.partitionBy())
    w = F.coalesce(F.col(weight), F.lit(0.0))
    total = F.sum(w).over(Window.partitionBy())
    p = weights.withColumn("_p", F.when(total <= 1e-12, 1 / n).otherwise(w / F.nullif(total, F.lit(0.0)))).withColumn("_m", marked)
    held = F.coalesce(F.sum(F.when(F.col("_m"), F.col("_p"))).over(Window.partitionBy()), F.lit(0.0))
    count = F.count_if("_m").over(Window.partitionBy())
    rest = 1 - held
    shift = F.least(F.lit(floor) - held, rest)
    raised = F.when(held <= 1e-12, shift / F.greatest(count, F.lit(1))).otherwise(F.col("_p") + shift * F.col("_p") / F.nullif(held, F.lit(0.0)))
    moved = F.when(F.col("_m"), raised).otherwise(F.col("_p") * (rest - shift) / F.greatest(rest, F.lit(1e-12)))
    apply = (count > 0) & (held < floor - 1e-12) & (rest > 1e-12)
    return p.withColumn("prior", F.when(apply, moved).otherwise(F.col("_p"))).drop("_p", "_m")


def tier_weights(weights: DataFrame, oracle: str, weight: str, tier: str) -> DataFrame:
    """weights with `adjusted`: each oracle's weight times its factor in the row's tier."""
    factor = F.lit(1.0)
    for t, named in TIER_FACTORS.items():
        for o, x in named.items():
            factor = F.when((F.col(tier) == t) & (F.col(oracle) == o), x).otherwise(factor)
    return weights.withColumn("adjusted", F.col(weight) * factor)


def coalition_values(preferences: DataFrame, oracles: list[str], reference: str) -> DataFrame:
    """(mask, value) of every coalition of oracles (bit i: oracles[i]): 1 less the mean absolute difference between its
    pooled preference, 2 / (1 + exp(-mean logit)) - 1 with logits within 20, and the reference; the empty one is worth 0.

    preferences: a row for each pair of candidates, a column for each oracle (probabilities within (0, 1)) and for the
    reference. One pass: each coalition is an aggregate."""
    if len(oracles) > 12:
        raise ValueError("over 12 oracles: coalitions are to be sampled")
    logit = lambda o: F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.ln(F.col(o) / (1 - F.col(o)))))
    own = preferences.select(*[logit(o).alias(f"_{i}") for i, o in enumerate(oracles)], F.col(reference).alias("_r"))
    columns = []
    for mask in range(1, 1 << len(oracles)):
        inside = [F.col(f"_{i}") for i in range(len(oracles)) if mask >> i & 1]
        pooled = sum(inside[1:], inside[0]) / len(inside)
        columns.append((1 - F.avg(F.abs(2 / (1 + F.exp(-pooled)) - 1 - F.col("_r")))).alias(f"v{mask}"))
    one = own.agg(*columns)
    rows = [F.struct(F.lit(0).cast("long").alias("mask"), F.lit(0.0).alias("value"))]
    rows += [F.struct(F.lit(m).cast("long").alias("mask"), F.coalesce(F.col(f"v{m}"), F.lit(0.0)).alias("value")) for m in range(1, 1 << len(oracles))]
    return one.select(F.inline(F.array(*rows)))


def power_indices(values: DataFrame, oracles: list[str]) -> DataFrame:
    """(oracle, shapley, banzhaf, shapley_weight, banzhaf_weight) from coalition values: the mean gain that an oracle brings
    to the others' coalitions, by orders or by coalitions; weights are the gains above the least one, summing to 1
    (uniform where all are alike)."""
    k = len(oracles)
    names = values.sparkSession.createDataFrame([(i, o, 1 << i) for i, o in enumerate(oracles)], "i int, oracle string, bit long")
    without = values.crossJoin(F.broadcast(names)).where(F.col("mask").bitwiseAND(F.col("bit")) == 0)  # at most 12 names
    joined = without.withColumn("whole", F.col("mask") + F.col("bit")).join(values.select(F.col("mask").alias("whole"), F.col("value").alias("after")), "whole")
    share = F.lit(0.0)
    for s in range(k):
        share = F.when(F.bit_count("mask") == s, math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k)).otherwise(share)
    gain = F.col("after") - F.col("value")
    g = joined.groupBy("oracle").agg(F.sum(share * gain).alias("shapley"), F.avg(gain).alias("banzhaf"))
    for c in ("shapley", "banzhaf"):
        least = F.least(F.lit(0.0), F.min(c).over(Window.partitionBy()))
        total = F.sum(c).over(Window.partitionBy()) - k * least
        g = g.withColumn(f"{c}_weight", F.when(F.abs(total) <= 1e-12, 1.0 / k).otherwise((F.col(c) - least) / F.nullif(total, F.lit(0.0))))
    return g


def robust_ranks(ranks: DataFrame, cap: int, sources: int) -> DataFrame:
    """(f, p, score): robust rank aggregation of (f, rank), ranks up to `cap` from each of `sources` rankings (others count
    as cap + 1): the least probability that the k best of as many uniform ranks are as good, and its -log10.

    The order statistic's Beta(k, n - k + 1) distribution at x is the binomial tail sum over j >= k."""
    seen = ranks.where(F.col("rank") <= cap).groupBy("f").agg(F.sort_array(F.collect_list(F.col("rank") / F.lit(cap + 1.0))).alias("r"))  # at most `sources`
    x = lambda i: F.coalesce(F.get("r", F.lit(i)), F.lit(1.0))
    p = F.lit(1.0)
    for k in range(1, sources + 1):
        tail = F.lit(0.0)
        for j in range(k, sources + 1):
            tail = tail + math.comb(sources, j) * F.pow(x(k - 1), F.lit(float(j))) * F.pow(1 - x(k - 1), F.lit(float(sources - j)))
        p = F.least(p, tail)
    return seen.select("f", p.alias("p")).withColumn("score", -F.log10(F.greatest(F.col("p"), F.lit(1e-12))))
