"""Choosing rows, features and policies: trims, pads, pools, thresholds, gates, strata, chunks, digests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hash_order

# ---- policies of one row ----


def task_type(tags: Column, group: Column, time: Column) -> Column:
    """temporal before grouped before iid, by tags (an array of words) or by a named group or time column."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    named = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return F.when(named(time) | F.array_contains(low, "temporal"), "temporal").when(named(group) | F.array_contains(low, "grouped"), "grouped").otherwise("iid")


def inner_validation(rows: Column) -> Column:
    """Five times five folds below 500 training rows, else once eight."""
    small = rows < 500
    return F.struct(F.when(small, 5).otherwise(1).cast("long").alias("repeats"), F.when(small, 5).otherwise(8).cast("long").alias("folds"))


def regime(rows: Column, features: Column) -> Column:
    n = F.greatest(rows, F.lit(1))
    return F.when((n < 50) | (features / n > 500), "extreme").when((n < 200) & (features / n > 50), "moderate").otherwise("standard")


def data_domain(platform: Column) -> Column:
    return F.when(F.lower(F.coalesce(platform, F.lit(""))).contains("rna"), "rnaseq").otherwise("auto")


def base_name(name: Column) -> Column:
    """What stands before the first double underscore."""
    return F.substring_index(F.trim(F.coalesce(name, F.lit(""))), "__", 1)


def typed_key(value: Column) -> Column:
    """A key that keeps values of different types apart: 1, '1' and true differ."""
    return F.concat_ws(":", F.typeof(value), F.coalesce(value.cast("string"), F.lit("null")))


def time_key(value: Column) -> Column:
    """Sorts values that read as times first, by the second, and others after them as text."""
    at = F.try_to_timestamp(value)
    return F.struct(F.when(at.isNull(), 1).otherwise(0).alias("kind"), F.unix_timestamp(at).alias("at"), F.when(at.isNull(), value).alias("text"))


def difficulty(p_over_n: Column, classes: Column, entropy: Column, rows: Column) -> Column:
    return (
        F.when((p_over_n >= 220) | (classes >= 8) | (rows < 40), "very_hard").when((p_over_n >= 90) | (classes >= 5) | (entropy < 0.45), "hard")
        .when((p_over_n >= 30) | (classes >= 3) | (entropy < 0.70), "medium").otherwise("easy")
    )


def complexity(border: Column, fisher: Column, dimension: Column, signal: Column, overlap: Column, rank: Column) -> Column:
    """A score in [0, 1] from the share of border points, separability, intrinsic dimension, signal and overlap."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return unit(0.30 * unit(border) + 0.25 / (1 + F.greatest(F.lit(0.0), fisher)) + 0.20 * unit(F.greatest(F.lit(0.0), dimension) / F.greatest(F.lit(1.0), rank)) + 0.15 * unit(signal) + 0.10 * unit(overlap))


def widened(base: int, features: Column, score: Column, factor: float = 0.5) -> Column:
    """base * (1 + factor * score), rounded half to even, within [1, features]."""
    return F.greatest(F.lit(1), F.least(features, F.bround(base * (1 + max(0.0, factor) * score)).cast("long")))


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """The piecewise linear curve through (xs, ys) at x clipped to [0, 1]; x itself without points."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    if not xs:
        return x
    out = F.lit(ys[-1])
    for a, b, p, q in reversed(list(zip(xs, xs[1:], ys, ys[1:], strict=False))):
        out = F.when(x < b, p + (x - a) * ((q - p) / (b - a)) if b > a else F.lit(q)).otherwise(out)
    return F.when(x <= xs[0], F.lit(ys[0])).otherwise(out)


# ---- rows ----


def trim_worst(rows: DataFrame, group: list[str], value: str, key: str, k: int) -> DataFrame:
    """rows without the k smallest of each group by (value, key); one always stays."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumns({"_rk": F.row_number().over(w.orderBy(value, key)), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_rk") > F.least(F.lit(k), F.col("_n") - 1)).drop("_rk", "_n")


def padded(chosen: DataFrame, votes: DataFrame, size: int) -> DataFrame:
    """(f, place): the chosen features (f, rank) once each, then the most voted others (f, votes), up to `size`."""
    own = chosen.groupBy("f").agg(F.min("rank").alias("rank")).select("f", F.lit(0).alias("kind"), F.col("rank").cast("double").alias("by"))
    rest = votes.join(own, "f", "left_anti").select("f", F.lit(1), -F.col("votes"))
    ordered = own.union(rest).orderBy("kind", "by", F.col("f").desc()).limit(size)
    return ordered.select("f", F.row_number().over(Window.orderBy("kind", "by", F.col("f").desc())).cast("long").alias("place"))


def pooled(ranked: DataFrame, budgets: dict[str, int], weights: dict[str, float], cap: int) -> DataFrame:
    """(f, strategies, score): the union of each strategy's best (method, f, score, rank) within its budget; over `cap`
    features, those with the largest weighted sums of the scores, scaled to 0..1 by method, stay."""
    budget, weight = F.lit(0), F.lit(0.5)
    for m, b in budgets.items():
        budget = F.when(F.col("method") == m, b).otherwise(budget)
    for m, x in weights.items():
        weight = F.when(F.col("method") == m, x).otherwise(weight)
    w = Window.partitionBy("method")
    span = F.max("score").over(w) - F.min("score").over(w)
    scaled = ranked.withColumn("u", F.coalesce((F.col("score") - F.min("score").over(w)) / F.nullif(span, F.lit(0.0)), F.lit(0.0)))
    pool = scaled.where(F.col("rank") <= budget).select("f").distinct()
    g = scaled.join(pool, "f").groupBy("f").agg(F.count_if(F.col("rank") <= budget).alias("strategies"), F.round(F.sum(weight * F.col("u")), 9).alias("score"))
    return g.orderBy(F.col("score").desc(), F.col("f").desc()).limit(cap)


def first_of_each(rows: DataFrame, categories: dict[str, Column], order: list[str], key: str) -> DataFrame:
    """(category, key): for each category in turn the first matching row in order that none before has taken."""
    out = None
    for name, matches in categories.items():
        left = rows.where(matches)
        if out is not None:
            left = left.join(F.broadcast(out.select(key)), key, "left_anti")  # one row for each category
        one = left.orderBy(*order).limit(1).select(F.lit(name).alias("category"), key)
        out = one if out is None else out.unionByName(one)
    return out


def signed_outcomes(a: DataFrame, b: DataFrame, keys: list[str], value: str, error: str, lower: str, tie: float = 1e-12) -> DataFrame:
    """Keys, delta and outcome of two result tables: on the value where both are finite and agree on its direction, else on
    the error (smaller is better); a pair without either raises."""
    x = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in (value, error, lower)])
    y = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in (value, error, lower)])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    on_value = finite(f"{value}_a") & finite(f"{value}_b") & (F.col(f"{lower}_a") == F.col(f"{lower}_b"))
    on_error = finite(f"{error}_a") & finite(f"{error}_b")
    sign = F.when(F.col(f"{lower}_a"), -1.0).otherwise(1.0)
    delta = F.when(on_value, sign * (F.col(f"{value}_b") - F.col(f"{value}_a"))).when(on_error, F.col(f"{error}_a") - F.col(f"{error}_b")).otherwise(F.raise_error(F.lit("results can't be compared")).cast("double"))
    out = x.join(y, keys).select(*keys, F.when(on_value, "value").otherwise("error").alias("compared_on"), delta.alias("delta"))
    return out.withColumn("outcome", F.when(F.abs("delta") <= tie, "tie").when(F.col("delta") > 0, "win").otherwise("loss"))


# ---- conformal choices, thresholds ----


def lower_tail(scores: DataFrame, share: float, least: int) -> DataFrame:
    """The ceil(share * n) smallest scores (at least `least`), as nulls."""
    n = scores.count()
    return scores.orderBy("score", "f").limit(max(least, math.ceil(share * n)))


def select_at_fdp(p: DataFrame, target: float, most: int) -> DataFrame:
    """p (f, score, p) with `chosen`: Benjamini-Hochberg at the target, and of these at most `most` by score. One row for each
    candidate feature."""
    m = F.count("*").over(Window.partitionBy())
    ranked = p.withColumns({"_rk": F.row_number().over(Window.orderBy("p", F.col("score").desc(), "f")), "_m": m})
    last = F.coalesce(F.max(F.when(F.round("p", 12) <= F.round(F.col("_rk") * target / F.col("_m"), 12), F.col("_rk"))).over(Window.partitionBy()), F.lit(0))
    passed = ranked.withColumn("_in", F.col("_rk") <= last)
    place = F.row_number().over(Window.orderBy(F.col("_in").desc(), F.col("score").desc(), "f"))
    return passed.withColumn("chosen", F.col("_in") & (place <= most)).drop("_rk", "_m", "_in")


def stability_threshold(selected: Column, pool: Column, target: float = 1.0) -> Column:
    """The selection frequency that bounds the expected false selections by `target`: (1 + q * q / (target * p)) / 2, within
    [0.500001, 0.99]; 0.6 without an estimate of q."""
    q = F.greatest(F.lit(1e-12), F.least(selected, pool))
    return F.when(selected.isNull() | (selected <= 0) | (pool <= 0), 0.6).otherwise(F.greatest(F.lit(0.500001), F.least(F.lit(0.99), 0.5 * (1 + q * q / (target * F.nullif(pool, F.lit(0.0)))))))


def risk_thresholds(rows: DataFrame, group: str, confidence: str, wrong: Column, level: float, delta: float, least: int) -> DataFrame:
    """For each group the smallest confidence from which the share of wrong answers is at most `level`, with probability
    1 - delta by Hoeffding's bound on at least `least` answers; null where there is none.

    Rows are counted by distinct confidence first, so that what is summed in order is as long as there are values."""
    c = rows.groupBy(group, confidence).agg(F.count("*").alias("n"), F.sum(wrong.cast("long")).alias("e"))
    down = Window.partitionBy(group).orderBy(F.col(confidence).desc())
    run = c.withColumns({"n": F.sum("n").over(down), "e": F.sum("e").over(down)})
    bound = F.col("e") / F.col("n") + F.sqrt(F.lit(math.log(1 / delta)) / (2 * F.col("n")))
    ok = (F.col("n") >= least) & (F.round(bound, 12) <= level)
    return run.groupBy(group).agg(F.min(F.when(ok, F.col(confidence))).alias("threshold"), F.max(F.when(ok, F.col("n"))).alias("accepted"))


# ---- features ----


def strata_sample(variances: DataFrame, cap: int, seed: int, top: int = 512, strata: int = 8) -> DataFrame:
    """All features (f, var) up to `cap`; beyond, the tenth of the cap with the largest variance (`top` at most) and an equal
    seeded share of the others from each of `strata` variance classes."""
    n = variances.count()
    if n <= cap:
        return variances.select("f", F.lit("all").alias("why"))
    first = min(top, max(1, cap // 10))
    rank = variances.withColumn("rk", F.row_number().over(Window.orderBy(F.col("var").desc(), "f")))
    best = rank.where(F.col("rk") <= first).select("f", F.lit("variance").alias("why"))
    rest = rank.where(F.col("rk") > first).withColumn("s", F.ntile(strata).over(Window.orderBy("var", "f")))
    rest = rest.withColumn("q", F.row_number().over(Window.partitionBy("s").orderBy(hash_order(F.col("f"), seed), "f")))
    return best.union(rest.where(F.col("q") <= (cap - first) // strata).select("f", F.lit("stratum")))


def permuted_views(features: DataFrame, views: int, seed: int) -> DataFrame:
    """(view, f, place): seeded orders of the features, view 0 in their own."""
    v = features.select("f", F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view"))
    order = F.when(F.col("view") == 0, F.lit("")).otherwise(F.sha2(F.concat_ws(":", F.col("f").cast("string"), F.col("view").cast("string"), F.lit(str(seed))), 256))
    return v.withColumn("o", order).select("view", "f", F.row_number().over(Window.partitionBy("view").orderBy("o", "f")).cast("long").alias("place"))


def chunks(features: DataFrame, size: int) -> DataFrame:
    """(f, chunk): neighbours in chunks of at most `size`."""
    return features.select("f", F.floor((F.row_number().over(Window.orderBy("f")) - 1) / size).cast("long").alias("chunk"))


def rank_bins(m: DataFrame, bins: int) -> DataFrame:
    """m with `bin`: 0 for a flat feature, the value's rank among up to max(2, min(32, bins)) different ones, else how many
    inner quantile edges (repeats dropped) are at or below it. Null counts as 0."""
    few = max(2, min(32, bins))
    z = m.withColumn("v", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)))
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    seen = z.select("f", "v").distinct().groupBy("f").agg(F.count("*").alias("k"))
    small = z.join(seen.where(F.col("k") <= few), "f", "left_semi").groupBy("f").agg(F.sort_array(F.collect_set("v")).alias("values"))  # at most `few`
    edges = z.groupBy("f").agg(F.stddev_pop("v").alias("sd"), F.array_distinct(F.percentile("v", shares)).alias("edges"))
    model = edges.join(small, "f", "left")
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    place = F.when(F.col("sd") < 1e-12, 0).when(F.col("values").isNotNull(), F.array_position("values", F.col("v")) - 1).otherwise(F.size(F.filter(inner, lambda e: e <= F.col("v"))))
    return z.join(model, "f").select("row_id", "label", "f", "v", place.cast("long").alias("bin"))


def binary_relevance(parts: DataFrame, kw_weight: float = 0.25) -> DataFrame:
    """(f, score) from (f, mi, anova, effect, kw): information, F and effect at 0.5625, 0.4375 and 0.25 of 1 - kw, F on ranks at
    kw (up to 0.8), each scaled to 0..1 before and the sum after."""
    w = Window.partitionBy()
    kw = min(0.8, max(0.0, kw_weight))

    def unit(c: str) -> Column:
        x = F.coalesce(F.col(c), F.lit(0.0))
        return F.coalesce((x - F.min(x).over(w)) / F.nullif(F.max(x).over(w) - F.min(x).over(w), F.lit(0.0)), F.lit(0.0))

    s = parts.select("f", ((1 - kw) * (0.5625 * unit("mi") + 0.4375 * unit("anova") + 0.25 * unit("effect")) + kw * unit("kw")).alias("s"))
    return s.select("f", unit("s").alias("score"))


# ---- gates, digests ----


def outside_envelope(descriptors: DataFrame, envelope: DataFrame, most: int, score: float) -> DataFrame:
    """(name, outside, excess, fallback): how many of a row's values (name, descriptor, x) leave [lo, hi] of the envelope, by how
    many scales at most, and whether a default is due: over `most` outside and an excess over `score`."""
    j = descriptors.join(envelope, "descriptor")
    beyond = F.greatest(F.col("lo") - F.col("x"), F.col("x") - F.col("hi"), F.lit(0.0)) / F.greatest("scale", F.lit(1e-12))
    g = j.withColumn("b", beyond).groupBy("name").agg(F.count_if(F.col("b") > 0).alias("outside"), F.max("b").alias("excess"))
    return g.withColumn("fallback", (F.col("outside") > most) & (F.col("excess") > score))


def ordered_digest(rows: DataFrame, group: list[str], order: str, content: Column, block: int = 4096) -> DataFrame:
    """group..., digest: SHA-256 over the digests of blocks of `block` consecutive whole numbers of `order`, each over its rows'
    in order; what one task gathers is a block, or one digest for each block."""
    b = rows.select(*group, F.floor(F.col(order) / block).alias("b"), F.col(order).alias("o"), F.sha2(content, 256).alias("h"))
    one = b.groupBy(*group, "b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return one.groupBy(*group).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def contract_differences(reference: DataFrame, candidate: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, status: same, changed, missing (in the candidate) or added."""
    a, b = reference.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_x")), candidate.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    status = F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "added").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def signal_share(eigenvalues: DataFrame, rows: int, features: int) -> DataFrame:
    """One row: dims95 (the share of `features` that 95 % of the positive eigenvalues' sum needs) and the share of them above
    the edge of noise, median * (1 + sqrt(p / n))^2."""
    pos = eigenvalues.where("value > 0")
    w = Window.orderBy(F.col("value").desc())
    run = pos.withColumns({"upto": F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("value").over(Window.partitionBy()), 12), "rk": F.row_number().over(w), "md": F.median("value").over(Window.partitionBy())})
    edge = F.col("md") * (1 + math.sqrt(features / max(rows, 1))) ** 2
    return run.agg((F.min(F.when(F.col("upto") >= 0.95, F.col("rk"))) / features).alias("dims95"), F.avg((F.col("value") > edge).cast("double")).alias("signal"))
