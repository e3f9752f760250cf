"""Greedy feature choices over tables of pairs: FCBF, CMIM, mRMR.

Counting and products run on the executors, in blocks; the driver holds one number for each feature and pair of a pool of
at most POOL features (a bound of the method, not of the data), and walks through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import conditional_information, information, information_of, pair_counts, wide

#: Features that a greedy choice starts from.
POOL = 320


def pair_uncertainty(binned: DataFrame, bins: int) -> DataFrame:
    """(a, b, su): symmetric uncertainty of every two features' bins."""
    x, features = wide(binned, "bin")
    names = F.array(*[F.lit(f) for f in features])
    cells = pair_counts(x.select("row_id", "x"), bins).withColumn("pair", F.col("f") * len(features) + F.col("g"))
    info = information_of(cells.select(F.col("pair").alias("f"), "bin", "other", "c"), "other")
    at = lambda i: F.element_at(names, (i + 1).cast("int"))
    return info.select(at(F.floor(F.col("f") / len(features))).alias("a"), at(F.col("f") % len(features)).alias("b"), F.coalesce("su", F.lit(0.0)).alias("su"))


def _pairs(rows: list, value: str) -> dict:
    out = {}
    for r in rows:
        out[r.a, r.b] = out[r.b, r.a] = r[value] or 0.0
    return out


def fcbf(binned: DataFrame, bins: int, k: int) -> list[int]:
    """Features in order of their symmetric uncertainty with the label, without those that a better one predicts at least as
    well as they predict the label; filled up to k from the rest."""
    su = {r.f: r.su or 0.0 for r in information(binned).orderBy(F.col("su").desc_nulls_last(), F.col("f").desc()).limit(POOL).collect()}
    pairs = _pairs(pair_uncertainty(binned.where(F.col("f").isin(list(su))), bins).collect(), "su")
    ranked = sorted(su, key=lambda f: (-round(su[f], 9), -f))
    left, kept = list(ranked), []
    while left:
        best = left.pop(0)
        kept.append(best)
        left = [f for f in left if round(pairs.get((best, f), 0.0), 9) < round(su[f], 9)]
    return (kept + [f for f in ranked if f not in kept])[:k]


def mrmr(relevance: DataFrame, correlated: DataFrame, k: int, weight: float = 1.0) -> list[int]:
    """Greedy: the largest relevance (f, score), scaled to 0..1, less weight times the mean absolute correlation with those
    chosen before. Equal ones: the larger feature number."""
    rel = {r.f: r.score or 0.0 for r in relevance.orderBy(F.col("score").desc_nulls_last(), F.col("f").desc()).limit(POOL).collect()}
    red = {key: abs(v) for key, v in _pairs(correlated.where(F.col("a").isin(list(rel)) & F.col("b").isin(list(rel))).collect(), "r").items()}
    lo, hi = min(rel.values(), default=0.0), max(rel.values(), default=0.0)
    unit = {f: (v - lo) / (hi - lo) if hi > lo else 0.0 for f, v in rel.items()}
    chosen: list[int] = []
    while len(chosen) < min(k, len(unit)):
        cost = lambda f: weight * sum(red.get((f, g), 0.0) for g in chosen) / max(1, len(chosen))
        chosen.append(max((f for f in unit if f not in chosen), key=lambda f: (round(unit[f] - cost(f), 9), f)))
    return chosen


def cmim(binned: DataFrame, bins: int, k: int, least_rows: int = 60) -> list[int]:
    """Greedy: 0.85 of the least information about the label given one of the chosen, and 0.15 of the scaled information alone.
    Fewer rows than `least_rows`: by information alone. Each step counts the pool against the last chosen feature in one job."""
    mi = {r.f: r.mi for r in information(binned).orderBy(F.col("mi").desc(), F.col("f").desc()).limit(POOL).collect()}
    ranked = sorted(mi, key=lambda f: (-round(mi[f], 9), -f))
    if binned.select("row_id").distinct().count() < least_rows or not mi:
        return ranked[:k]
    lo, hi = min(mi.values()), max(mi.values())
    unit = {f: (v - lo) / (hi - lo) if hi > lo else 0.0 for f, v in mi.items()}
    pool = binned.where(F.col("f").isin(list(mi))).select("row_id", "label", "f", "bin")
    chosen, given = [ranked[0]], dict(mi)
    while len(chosen) < min(k, len(mi)):
        last = pool.where(F.col("f") == chosen[-1]).select("row_id", F.col("bin").alias("z"))
        for r in conditional_information(pool, last).collect():
            given[r.f] = min(given[r.f], r.cmi)
        chosen.append(max((f for f in mi if f not in chosen), key=lambda f: (round(0.85 * given[f] + 0.15 * unit[f], 9), f)))
    return chosen
