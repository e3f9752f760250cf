"""Column builders: ranks, normalisations, false-discovery control, bins, preferences, bounds."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def avg_rank(value: str, by: list[str]) -> Column:
    """1-based rank with ties at their average, inside the groups of `by`."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def min_max(value: str, by: list[str], flat: float) -> Column:
    """Scaled to 0..1 inside a group; `flat` where the group is constant (0.5 and 0.0 are both in use)."""
    w = Window.partitionBy(*by)
    span = F.max(value).over(w) - F.min(value).over(w)
    return F.when(span > 0, (F.col(value) - F.min(value).over(w)) / F.nullif(span, F.lit(0.0))).otherwise(F.lit(flat))


def standardised(value: str, by: list[str], sample: bool = False) -> Column:
    """(x - mean) / deviation; population deviation unless `sample`; a flat group keeps the difference."""
    w = Window.partitionBy(*by)
    sd = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd).otherwise(F.lit(1.0))


def bh_q(p: str, by: list[str], tie: str) -> Column:
    """Benjamini-Hochberg q: the running minimum, from the largest p down, of p * m / rank."""
    order = Window.partitionBy(*by).orderBy(p, tie)
    rank, m = F.row_number().over(order), F.count("*").over(Window.partitionBy(*by))
    scaled = F.col(p) * m / rank
    return F.least(F.lit(1.0), F.min(scaled).over(Window.partitionBy(*by).orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))


def scalar_preference(a: Column, b: Column, margin: float, scale: Column) -> Column:
    """Preference for a over b: 0.5 within the margin, else the logistic of the scaled difference."""
    return F.when(F.abs(a - b) <= margin, F.lit(0.5)).otherwise(logistic((a - b) / scale))


def wilson_lower(successes: Column, total: Column, z: float = 1.96) -> Column:
    p = successes / F.nullif(total, F.lit(0))
    centre, spread = p + z * z / (2 * total), z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / total)))


def hoeffding_upper(errors: Column, total: Column, delta: float) -> Column:
    return F.when(total == 0, F.lit(float("inf"))).otherwise(F.least(F.lit(1.0), errors / F.nullif(total, F.lit(0)) + F.sqrt(F.lit(-1.0) * F.ln(F.lit(delta)) / (2 * total))))


def e_value(p: Column) -> Column:
    return 1 / F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))


def hash_bucket(value: Column, buckets: int) -> Column:
    """A stable bucket from the first 15 hexadecimal digits of SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(value, 256), 1, 15), 16, 10).cast("long"), F.lit(buckets))


def hash_order(value: Column, seed: int) -> Column:
    """Orders rows by a seeded hash: a random order that any engine and any partitioning repeats."""
    return F.sha2(F.concat_ws(":", value.cast("string"), F.lit(str(seed))), 256)


def truth(value: Column) -> Column:
    """Tolerant reading of a flag."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin("1", "true", "t", "yes", "y", "on"), F.lit(True)).when(word.isin("0", "false", "f", "no", "n", "off", ""), F.lit(False))
