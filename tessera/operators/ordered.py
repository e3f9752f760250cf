"""Ranks, cumulative counts and quantiles of any number of values, in ranges that a task can hold."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges that the distinct values of a group are split into. Results do not depend on it.
RANGES = 64


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says; only a local session may go without, and gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoints-"))


def cumulative(rows: DataFrame, by: list[str], value: str, ranges: int | None = None, **sums: Column) -> DataFrame:
    """One row for each group of `by` and distinct number `value`: each sum over its rows, the same over the rows below
    (below_ and its name) and over the whole group (all_ and its name). Rows without a value are left out.

    Equal values are summed before any order is taken, then the distinct values of a group are cut into ranges at
    approximate quantiles, so that no task sorts a whole group. The cuts are checkpointed, since both the ranges' totals and
    the sums inside the ranges need the same ones, also after a task is repeated."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()])
    shared_checkpoints(rows.sparkSession)
    pieces = ranges or RANGES
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(20 * pieces)).alias("_cuts")).checkpoint()
    near = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))  # no group: one row
    near = near.withColumn("_range", F.size(F.filter("_cuts", lambda e: e < F.col(value)))).drop("_cuts")
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = near.groupBy(*by, "_range").agg(*[F.sum(n).alias(n) for n in sums])
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_start_{n}") for n in sums], *[F.sum(n).over(whole).alias(f"all_{n}") for n in sums])  # at most `pieces` rows a group
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return near.join(starts, [*by, "_range"]).select(*by, value, *sums, *[(F.col(f"_start_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"below_{n}") for n in sums], *[f"all_{n}" for n in sums])


def kth(value: str, k: Column, count: str = "n") -> Column:
    """Aggregate over `cumulative` rows: the k-th smallest value, from 1."""
    return F.max(F.when((F.col(f"below_{count}") < k) & (k <= F.col(f"below_{count}") + F.col(count)), F.col(value)))


def quantile(value: str, share: float, count: str = "n") -> Column:
    """Aggregate over `cumulative` rows: the quantile between the two nearest values, linear."""
    place = F.lit(share) * (F.col(f"all_{count}") - 1)
    low, high = kth(value, F.floor(place) + 1, count), kth(value, F.ceil(place) + 1, count)
    return low + F.max(place - F.floor(place)) * (high - low)
