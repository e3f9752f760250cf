"""Sharding by sampled splitters, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that a size-weighted sample is expected to have, ranges to begin with, and rounds of subdividing.
SAMPLE, RANGES, ROUNDS = 4096, 64, 4


def _below(key: tuple[Column, Column], bounds: list[tuple], lo: int, hi: int) -> Column:
    """Number of bounds at or below the key, by a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    first, second = (F.lit(v) for v in bounds[mid])
    under = (key[0] < first) | ((key[0] == first) & (key[1] < second))
    return F.when(under | key[0].isNull(), _below(key, bounds, lo, mid)).otherwise(_below(key, bounds, mid + 1, hi))


def _splitters(rows: DataFrame, total: int, pieces: int, seed: int) -> list[tuple]:
    """Size-weighted quantiles of the key, from a sample of about SAMPLE rows drawn in proportion to size."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(SAMPLE / max(total, 1)))
    draw = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.where(F.col("k1").isNotNull() & (draw < chance)).select("k1", "k2", (F.col("size") / chance).alias("w"))
    up = Window.orderBy("k1", "k2")
    placed = sample.select("k1", "k2", F.sum("w").over(up).alias("upto"), F.sum("w").over(Window.partitionBy()).alias("all"))
    placed = placed.withColumn("piece", F.floor(F.col("upto") * pieces / F.col("all")).cast("int"))
    cuts = placed.where(F.col("piece").between(1, pieces - 1)).groupBy("piece").agg(F.min(F.struct("k1", "k2")).alias("b"))
    return [(r.b.k1, r.b.k2) for r in cuts.collect()]


def shard_by_size(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal documents into `shards` runs of ascending key whose sizes (UTF-8 bytes of the text plus 1) are near equal.

    Size-weighted samples give splitters; the exact size of each range is then counted, a range of over twice its
    share is subdivided by a sample of its own, and running sums inside the ranges place every row. A shard's size
    misses its share by less than one document. Only keys, sizes and checksums are shuffled, never texts.

    Null text: size 1, checksum 0. Null key: sorted first. Repeated keys: ordered by a hash of the text; rows alike in
    both keep separate slots. Empty table: no rows. Other columns are ignored.
    Returns key, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(key).alias("k1"), F.xxhash64(F.col(text)).alias("k2"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc")
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds = sorted(set(_splitters(rows, total, RANGES, 0)))
    for step in range(1, ROUNDS + 2):
        ranged = rows.withColumn("r", _below((F.col("k1"), F.col("k2")), bounds, 0, len(bounds)))
        found = {x.r: (x.size, x.n) for x in ranged.groupBy("r").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        over = [r for r, (size, n) in found.items() if size > 2 * total / RANGES and n > 1]
        if not over or step > ROUNDS:
            break
        finer = set(bounds)
        for r in over:
            pieces = min(RANGES, 1 + found[r][0] * RANGES // total)
            finer |= set(_splitters(ranged.where(F.col("r") == r), found[r][0], pieces, step))
        if len(finer) == len(bounds):
            break
        bounds = sorted(finer)
    ahead, size_before, rows_before = [], 0, 0
    for r in range(len(bounds) + 1):
        ahead.append((size_before, rows_before))
        size_before, rows_before = size_before + found.get(r, (0, 0))[0], rows_before + found.get(r, (0, 0))[1]
    inside = Window.partitionBy("r").orderBy(F.col("k1").asc_nulls_first(), "k2")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    at = lambda i: F.element_at(F.array(*[F.lit(x[i]).cast("long") for x in ahead]), F.col("r") + 1)
    placed = ranged.withColumns({"upto": at(0) + F.sum("size").over(running), "nth": at(1) + F.row_number().over(inside) - 1})
    middle = (2 * F.col("upto") - F.col("size")).cast("decimal(38,0)") * shards
    shard = F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * max(total, 1)))).cast("int")
    placed = cut(placed.select("k1", "size", "crc", "nth", shard.alias("shard")))
    first = {x.shard: x.nth for x in placed.groupBy("shard").agg(F.min("nth").alias("nth")).collect()}
    starts = F.element_at(F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    return placed.select(
        F.col("k1").alias(key), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - starts).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
