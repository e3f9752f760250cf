"""Splits, balancing, encoding and batch correction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import hash_order
from .ordered import shared_checkpoints


def stratified_holdout(rows: DataFrame, row_id: str, label: str, share: float, seed: int) -> DataFrame:
    """role: the first ceil(share * n) rows of each class in a seeded hash order are `test`."""
    w = Window.partitionBy(label)
    rk = F.row_number().over(w.orderBy(hash_order(F.col(row_id), seed), row_id))
    return rows.withColumn("role", F.when(rk <= F.ceil(F.count("*").over(w) * share), "test").otherwise("train"))


def folds(rows: DataFrame, row_id: str, by: list[str], k: int, seed: int) -> DataFrame:
    """fold 0..k-1, dealt in a seeded hash order inside the groups of `by` (class for stratified folds)."""
    rk = F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(F.col(row_id), seed), row_id))
    return rows.withColumn("fold", F.pmod(rk - 1, F.lit(k)).cast("long"))


def time_blocks(rows: DataFrame, at: Column) -> DataFrame:
    """block: dense number of equal time keys, from a distinct list of them."""
    keys = rows.select(at.alias("_at")).distinct().withColumn("block", F.row_number().over(Window.orderBy("_at")).cast("long") - 1)
    return rows.withColumn("_at", at).join(keys, "_at").drop("_at")


def undersample(rows: DataFrame, row_id: str, label: str, seed: int) -> DataFrame:
    """Every class cut to the smallest class's size, in a seeded hash order."""
    least = rows.groupBy(label).count().agg(F.min("count").alias("_least"))
    rk = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(F.col(row_id), seed), row_id))
    return rows.withColumn("_rk", rk).crossJoin(F.broadcast(least)).where("_rk <= _least").drop("_rk", "_least")  # one row


def oversample(rows: DataFrame, row_id: str, label: str, seed: int) -> DataFrame:
    """Every class repeated up to the largest class's size: whole copies, then the first rows in a seeded hash order."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n")).withColumn("_most", F.max("_n").over(Window.partitionBy()))
    rk = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(F.col(row_id), seed), row_id))
    numbered = rows.withColumn("_rk", rk).join(F.broadcast(sizes), label)  # a row for each class
    copies = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_rk") <= F.col("_most") % F.col("_n"), 1).otherwise(0)
    return numbered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("_rk", "_n", "_most")


def token_rows(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, word): the lower-case words of a text."""
    return rows.select(row_id, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), 0)).alias("word"))


def combat(m: DataFrame, prior: float) -> DataFrame:
    """Location and scale of each batch shrunk by n / (n + prior), scale within 0.2..5; m has `batch`."""
    g = m.groupBy("f").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    b = m.groupBy("f", "batch").agg(F.avg("v").alias("bm"), F.stddev_samp("v").alias("bs"), F.count("*").alias("n")).join(g, "f")
    w = F.col("n") / (F.col("n") + prior)
    b = b.select("f", "batch", "mu", (w * (F.col("bm") - F.col("mu"))).alias("gamma"), F.greatest(F.lit(0.2), F.least(F.lit(5.0), 1 + w * (F.col("bs") / F.nullif(F.col("sd"), F.lit(0.0)) - 1))).alias("delta"))
    return m.join(b, ["f", "batch"]).withColumn("adjusted", (F.col("v") - F.col("mu") - F.col("gamma")) / F.col("delta") + F.col("mu"))


def center_scale(m: DataFrame) -> DataFrame:
    """Each batch brought to the overall mean and deviation; a batch of one row uses the overall deviation."""
    all_, own = Window.partitionBy("f"), Window.partitionBy("f", "batch")
    sd = F.coalesce(F.stddev_samp("v").over(own), F.stddev_samp("v").over(all_))
    return m.withColumn("adjusted", (F.col("v") - F.avg("v").over(own)) / F.nullif(sd, F.lit(0.0)) * F.stddev_samp("v").over(all_) + F.avg("v").over(all_))


#: Rows of a shuffle's partition, and bytes up to which adaptive execution joins partitions.
TASK_ROWS, TASK_BYTES = 1 << 18, "4m"


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what runs inside have partitions by the number of rows, which are joined to TASK_BYTES at most, so that a
    task's sorts and aggregates don't grow with the input."""
    want = {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES}
    had = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component of edges (a, b). In each round a node and the one
    that its label names take the smallest label around it, then labels jump, until every neighbourhood agrees. Edges
    with a null are left out."""
    with small_tasks(edges.sparkSession, 2 * edges.count()):  # both directions
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    e = edges.select("a", "b").where("a is not null and b is not null")
    both = e.union(e.select("b", "a")).distinct().persist()
    shared_checkpoints(edges.sparkSession)
    keep = lambda d: d.checkpoint()
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        known = labels.hint("merge")
        near = both.join(known, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        near = near.join(known, F.col("a") == F.col("node")).select("node", "component", F.least("least", "component").alias("least"), F.greatest("most", "component").alias("most"))
        near = keep(near)
        if near.where("least <> most").isEmpty():
            both.unpersist()
            return labels
        hooked = near.select("node", "least").union(near.select("component", "least")).groupBy("node").agg(F.min("least").alias("component"))
        root = hooked.select(F.col("node").alias("at"), F.col("component").alias("root")).hint("merge")
        # an aggregate, since a checkpoint keeps what joins say of their columns, which slows planning round by round
        labels = keep(hooked.join(root, F.col("component") == F.col("at")).groupBy("node").agg(F.min("root").alias("component")))


def linked_rows(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """(row_id, component): the smallest id of all rows that are linked by equal values of any key, over any number of
    steps. Each row is linked to the first row of each of its keys; a null key links nothing."""
    edges = [rows.select(F.col(row_id).alias("a"), F.when(F.col(k).isNotNull(), F.min(row_id).over(Window.partitionBy(k))).alias("b")) for k in keys]
    own = rows.select(F.col(row_id).alias("a"), F.col(row_id).alias("b"))
    for e in edges:
        own = own.union(e)
    return components(own).withColumnRenamed("node", row_id)


def smote(rows: DataFrame, row_id: str, label: str, features: str, k: int, seed: int) -> DataFrame:
    """(label, draw, row_id, neighbour, x): synthetic rows that fill every class up to the largest class's size.

    The rows of a class are taken in a seeded hash order, again from the first when it ends. Each draw hashes to one of
    its row's k nearest others of the class (ties: the smaller id) and to a place between the two. As in the reference,
    a class to be filled needs k + 1 rows and finite values. A task holds one class."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row for each class
    most = max(sizes.values(), default=0)
    if few := sorted(c for c, n in sizes.items() if n < min(most, k + 1)):
        raise ValueError(f"classes {few} have under {k + 1} rows")
    kind = dict(rows.dtypes)

    def fill(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        ids, x = t["i"].to_pylist(), np.array(t["x"].to_pylist(), float)
        if not np.isfinite(x).all():
            raise ValueError("values must be finite")
        digest = lambda *of: hashlib.sha256(":".join(map(str, (*of, seed))).encode()).digest()
        order = sorted(range(len(ids)), key=lambda i: (digest(ids[i]), ids[i]))
        near, out = {}, []
        for draw in range(most - len(ids)):
            i = order[draw % len(ids)]
            if i not in near:
                d = sum(((x[:, f] - x[i, f]) ** 2 for f in range(x.shape[1])), np.zeros(len(ids)))
                d[i] = np.inf
                near[i] = np.argsort(d, kind="stable")[:k]
            h = digest(ids[i], draw)
            j = int(near[i][int.from_bytes(h[:8], "big") % k])
            u = (int.from_bytes(h[8:16], "big") >> 11) / 2**53
            out.append((key[0].as_py(), draw, ids[i], ids[j], (x[i] + u * (x[j] - x[i])).tolist()))
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    part = rows.select(F.col(label).alias("c"), F.col(row_id).alias("i"), F.col(features).cast("array<double>").alias("x"))
    i, c = (pa.int64() if kind[n] == "bigint" else pa.int32() if kind[n] == "int" else pa.string() for n in (row_id, label))
    schema = pa.schema([("label", c), ("draw", pa.int64()), ("row_id", i), ("neighbour", i), ("x", pa.list_(pa.float64()))])
    short = part.where(F.col("c").isin([c for c, n in sizes.items() if n < most]))
    return short.groupBy("c").applyInArrow(fill, f"label {kind[label]}, draw long, row_id {kind[row_id]}, neighbour {kind[row_id]}, x array<double>")
