"""Feature statistics and filters over the long layout (row_id, label, f, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import blocks, near_blocks, near_rows, vectors, weighted_differences, with_extra
from .ordered import cumulative


def class_moments(m: DataFrame) -> DataFrame:
    """n, mean and population variance for each feature and class."""
    return m.groupBy("f", "label").agg(F.count("v").alias("n"), F.avg("v").alias("mu"), F.var_pop("v").alias("var"))


def anova_f(m: DataFrame) -> DataFrame:
    """One-way ANOVA F for each feature; null where the classes have no spread."""
    c = class_moments(m)
    g = c.groupBy("f").agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mu")) / F.nullif(F.sum("n"), F.lit(0).cast("long"))).alias("grand"), F.sum(F.col("n") * F.col("var")).alias("ssw"))
    between = c.join(g, "f").groupBy("f").agg(F.sum(c["n"] * (F.col("mu") - F.col("grand")) ** 2).alias("ssb"))
    return g.join(between, "f").select("f", ((F.col("ssb") / F.nullif(F.col("k") - 1, F.lit(0).cast("long"))) / F.nullif(F.col("ssw") / F.nullif(F.col("n") - F.col("k"), F.lit(0).cast("long")), F.lit(0.0))).alias("score"))


def chi_square(m: DataFrame) -> DataFrame:
    """Class sums of the min-max scaled feature against its total shared out by class frequency."""
    w = Window.partitionBy("f")
    span = F.max("v").over(w) - F.min("v").over(w)
    scaled = m.withColumn("u", F.coalesce((F.col("v") - F.min("v").over(w)) / F.nullif(span, F.lit(0.0)), F.lit(0.0)))
    seen = scaled.groupBy("f", "label").agg(F.sum("u").alias("seen"), F.count("*").alias("n"))
    expected = F.sum("seen").over(w) * F.col("n") / F.sum("n").over(w)
    return seen.withColumn("expected", expected).groupBy("f").agg(F.sum((F.col("seen") - F.col("expected")) ** 2 / F.nullif(F.col("expected"), F.lit(0.0))).alias("score"))


def auc_binary(m: DataFrame, positive: Column) -> DataFrame:
    """2 * (max(auc, 1 - auc) - 0.5) from average ranks; 0 for a flat feature."""
    at = cumulative(m.withColumn("pos", positive.cast("int")), ["f"], "v", c=F.count("*"), pos=F.sum("pos"))
    rk = F.col("below_c") + (F.col("c") + 1) / 2
    g = at.groupBy("f").agg(F.sum(rk * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("c").alias("n"))
    g = g.join(m.groupBy("f").agg(F.stddev_pop("v").alias("sd")), "f")
    auc = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif((F.col("p") * (F.col("n") - F.col("p"))).cast("double"), F.lit(0.0))
    return g.select("f", F.when(F.col("sd") < 1e-12, 0.0).otherwise(2 * (F.greatest(auc, 1 - auc) - 0.5)).alias("score"))


def auc_multiclass(m: DataFrame) -> DataFrame:
    """Hand-Till: the mean over class pairs of max(auc, 1 - auc) on the pair's rows alone, without a join of rows.

    A pair's rank sum needs, for each value, the rows of each class below it; per-class cumulative counts give these."""
    labels = m.select("label").distinct()
    pairs = labels.select(F.col("label").alias("a")).join(labels.select(F.col("label").alias("b")), F.col("a") < F.col("b"))
    counts = m.groupBy("f", "v", "label").agg(F.count("*").alias("c"))
    both = counts.join(F.broadcast(pairs), (F.col("label") == F.col("a")) | (F.col("label") == F.col("b")))  # pairs of classes: few
    at = both.groupBy("f", "a", "b", "v").agg(F.sum(F.when(F.col("label") == F.col("a"), F.col("c")).otherwise(0)).alias("ca"), F.sum(F.when(F.col("label") == F.col("b"), F.col("c")).otherwise(0)).alias("cb"))
    below = Window.partitionBy("f", "a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("cb") * (F.coalesce(F.sum("ca").over(below), F.lit(0)) + F.col("ca") / 2)
    auc = at.withColumn("wins", wins).groupBy("f", "a", "b").agg((F.sum("wins") / (F.sum("ca") * F.sum("cb"))).alias("auc"))
    return auc.groupBy("f").agg(F.avg(F.greatest("auc", 1 - F.col("auc"))).alias("score"))


def quantile_bins(m: DataFrame, bins: int) -> DataFrame:
    """m with `bin`: how many distinct inner quantiles (linear) are at or below the value."""
    shares = [i / bins for i in range(1, bins)]
    edges = m.groupBy("f").agg(F.array_distinct(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).alias("edges"))
    return m.join(F.broadcast(edges), "f").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("v"))).cast("long")).drop("edges")


def information(binned: DataFrame, target: str = "label") -> DataFrame:
    """Plug-in mutual information, entropies (nats) and symmetric uncertainty of each feature's bins and the target."""
    return information_of(binned.groupBy("f", "bin", target).agg(F.count("*").alias("c")), target)


def information_of(joint: DataFrame, target: str = "label") -> DataFrame:
    """The same of counted cells (f, bin, target, c)."""
    f, fx, fy = Window.partitionBy("f"), Window.partitionBy("f", "bin"), Window.partitionBy("f", target)
    j = joint.withColumns({"n": F.sum("c").over(f), "cx": F.sum("c").over(fx), "cy": F.sum("c").over(fy)})
    p, ent = F.col("c") / F.col("n"), lambda c: -F.sum(F.col("c") / F.col("n") * F.ln(F.col(c) / F.col("n")))
    g = j.groupBy("f").agg(F.sum(p * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"), ent("cx").alias("hx"), ent("cy").alias("hy"))
    return g.withColumns({"mi": F.greatest("mi", F.lit(0.0))}).withColumn("su", 2 * F.col("mi") / F.nullif(F.col("hx") + F.col("hy"), F.lit(0.0)))


def conditional_information(binned: DataFrame, given: DataFrame) -> DataFrame:
    """I(feature; label | z) with z (row_id, z); strata of one row are left out."""
    j = binned.join(given, "row_id").groupBy("f", "z", "bin", "label").agg(F.count("*").alias("c"))
    w = lambda *k: F.sum("c").over(Window.partitionBy("f", "z", *k))
    j = j.withColumns({"nz": w(), "cx": w("bin"), "cy": w("label"), "n": F.sum("c").over(Window.partitionBy("f"))}).where("nz > 1")
    return j.groupBy("f").agg(F.greatest(F.lit(0.0), F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("nz") / (F.col("cx") * F.col("cy"))))).alias("cmi"))


def weighted_snr(m: DataFrame, positive: Column) -> DataFrame:
    """abs(mean difference) over the class-weighted deviation, which is at least 1e-3 of its median over features."""
    c = m.withColumn("y", positive.cast("int")).groupBy("f").agg(
        *[F.avg(F.when(F.col("y") == k, F.col("v"))).alias(f"m{k}") for k in (0, 1)], *[F.var_pop(F.when(F.col("y") == k, F.col("v"))).alias(f"s{k}") for k in (0, 1)], F.avg("y").alias("w")
    )
    c = c.withColumn("sd", F.sqrt((1 - F.col("w")) * F.col("s0") + F.col("w") * F.col("s1")))
    floor = c.agg((F.median("sd") * 1e-3).alias("floor"))
    return c.crossJoin(F.broadcast(floor)).select("f", (F.abs(F.col("m1") - F.col("m0")) / F.greatest(F.col("sd"), F.col("floor"), F.lit(1e-12))).alias("score"))  # one row


def welch_t(m: DataFrame, positive: Column) -> DataFrame:
    c = m.withColumn("y", positive).groupBy("f").agg(*[g.alias(n) for k, t in ((0, ~F.col("y")), (1, F.col("y"))) for g, n in ((F.avg(F.when(t, F.col("v"))), f"m{k}"), (F.var_samp(F.when(t, F.col("v"))), f"s{k}"), (F.count(F.when(t, F.col("v"))), f"n{k}"))])
    return c.select("f", ((F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(F.col("s1") / F.col("n1") + F.col("s0") / F.col("n0")), F.lit(0.0))).alias("score"))


def variance_filter(m: DataFrame, threshold: float) -> DataFrame:
    """Features whose population variance exceeds the threshold; all of them if none does."""
    v = m.groupBy("f").agg(F.var_pop("v").alias("var"))
    return v.withColumn("any", F.max(F.col("var") > threshold).over(Window.partitionBy())).where(~F.col("any") | (F.col("var") > threshold)).select("f", "var")


#: Features of a block of products.
BLOCK = 256


def wide(m: DataFrame, value: str = "v") -> tuple[DataFrame, list[int]]:
    """(row_id, label, x): x an array in the order of the features, null where a row lacks one; and the features."""
    features = [r.f for r in m.select("f").distinct().orderBy("f").collect()]
    place = {f: i for i, f in enumerate(features)}
    spot = F.create_map(*[F.lit(v) for pair in place.items() for v in pair])[F.col("f")]
    rows = m.groupBy("row_id", "label").agg(F.map_from_entries(F.collect_list(F.struct(spot.alias("i"), F.col(value).alias("v")))).alias("c"))  # one row's cells
    return rows.select("row_id", "label", F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.col("c")[i]).alias("x")), features


def correlations(m: DataFrame) -> DataFrame:
    """(a, b, r): Pearson's r of every two features a < b on the rows that have both, by sums of products: each task adds up its
    rows' blocks, and only the sums are shuffled. Null where a side is flat."""
    means = {r.f: r.v or 0.0 for r in m.groupBy("f").agg(F.avg("v").alias("v")).collect()}  # one number for each feature
    x, features = wide(m)
    centre = np.array([means[f] for f in features])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], float) for b in batches if b.num_rows]
        if not rows:
            return
        x = np.concatenate(rows) - centre
        has = ~np.isnan(x)
        x, has = np.where(has, x, 0.0), has.astype(float)
        p = len(features)
        for lo in range(0, p, BLOCK):
            for hi in range(lo, p, BLOCK):
                i, j = slice(lo, lo + BLOCK), slice(hi, hi + BLOCK)
                parts = [has[:, i].T @ has[:, j], x[:, i].T @ has[:, j], has[:, i].T @ x[:, j], (x[:, i] ** 2).T @ has[:, j], has[:, i].T @ x[:, j] ** 2, x[:, i].T @ x[:, j]]
                a, b = np.meshgrid(np.arange(p)[i], np.arange(p)[j], indexing="ij")
                keep = a < b
                names = np.array(features)
                yield pa.record_batch([pa.array(names[a[keep]]), pa.array(names[b[keep]]), *[pa.array(s[keep]) for s in parts]], ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    sums = x.select("x").mapInArrow(products, "a long, b long, n double, sa double, sb double, saa double, sbb double, sab double")
    g = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n = F.nullif("n", F.lit(0.0))
    va, vb = F.col("saa") - F.col("sa") ** 2 / n, F.col("sbb") - F.col("sb") ** 2 / n
    spread = F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.nullif(spread, F.lit(0.0))
    return g.select("a", "b", F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))  # greatest() skips null


def uncorrelated(m: DataFrame, threshold: float) -> DataFrame:
    """Features that no earlier feature, dropped or not, correlates with beyond the threshold."""
    worst = correlations(m).where(F.abs("r") > threshold).select(F.col("b").alias("f")).distinct()
    return m.select("f").distinct().join(worst, "f", "left_anti")


def pair_gaps(m: DataFrame, positive: Column) -> DataFrame:
    """For pairs of features the gap between the classes in how often the first exceeds the second."""
    y = m.withColumn("y", positive)
    a, b = y.select("row_id", "y", F.col("f").alias("a"), F.col("v").alias("va")), y.select("row_id", F.col("f").alias("b"), F.col("v").alias("vb"))
    up = (F.col("va") > F.col("vb")).cast("double")
    g = a.join(b, "row_id").where("a < b").groupBy("a", "b").agg(F.avg(F.when(F.col("y"), up)).alias("p1"), F.avg(F.when(~F.col("y"), up)).alias("p0"))
    return g.select("a", "b", F.abs(F.col("p1") - F.col("p0")).alias("gap"))


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best; equal scores by the larger feature number."""
    return scores.orderBy(F.col(score).desc_nulls_last(), F.col("f").desc()).limit(k)


def relief(m: DataFrame, k: int, x: DataFrame | None = None) -> DataFrame:
    """ReliefF: mean scaled difference to the k nearest rows of each other class, weighted by prior, less that to the
    k nearest of the own class. x: the `vectors` of m, if at hand.

    Blocks are compared twice: for the furthest of the k nearest, then for the differences up to it, which are added up
    where they are found."""
    features = [r.f for r in m.select("f").distinct().orderBy("f").collect()]
    shares = m.select("row_id", "label").distinct().where("label is not null").groupBy(F.col("label").cast("long").alias("label"))
    count = {r.label: r.n for r in shares.agg(F.count("*").alias("n")).collect()}  # a row for each class
    classes, n = sorted(count), m.select("row_id", "label").distinct().count()
    p = np.array([count[c] / n for c in classes])
    weight = np.array([[-1.0 if a == b else p[b] / (1 - p[a]) for b in range(len(p))] for a in range(len(p))]).reshape(len(p), len(p)) / k
    rows = blocks(vectors(m) if x is None else x, kept=k * max(1, len(classes)))
    near = with_extra(rows, near_blocks(rows, rows, k, last=True))
    sums = weighted_differences(near, rows, classes, weight)
    some = near_rows(near.where("extra is not null").select("b", F.col("extra").alias("near"))).agg(F.count_distinct("i").alias("n"))
    at = F.get(F.array(*[F.lit(f) for f in features]).cast(f"array<{dict(m.dtypes)['f']}>"), F.col("at").cast("int"))
    span = m.groupBy("f").agg((F.max("v") - F.min("v")).alias("span"))
    d = sums.crossJoin(F.broadcast(some)).select(at.alias("f"), "s", "n")  # one row
    return d.join(span, "f").select("f", (F.col("s") / F.col("n") / F.nullif(F.col("span"), F.lit(0.0))).alias("score"))


def shrunken_centroids(m: DataFrame) -> DataFrame:
    """d = (class mean - mean) / (m_k (s + s0)): s the pooled deviation, s0 its median, m_k = sqrt(1/n_k - 1/n)."""
    c = class_moments(m)
    w = Window.partitionBy("f")
    c = c.withColumns({"total": F.sum("n").over(w), "classes": F.count("*").over(w), "grand": F.sum(F.col("n") * F.col("mu")).over(w) / F.nullif(F.sum("n").over(w), F.lit(0).cast("long"))})
    c = c.withColumn("s", F.sqrt(F.sum(F.col("n") * F.col("var")).over(w) / F.nullif(F.col("total") - F.col("classes"), F.lit(0).cast("long"))))
    s0 = c.select("f", "s").distinct().agg(F.median("s").alias("s0"))
    size = F.sqrt(1 / F.nullif(F.col("n"), F.lit(0).cast("long")) - 1 / F.nullif(F.col("total"), F.lit(0).cast("long")))
    return c.crossJoin(F.broadcast(s0)).select("f", "label", ((F.col("mu") - F.col("grand")) / F.nullif(size * (F.col("s") + F.col("s0")), F.lit(0.0))).alias("d"))  # one row


def _middle(x: np.ndarray) -> float | None:
    """Median of the squared differences over 0 of every two of the ascending values, without a grid of pairs."""
    n, own = len(x), np.arange(1, len(x) + 1)
    within = lambda t: int((np.searchsorted(x, x + t, "right") - own).sum())
    ties = within(0.0)
    pairs = n * (n - 1) // 2 - ties
    if not pairs:
        return None

    def nth(k: int) -> float:
        lo, hi = 0.0, float(x[-1] - x[0]) * (1 + 1e-15)
        while lo < (mid := (lo + hi) / 2) < hi and hi - lo > 1e-15 * hi:
            lo, hi = (lo, mid) if within(mid) - ties > k else (mid, hi)
        return hi

    a = nth((pairs - 1) // 2)
    b = a if pairs % 2 else nth(pairs // 2)
    return (a * a + b * b) / 2


#: Nodes of a cell as wide as the kernel: interpolation is exact to rounding. Cells further than REACH add under 1e-17.
NODES, REACH = 16, 10


def _hsic(x: np.ndarray, label: np.ndarray) -> float | None:
    """sum(Kc * Lc) / (n - 1)^2. label: codes, -1 for none (like nothing, itself included).

    The centred sum needs sums of K over all, by row and by class only. Values are gathered in cells of the kernel's
    width, each cell's on Chebyshev nodes, so these sums cost what the occupied cells do, not the pairs of rows."""
    order = np.argsort(x, kind="stable")
    x, label, n = x[order], label[order], len(x)
    middle = _middle(x)
    if middle is None:
        return None
    s = np.sqrt(0.5 * middle)
    cell = np.floor((x - x[0]) / s)
    cells, at = np.unique(cell, return_inverse=True)
    node = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    weight = (-1.0) ** np.arange(NODES) * np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    size = np.bincount(label[label >= 0], minlength=int(label.max()) + 1) if (label >= 0).any() else np.zeros(0, np.int64)
    by_class = np.zeros((len(size) + 1, len(cells), NODES))
    for lo in range(0, n, 1 << 16):
        part = slice(lo, lo + (1 << 16))
        gap = (2 * ((x[part] - x[0]) / s - cell[part]) - 1)[:, None] - node
        hit = gap == 0
        share = weight / np.where(hit, 1.0, gap)
        share = np.where(hit.any(1)[:, None], hit, share / share.sum(1)[:, None])
        np.add.at(by_class, (label[part], at[part]), share)  # -1: the last
    whole = by_class.sum(0)
    like = np.tensordot(size.astype(float), by_class[:-1], 1)
    total = rows = same = 0.0
    for step in range(REACH + 1):
        near = np.exp(-((step + (node[:, None] - node) / 2) ** 2) / 2)  # node of the further cell, of the nearer one
        j = np.searchsorted(cells, cells + step)
        i = np.flatnonzero((j < len(cells)) & (cells[np.minimum(j, len(cells) - 1)] == cells + step))
        j = j[i]
        both = lambda u, v: float(((u[..., j, :] @ near) * v[..., i, :]).sum())  # noqa: B023, E731
        twice = 2 if step else 1
        total += twice * both(whole, whole)
        same += twice * both(by_class[:-1], by_class[:-1])
        rows += both(like, whole) + (both(whole, like) if step else 0.0)
    return (same - 2 * rows / n + total * float((size.astype(float) ** 2).sum()) / n**2) / (n - 1) ** 2


def hsic(m: DataFrame) -> DataFrame:
    """HSIC of each feature's RBF kernel, width by the median rule, with the label kernel, both centred; a task holds one
    feature's column. Rows without a value are left out of its feature; null where all values are equal."""

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        codes = t["label"].combine_chunks().dictionary_encode().indices.fill_null(-1)
        score = _hsic(t["v"].to_numpy().astype(float), codes.to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.table({"f": pa.array([key[0].as_py()], pa.int64()), "hsic": pa.array([score], pa.float64())})

    return m.where("v is not null").select("f", "label", "v").groupBy("f").applyInArrow(one, "f long, hsic double")


def pair_counts(binned: DataFrame, bins: int) -> DataFrame:
    """(f, g, bin, other, c): how many rows have this cell of every two features f < g. binned: (row_id, x), x an array
    of bins from 0, null where there is no value. Counts come of products of indicator matrices, in blocks of features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [np.stack(b.column("x").fill_null([]).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not x:
            return
        x = np.concatenate([np.nan_to_num(np.asarray(a, float), nan=-1).astype(np.int8) for a in x])
        p, block = x.shape[1], 64
        for a in range(0, p, block):
            for b in range(a, p, block):
                left, right = x[:, a : a + block], x[:, b : b + block]
                c = np.zeros((left.shape[1] * bins, right.shape[1] * bins))
                for lo in range(0, len(x), 4096):
                    hot = lambda y: (y[lo : lo + 4096, :, None] == np.arange(bins)).reshape(len(y[lo : lo + 4096]), -1).astype(np.float32)  # noqa: B023, E731
                    c += hot(left).T @ hot(right)
                i, j = np.nonzero(c)
                f, g = a + i // bins, b + j // bins
                keep = f < g
                cells = [f, g, i % bins, j % bins, c[i, j]]
                yield pa.record_batch([pa.array(y[keep].astype(np.int64)) for y in cells], ["f", "g", "bin", "other", "c"])

    parts = binned.mapInArrow(count, "f long, g long, bin long, other long, c long")
    return parts.groupBy("f", "g", "bin", "other").agg(F.sum("c").alias("c"))
