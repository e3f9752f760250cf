"""Count matrices (row_id, f, v) in sparse long layout: absent cells are zeros. Detection, size factors, transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares from which a matrix without negative values counts as one of counts (fixed values).
INTEGERS, ZEROS = 0.70, 0.20
#: Shares trimmed at each end of the log ratios and of the mean abundances (fixed values).
RATIO_TRIM, SUM_TRIM = 0.30, 0.05


def detect(m: DataFrame, rows: int, features: int, domain: str = "auto") -> DataFrame:
    """One row: min_value, integer_share, zero_share, is_counts, reason. rows * features cells, of which those that m lacks
    are zeros; NaN and infinite ones don't count. `rnaseq` as the domain forces it. An empty matrix is none."""
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    g = m.agg(
        F.count("*").alias("cells"), F.count_if(finite).alias("held"), F.min(F.when(finite, F.col("v"))).alias("least"),
        F.count_if(finite & (F.abs(F.col("v") - F.rint("v")) <= 1e-8 + 1e-5 * F.abs(F.rint("v")))).alias("whole"), F.count_if(finite & (F.abs("v") <= 1e-12)).alias("zero"),
    )
    absent = F.greatest(F.lit(0).cast("long"), F.lit(rows * features).cast("long") - F.col("cells"))
    n = F.nullif(F.col("held") + absent, F.lit(0).cast("long"))
    low = F.when(absent > 0, F.least(F.coalesce("least", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("least"))
    s = g.select(low.alias("min_value"), ((F.col("whole") + absent) / n).alias("integer_share"), ((F.col("zero") + absent) / n).alias("zero_share"))
    like = (F.col("integer_share") >= INTEGERS) & (F.col("zero_share") >= ZEROS)
    reason = F.when(F.col("min_value").isNull(), "no_finite_values").when(F.lit(domain == "rnaseq"), "forced_domain").when(F.col("min_value") < -1e-12, "negative_values").when(like, "count_like").otherwise("not_count_like")
    return s.withColumn("reason", reason).withColumn("is_counts", F.col("reason").isin("forced_domain", "count_like"))


def library_sizes(m: DataFrame) -> DataFrame:
    """(row_id, lib): sums of the cells, negative and unusable ones as zeros."""
    v = F.when(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") > 0) & (F.col("v") < float("inf")), F.col("v")).otherwise(0.0)
    return m.groupBy("row_id").agg(F.sum(v).alias("lib"))


def size_factors(m: DataFrame) -> DataFrame:
    """(row_id, factor): trimmed means of log ratios against the row whose library size is nearest to the median (the
    smallest row_id on a tie), times the library size, scaled to a median of 1. Rows without counts get the least, 1e-8.

    The reference row's cells are joined on the feature, quantiles are of one row's cells; nothing gathers the matrix."""
    lib = library_sizes(m)
    cells = m.where("v > 0").join(lib, "row_id").select("row_id", "f", "v", F.greatest("lib", F.lit(1.0)).alias("lib"))
    middle = lib.where("lib > 0").agg(F.median("lib").alias("md"))
    ref = lib.crossJoin(F.broadcast(middle)).agg(F.min_by("row_id", F.struct(F.abs(F.col("lib") - F.col("md")), "row_id")).alias("ref"))  # one row
    base = cells.join(F.broadcast(ref), F.col("row_id") == F.col("ref")).select("f", F.col("v").alias("rv"), F.col("lib").alias("rlib"))
    both = cells.join(base, "f").withColumns({"lo": F.log2(F.col("v") / F.col("lib")), "lr": F.log2(F.col("rv") / F.col("rlib"))})
    both = both.select("row_id", F.round(F.col("lo") - F.col("lr"), 9).alias("m"), F.round(0.5 * (F.col("lo") + F.col("lr")), 9).alias("a"), (1 / F.greatest(1 / F.col("v") + 1 / F.col("rv"), F.lit(1e-12))).alias("w"))
    ends = lambda c, t: F.percentile(c, F.array(F.lit(t), F.lit(1 - t)))
    q = both.groupBy("row_id").agg(ends("m", RATIO_TRIM).alias("qm"), ends("a", SUM_TRIM).alias("qa"))
    inside = lambda c, q: F.col(c).between(F.round(F.get(q, F.lit(0)), 9), F.round(F.get(q, F.lit(1)), 9))
    kept = both.join(q, "row_id").where(inside("m", "qm") & inside("a", "qa"))
    ratio = kept.groupBy("row_id").agg(F.greatest(F.pow(F.lit(2.0), F.sum(F.col("w") * F.col("m")) / F.nullif(F.sum("w"), F.lit(0.0))), F.lit(1e-8)).alias("ratio"))
    raw = lib.join(ratio, "row_id", "left").select("row_id", (F.col("lib") * F.coalesce("ratio", F.lit(1.0))).alias("raw"))
    scale = raw.where("raw > 0").agg(F.median("raw").alias("scale"))
    return raw.crossJoin(F.broadcast(scale)).select("row_id", F.greatest(F.coalesce(F.col("raw") / F.col("scale"), F.lit(1.0)), F.lit(1e-8)).alias("factor"))  # one row


def log_counts(m: DataFrame, factors: DataFrame) -> DataFrame:
    """(row_id, f, x): log2(1e6 * count / size factor + 1). Absent cells stay absent, since they are 0."""
    return m.where("v > 0").join(factors, "row_id").select("row_id", "f", F.log2(F.col("v") / F.col("factor") * 1e6 + 1).alias("x"))


def stabilised(m: DataFrame) -> DataFrame:
    """(row_id, f, x): log(1 + count / (library size / median library size))."""
    lib = library_sizes(m)
    middle = lib.where("lib > 0").agg(F.median("lib").alias("md"))
    scaled = lib.crossJoin(F.broadcast(middle)).select("row_id", F.when(F.col("lib") > 0, F.greatest(F.col("lib") / F.col("md"), F.lit(1e-8))).otherwise(1.0).alias("s"))  # one row
    return m.where("v > 0").join(scaled, "row_id").select("row_id", "f", F.log1p(F.col("v") / F.col("s")).alias("x"))


def dispersion_moments(m: DataFrame, factors: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(f, mean, var, alpha, lr): normalised counts' mean and variance (absent cells are zeros), the negative binomial's
    dispersion by moments (at least 1e-8), and the likelihood ratio of class means against one mean with that dispersion.

    labels: (row_id, label). With r = 1 / alpha shared, gamma terms cancel: what is left is
    2 * sum(x ln(mu_c / mu) - (x + r) ln((r + mu_c) / (r + mu)))."""
    x = m.where("v > 0").join(factors, "row_id").join(labels, "row_id").select("f", "label", (F.col("v") / F.col("factor")).alias("x"))
    size = labels.groupBy("label").agg(F.count("*").alias("nc"))
    g = x.groupBy("f", "label").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    whole = g.groupBy("f").agg((F.sum("s") / rows).alias("mean"), ((F.sum("ss") - F.sum("s") ** 2 / rows) / max(rows - 1, 1)).alias("var"))
    whole = whole.withColumn("alpha", F.greatest((F.col("var") - F.col("mean")) / F.nullif(F.col("mean") ** 2, F.lit(0.0)), F.lit(1e-8)))
    cells = whole.join(F.broadcast(size)).join(g, ["f", "label"], "left").withColumns({"s": F.coalesce("s", F.lit(0.0)), "r": 1 / F.col("alpha")})  # classes: few
    mu = F.greatest(F.col("s") / F.col("nc"), F.lit(1e-12))
    term = F.col("s") * F.ln(mu / F.col("mean")) - (F.col("s") + F.col("nc") * F.col("r")) * F.ln((F.col("r") + mu) / (F.col("r") + F.col("mean")))
    return cells.groupBy("f").agg(F.any_value("mean").alias("mean"), F.any_value("var").alias("var"), F.any_value("alpha").alias("alpha"), F.greatest(F.lit(0.0), 2 * F.sum(term)).alias("lr"))


def shape(m: DataFrame) -> tuple[int, int]:
    """Rows and features that occur."""
    r = m.agg(F.count_distinct("row_id").alias("n"), F.count_distinct("f").alias("p")).first()
    return r.n, r.p
