"""Greedy choices against plain loops, learners on separable rows, and operators on degenerate frames."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import choice, features, fitted, greedy, learners, models

BINS = 4


@pytest.fixture(scope="module")
def binned(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(90):
        y = rnd.randrange(3)
        x = [y if rnd.random() < 0.8 else rnd.randrange(4), rnd.randrange(4), 0, rnd.randrange(4), 0, 3 - y if rnd.random() < 0.9 else rnd.randrange(4)]
        x[2], x[4] = x[0] if rnd.random() < 0.9 else rnd.randrange(4), (x[1] + y) % 4
        rows += [(i, y, f, float(v), v) for f, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "row_id long, label long, f long, v double, bin long").cache()


def columns(rows):
    x = {}
    for i, _, f, _, b in rows:
        x.setdefault(f, {})[i] = b
    return {f: [c[i] for i in sorted(c)] for f, c in x.items()}, [y for _, y in sorted({(i, y) for i, y, *_ in rows})]


def entropy(v):
    n = len(v)
    return -sum(c / n * math.log(c / n) for c in Counter(v).values())


def info(a, b):
    return max(0.0, entropy(a) + entropy(b) - entropy(list(zip(a, b, strict=True))))


def su(a, b):
    total = entropy(a) + entropy(b)
    return 2 * info(a, b) / total if total else 0.0


def test_fcbf(binned):
    rows, frame = binned
    x, y = columns(rows)
    ranked = sorted(x, key=lambda f: (-round(su(x[f], y), 9), -f))
    left, kept = list(ranked), []
    while left:
        best = left.pop(0)
        kept.append(best)
        left = [f for f in left if round(su(x[best], x[f]), 9) < round(su(x[f], y), 9)]
    assert greedy.fcbf(frame, BINS, 5) == (kept + [f for f in ranked if f not in kept])[:5] and len(kept) < len(x)


def test_cmim(binned):
    rows, frame = binned
    x, y = columns(rows)

    def given(a, z):
        n, out = len(a), 0.0
        for k in set(z):
            at = [i for i in range(n) if z[i] == k]
            if len(at) > 1:
                out += len(at) / n * info([a[i] for i in at], [y[i] for i in at])
        return out

    mi = {f: info(v, y) for f, v in x.items()}
    unit = {f: (v - min(mi.values())) / (max(mi.values()) - min(mi.values())) for f, v in mi.items()}
    chosen = [max(mi, key=lambda f: (round(mi[f], 9), f))]
    while len(chosen) < 4:
        chosen.append(max((f for f in mi if f not in chosen), key=lambda f: (round(0.85 * min([mi[f], *[given(x[f], x[g]) for g in chosen]]) + 0.15 * unit[f], 9), f)))
    assert greedy.cmim(frame, BINS, 4) == chosen
    assert greedy.cmim(frame, BINS, 4, least_rows=1000) == sorted(mi, key=lambda f: (-round(mi[f], 9), -f))[:4]


def test_mrmr_and_correlations(binned):
    rows, frame = binned
    x, y = columns(rows)

    def corr(a, b):
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        return sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))

    got = {(r.a, r.b): r.r for r in features.correlations(frame).collect()}
    assert got == pytest.approx({(a, b): corr(x[a], x[b]) for a in x for b in x if a < b})
    rel = {f: info(v, y) for f, v in x.items()}
    unit = {f: (v - min(rel.values())) / (max(rel.values()) - min(rel.values())) for f, v in rel.items()}
    chosen = []
    while len(chosen) < 4:
        chosen.append(max((f for f in rel if f not in chosen), key=lambda f: (round(unit[f] - sum(abs(corr(x[f], x[g])) for g in chosen) / max(1, len(chosen)), 9), f)))
    relevance = features.information(frame).select("f", F.col("mi").alias("score"))
    assert greedy.mrmr(relevance, features.correlations(frame), 4) == chosen


def test_correlations_of_rows_that_have_both(spark):
    rows = [(1, 0, 0, 1.0), (2, 0, 0, 2.0), (3, 0, 0, 4.0), (1, 0, 1, 2.0), (2, 0, 1, None), (3, 0, 1, 8.0), (1, 0, 2, 5.0), (2, 0, 2, 5.0), (3, 0, 2, 5.0)]
    got = {(r.a, r.b): r.r for r in features.correlations(spark.createDataFrame(rows, "row_id long, label long, f long, v double")).collect()}
    assert got[0, 1] == pytest.approx(1.0) and got[0, 2] is None and got[1, 2] is None


@pytest.fixture(scope="module")
def separable(spark):
    rnd = random.Random(1)
    centres = {c: [rnd.gauss(0, 3) for _ in range(6)] for c in (2, 10, 7)}
    rows = [(i, c, [v + rnd.gauss(0, 0.4) for v in centres[c]]) for i, c in enumerate(rnd.choices([2, 10, 7], k=150))]
    df = learners.assembled(spark.createDataFrame(rows, "id long, y long, x array<double>"), "id", "y", "x").cache()
    return df.where("row_id % 4 <> 0"), df.where("row_id % 4 = 0")


@pytest.mark.parametrize("name", ["logistic", "linear_svm", "forest", "boosted", "random_features", "projections"])
def test_learners(separable, name):
    out = getattr(learners, name)(*separable).collect()
    assert len(out) == separable[1].count() and sum(r.label == r.predicted for r in out) >= 0.85 * len(out)
    if out[0].asDict().get("p") is not None:
        assert all(abs(sum(r.p) - 1) < 1e-6 for r in out)


def test_vote(spark):
    frames = [spark.createDataFrame([(1, 0, p), (2, 0, q)], "row_id long, label long, predicted long") for p, q in ((3, 1), (3, 2), (4, 3))]
    assert {r.row_id: r.predicted for r in learners.vote(frames).collect()} == {1: 3, 2: 1}


DEGENERATE = {
    "one flat feature": [(i, i % 2, f, 5.0 if f == 1 else float(i * (f + 1) % 7)) for i in range(8) for f in range(3)],
    "all flat": [(i, i % 2, f, 1.0) for i in range(6) for f in range(3)],
    "one class": [(i, 0, f, float(i + f)) for i in range(6) for f in range(3)],
    "a class of one row": [(i, int(i == 0), f, float(i * i + f)) for i in range(6) for f in range(3)],
    "one row": [(0, 0, f, 1.0) for f in range(3)],
    "nulls": [(i, i % 2, f, None if f == 0 else float(i)) for i in range(6) for f in range(3)],
    "nothing": [],
}


@pytest.mark.parametrize("case", DEGENERATE)
def test_degenerate_frames(spark, case):
    m = spark.createDataFrame(DEGENERATE[case], "row_id long, label long, f long, v double")
    positive = F.col("label") == 0
    frames = [
        features.anova_f(m), features.chi_square(m), features.auc_binary(m, positive), features.auc_multiclass(m), features.information(features.quantile_bins(m.where("v is not null"), 4)), features.weighted_snr(m, positive), features.welch_t(m, positive),
        features.uncorrelated(m, 0.9) if DEGENERATE[case] else m, features.shrunken_centroids(m), features.relief(m.where("v is not null"), 2), *[models.class_scores(m, m, r) for r in ("centroid", "dbda", "gqda", "nb")],
        fitted.apply_scale(m, fitted.fit_scale(m)), fitted.apply_ecdf(m, fitted.fit_ecdf(m)), choice.rank_bins(m, 4),
    ]
    b = m.withColumn("batch", F.col("row_id") % 2)
    frames += [fitted.apply_batches(b, fitted.fit_batches(b, 5.0)), fitted.apply_centres(b, fitted.fit_centres(b)), fitted.apply_quantiles(b, fitted.fit_quantiles(b))]
    for f in frames:
        f.collect()
