"""Cumulative sums and quantiles against plain loops."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import models as MO
from tessera.operators.ordered import cumulative, quantile


def test_cumulative_with_ties_skew_and_nulls(spark):
    rnd = np.random.default_rng(8)
    values = {"a": rnd.integers(0, 9, 400) * 1.0, "b": np.r_[np.zeros(300), rnd.standard_cauchy(200)], "c": np.array([3.5]), "d": np.array([])}
    rows = [(g, float(v), i % 3) for g, vs in values.items() for i, v in enumerate(vs)] + [("a", None, 5), ("d", None, 5)]
    frame = spark.createDataFrame(rows, "g string, v double, w int")
    got = cumulative(frame, ["g"], "v", ranges=7, c=F.count("*"), w=F.sum("w")).collect()
    assert len(got) == sum(len(set(vs.tolist())) for vs in values.values())
    for r in got:
        mine = [x for x in rows if x[0] == r.g and x[1] is not None]
        assert (r.c, r.below_c, r.all_c) == (sum(x[1] == r.v for x in mine), sum(x[1] < r.v for x in mine), len(mine))
        assert (r.w, r.below_w, r.all_w) == (sum(x[2] for x in mine if x[1] == r.v), sum(x[2] for x in mine if x[1] < r.v), sum(x[2] for x in mine))
    found = cumulative(frame, ["g"], "v", ranges=7, n=F.count("*")).groupBy("g").agg(*[quantile("v", s).alias(f"q{i}") for i, s in enumerate((0.0, 0.1, 0.5, 1.0))]).collect()
    assert {r.g for r in found} == {"a", "b", "c"}
    for r in found:
        assert np.allclose([r.q0, r.q1, r.q2, r.q3], np.quantile(values[r.g], [0.0, 0.1, 0.5, 1.0]), rtol=1e-12)


def test_conformal_outputs_without_scores_and_with_ties(spark):
    s = [0.2, 0.2, 0.5, 0.9, 0.9, 0.9, 0.1]
    frame = spark.createDataFrame([(x,) for x in s], "s double")
    for alpha in (0.05, 0.3, 0.5):
        k = min(len(s), math.ceil((len(s) + 1) * (1 - alpha)))
        assert MO.conformal_quantile(frame, alpha).first().q == sorted(s)[k - 1]
    assert MO.conformal_quantile(frame.where("false"), 0.1).first().q is None
    scores = spark.createDataFrame([(i, x) for i, x in enumerate([*s, None])], "f long, score double")
    nulls = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.2, 0.6)], "score double")
    got = MO.conformal_p(scores, nulls).collect()
    want = Counter((i, (1 + sum(x <= n for n in (0.1, 0.2, 0.2, 0.6))) / 5) for i, x in enumerate(s)) + Counter([(len(s), None)])
    assert Counter((r.f, r.p) for r in got) == want
