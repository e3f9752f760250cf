"""Whole jobs against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from tessera import catalog
from tessera.operators import features as FO
from tessera.operators import tabular as TO


def columns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def brute_hsic(x, label):
    d2, l = (x[:, None] - x) ** 2, (label[:, None] == label).astype(float)
    k = np.exp(-d2 / np.median(d2[d2 > 0]))
    centred = lambda a: a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    return (centred(k) * centred(l)).sum() / (len(x) - 1) ** 2


def test_kernel_screening(spark, sf_dir):
    x, label = columns(spark, sf_dir)
    got = {r.f: r.hsic for r in catalog.QUERIES["kernel_screening"](spark, sf_dir).collect()}
    assert sorted(got) == list(range(64))
    for f in range(64):
        assert abs(got[f] - 1000 * brute_hsic(x[:, f], label)) < 2e-6, f


def test_kernel_sums_with_ties_gaps_and_tails():
    rnd = np.random.default_rng(3)
    label = rnd.integers(0, 3, 301)
    for x in (rnd.integers(0, 4, 301) * 1.0, rnd.standard_cauchy(301) * 1e3, np.r_[np.zeros(200), rnd.normal(size=101)], np.r_[rnd.normal(size=300), 1e9], rnd.normal(size=301) + 1e6):
        assert abs(FO._hsic(x, label) - brute_hsic(x, label)) < 1e-11
    assert FO._hsic(np.ones(9), np.zeros(9, int)) is None


def test_information_pairs(spark, sf_dir):
    x, _ = columns(spark, sf_dir)
    lo, hi = x.min(0), x.max(0)
    cell = np.minimum(15, np.floor((x - lo) / (hi - lo) * 16)).astype(int)
    got = {(r.f, r.g): r.nmi for r in catalog.QUERIES["information_pairs"](spark, sf_dir).collect()}
    assert len(got) == 64 * 63 // 2
    entropy = lambda c: -sum(n / len(x) * math.log(n / len(x)) for n in Counter(c).values())
    for f, g in got:
        hx, hy = entropy(cell[:, f].tolist()), entropy(cell[:, g].tolist())
        mi = hx + hy - entropy(list(zip(cell[:, f].tolist(), cell[:, g].tolist(), strict=True)))
        assert abs(got[f, g] - mi / min(hx, hy)) < 2e-6, (f, g)


def union_find(rows):
    """The smallest id of each row's component; rows: (id, key, key ...)."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, *keys in rows:
        for k in enumerate(keys):
            if k[1] is not None:
                up[root(("key", *k))] = root(("row", i))
    least = {}
    for i, *_ in sorted(rows):
        least.setdefault(root(("row", i)), i)
    return {i: least[root(("row", i))] for i, *_ in rows}


def test_linked_identities(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    want = union_find([(e.event_id, e.user_id, e.ts.replace(microsecond=0)) for e in events])
    got = catalog.QUERIES["linked_identities"](spark, sf_dir).collect()
    assert len(got) == len(events) and {r.event_id: r.component for r in got} == want and len(set(want.values())) > 1


def test_linked_rows_over_many_steps(spark):
    order = np.random.default_rng(5).permutation(300).tolist()
    chain = [(order[i], i // 2, (i + 1) // 2) for i in range(250)] + [(order[i], None, 1000 + i // 5) for i in range(250, 300)]
    chain += [(2**62 + i, None, None) for i in range(4)]
    got = TO.linked_rows(spark.createDataFrame(chain, "id long, x long, y long"), "id", ["x", "y"])
    assert {r.id: r.component for r in got.collect()} == union_find(chain)


def test_minority_synthesis(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, label = {r.vec_id: np.array(r.embedding, float) for r in rows}, {r.vec_id: r.label for r in rows}
    have = Counter(label.values())
    made, bases = {}, {}
    for r in catalog.QUERIES["minority_synthesis"](spark, sf_dir).collect():
        made.setdefault((r.label, r.draw), {})[r.f] = r.v
        bases[r.label, r.draw] = r.row_id, r.neighbour
    assert {c: n + sum(k[0] == c for k in made) for c, n in have.items()} == dict.fromkeys(have, max(have.values()))
    places = []
    for key, v in made.items():
        a, b = bases[key]
        others = sorted((j for j in x if label[j] == key[0] and j != a), key=lambda j: (((x[j] - x[a]) ** 2).sum(), j))
        assert label[a] == key[0] and b in others[:5] and sorted(v) == list(range(64))
        step, way = np.array([v[f] for f in range(64)]) - x[a], x[b] - x[a]
        u = float(step @ way / (way @ way))
        assert 0 <= u < 1 + 1e-5 and np.abs(step - u * way).max() < 2e-6
        places.append((u, others.index(b)))
    assert len({p for _, p in places}) == 5 and max(u for u, _ in places) - min(u for u, _ in places) > 0.5


def test_smote_needs_neighbours(spark):
    few = spark.createDataFrame([(i, int(i > 5), [float(i)]) for i in range(8)], "i long, c long, x array<double>")
    with pytest.raises(ValueError):
        TO.smote(few, "i", "c", "x", 5, 1)


def test_fold_local_encoding_shuffles_no_text(spark, sf_dir):
    plan = catalog.QUERIES["fold_local_encoding"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "text#" not in plan.split("LeftOuter")[0]


def test_components_run_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(TO, "TASK_ROWS", 10)
    seen, inner = [], TO._components
    monkeypatch.setattr(TO, "_components", lambda e: seen.append([spark.conf.get(f"spark.sql.{k}") for k in ("shuffle.partitions", "adaptive.advisoryPartitionSizeInBytes")]) or inner(e))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = TO.linked_rows(spark.createDataFrame([(i, i // 2) for i in range(30)], "id long, x long"), "id", ["x"]).collect()
    assert seen == [["12", TO.TASK_BYTES]] and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert {r.id: r.component for r in got} == {i: i // 2 * 2 for i in range(30)}
