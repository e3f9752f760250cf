"""Toxicity categories by a classifier chain of linear models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_UNITS, LOWER, packed, prefix_hash, run_hash, slices, small_batches, tidy, word_bounds

#: Bound on the labelled documents that models are fitted to, features kept for each category, and folds.
SAMPLE, FEATURES, FOLDS = 12_000, 200, 5
#: Lengths in bytes of the beginnings of words that count as features, beside whole words.
HEADS = (4, 5, 6)
#: Ridge penalty, steps and step size of the fits; least and largest probability from which a document counts as positive.
RIDGE, STEPS, RATE, CUTS = 0.3, 120, 1.0, (0.1, 0.5)

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) for every word and beginning of a word, letters A-Z lowered; repeats included."""
    data, offsets = packed(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, IS_WORD)
    h = prefix_hash(BYTE_UNITS[data])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    docs, found = [doc], [run_hash(h, starts, ends)]
    for n in HEADS:
        long = ends - starts > n
        docs.append(doc[long])
        found.append(run_hash(h, starts[long], starts[long] + n) + np.uint64(n))
    return np.concatenate(docs), np.concatenate(found)


@dataclass
class Chain:
    """Models of the categories in order: `known` are the features' hashes, ascending; weights[c] has one weight for each
    of them and one for each earlier category's probability; bias[c]. cuts[c]: the probability from which a document
    counts as positive."""

    categories: tuple[str, ...]
    known: np.ndarray
    weights: list[np.ndarray]
    bias: list[float]
    cuts: list[float]

    def score(self, column: pa.Array) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        n, m = len(column), len(self.known)
        out = np.zeros((n, len(self.categories)))
        doc, idx = present(column, self.known)
        for c, w in enumerate(self.weights):
            z = np.bincount(doc, w[idx], n) + out[:, :c] @ w[m:] + self.bias[c]
            out[:, c] = sigmoid(z)
        return out


def present(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, index of a known feature), ascending."""
    if not len(known) or not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, feature = features(column)
    sieve = np.zeros(1 << 16, bool)
    sieve[known >> np.uint64(48)] = True
    hit = sieve[feature >> np.uint64(48)]
    doc, feature = doc[hit], feature[hit]
    at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
    good = known[at] == feature
    pairs = np.unique(doc[good] * len(known) + at[good])
    return pairs // len(known), pairs % len(known)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit(doc: np.ndarray, idx: np.ndarray, dense: np.ndarray, y: np.ndarray, m: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps scaled by each feature's curvature."""
    n, d = len(y), dense.shape[1]
    if not n or y.min() == y.max():
        return np.zeros(m + d), (35.0 if n and y[0] else -35.0)
    rows = np.bincount(doc, minlength=n) + d + 1
    reach = float(np.quantile(rows, 0.9))
    scale = np.concatenate([np.bincount(idx, minlength=m), (dense**2).sum(0), [n]]) * 0.25 * min(reach, 40.0) + RIDGE
    w, ahead, t = np.zeros(m + d + 1), np.zeros(m + d + 1), 1.0
    w[-1] = ahead[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(STEPS):
        r = sigmoid(np.bincount(doc, ahead[idx], n) + dense @ ahead[m : m + d] + ahead[-1]) - y
        g = np.concatenate([np.bincount(idx, r[doc], m), dense.T @ r, [r.sum()]]) + RIDGE * np.concatenate([ahead[:-1], [0.0]])
        new, t1 = ahead - RATE * g / scale, (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, ahead, t = new, new + (t - 1) / t1 * (new - w), t1
    return w[:-1], float(w[-1])


def best_cut(y: np.ndarray, p: np.ndarray) -> float:
    """The largest probability within CUTS at which the F1 of out-of-fold probabilities is best; the upper end where there
    is no positive one."""
    tried = np.unique(np.concatenate([np.clip(p, *CUTS), CUTS]))
    scores = [2 * (y * (p >= t)).sum() / max(1.0, y.sum() + (p >= t).sum()) for t in tried]
    return float(tried[len(tried) - 1 - int(np.argmax(scores[::-1]))])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id", text: str = "text") -> Chain:
    """Fit a chain on at most SAMPLE labelled documents, those whose keys hash lowest.

    categories: name to a boolean SQL expression over `labels`, in the chain's order; null is false. Features are the words and
    beginnings of words with the largest chi-square against a category, counted on the executors; the driver receives
    the counts' best FEATURES for each category and, of each sampled document, which of them it has. Each model sees
    the earlier categories' probabilities: out-of-fold ones when it is fitted, the models' own when it scores. A
    category's cut is the one with the best F1 among its out-of-fold probabilities.

    Without labelled documents, or with one class alone, a category's probability is constant. A key labelled twice
    is positive in a category where any of its rows is; a repeated document counts as often as it occurs. Null keys aren't
    sampled; null and empty texts have no features; very long texts count whole. Other columns are ignored."""
    small_batches(docs.sparkSession)
    names = tuple(categories)
    y = labels.select(F.col(key).alias("k"), *[F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
    ys = [f"y{i}" for i in range(len(names))]
    y = y.where("k is not null").groupBy("k").agg(*[F.max(c).alias(c) for c in ys]).orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(y), "k")  # SAMPLE rows at most
    kinds = ", ".join(f"{c} int" for c in ys)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                doc, feature = features(b.column("text"))
                pairs = np.unique(np.stack([doc.astype(np.uint64), feature]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
                at = pa.array(pairs[0].astype(np.int64))
                yield pa.record_batch([pa.array(pairs[1].view(np.int64)), *[b.column(c).take(at) for c in ys]], ["f", *ys])

    total = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ys]).first()
    n = total["n"]
    if not n:
        return Chain(names, np.zeros(0, np.uint64), [np.zeros(c) for c in range(len(names))], [-35.0] * len(names), [CUTS[1]] * len(names))
    counts = sample.mapInArrow(tidy(listed), f"f long, {kinds}").groupBy("f").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ys]).where("n >= 3")
    best = None
    scores = []
    for c in ys:
        a, pos = F.col(c), total[c]
        expect = F.col("n") * F.lit(pos / n)
        scores.append(((a - expect) * (a - expect) / F.greatest(expect * F.lit(1 - pos / n), F.lit(1e-9))).alias("s" + c))
    counts = counts.select("f", *scores).cache()
    try:
        for c in ys:
            top = {r.f for r in counts.orderBy(F.col("s" + c).desc(), "f").limit(FEATURES).select("f").collect()}
            best = top if best is None else best | top
    finally:
        counts.unpersist()
    known = np.sort(np.array(sorted(best), np.int64).view(np.uint64))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                doc, idx = present(b.column("text"), known)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(idx.astype(np.int32)))
                yield pa.record_batch([b.column("k"), *[b.column(c) for c in ys], lists], ["k", *ys, "idx"])

    kind = dict(docs.dtypes)[key]
    rows = sample.mapInArrow(tidy(seen), f"k {kind}, {kinds}, idx array<int>").select(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(FOLDS)).alias("fold"), *ys, "idx").toArrow()
    lists = rows.column("idx").combine_chunks()
    size = np.asarray(pc.list_value_length(lists))
    idx, doc = np.asarray(lists.flatten()).astype(np.int64), np.repeat(np.arange(len(size)), size)
    fold, m = np.asarray(rows.column("fold")), len(known)
    early = np.zeros((len(size), 0))
    weights, bias, cuts = [], [], []
    for c in ys:
        target = np.asarray(rows.column(c)).astype(float)
        w, b = _fit(doc, idx, early, target, m)
        weights.append(w)
        bias.append(b)
        held = np.zeros(len(size))
        for k in range(FOLDS):
            own = fold != k
            place = np.cumsum(own) - 1
            part = own[doc]
            wk, bk = _fit(place[doc[part]], idx[part], early[own], target[own], m)
            z = np.bincount(doc, wk[idx], len(size)) + early @ wk[m:] + bk
            held[~own] = sigmoid(z)[~own]
        cuts.append(best_cut(target, held))
        early = np.column_stack([early, held])
    return Chain(names, known, weights, bias, cuts)


def score(docs: DataFrame, chain: Chain, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a column `into`: a struct of the categories' probabilities. Null and empty texts have no words, and
    get the probabilities of a document without known features. The whole text counts, however long."""
    small_batches(docs.sparkSession)
    kind = "struct<" + ", ".join(f"`{c}`: double" for c in chain.categories) + ">"

    @F.arrow_udf(kind)
    def probabilities(column: pa.Array) -> pa.Array:
        batch = pa.record_batch([column], ["text"])
        p = np.concatenate([chain.score(b.column("text")) for b in slices(batch)]) if len(column) else np.zeros((0, len(chain.categories)))
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(chain.categories))], list(chain.categories))

    return docs.withColumn(into, probabilities(F.col(text)))
