"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, release, tidy
from .tokens import unpack_ids

#: Up to so many sources a worker holds the counts of all queues for its rounds; beyond, counts are joined from a table.
QUEUES = 256
#: Ids of a queue in a bucket of that join.
BUCKET = 4096


class Schedule:
    """How many ids each queue has sent after r rounds of `length` ids.

    In each round queue s earns length * weight_s / (weights of the queues that aren't empty) and sends the whole ids of
    what it has earned; the fraction stays as its deficit for the next round, whichever window or partition that falls
    in. So sent(r) = floor(r * quantum) from the start of a phase, and a phase ends when a queue runs empty. With the
    queues' own totals as weights all run empty in the last round."""

    def __init__(self, totals: list[int], weights: list[int], length: int):
        self.totals, self.length = totals, length
        self.phases: list[tuple[int, list[int], int]] = []  # first round, sent before it, sum of live weights
        self.weights, sent, r = weights, [0] * len(totals), 0
        while live := [s for s, t in enumerate(totals) if sent[s] < t]:
            total = sum(weights[s] for s in live)
            self.phases.append((r, list(sent), total))
            done = min(-(-(totals[s] - sent[s]) * total // (length * weights[s])) for s in live)
            sent = [min(t, b + (done * length * w // total if b < t else 0)) for t, b, w in zip(totals, sent, weights, strict=True)]
            r += done
        self.rounds = r
        wide = max([length * max(weights, default=1) * (r + 1), sum(totals)], default=0) >= 1 << 62
        self.kind = object if wide else np.int64  # Python integers where 64 bits would overflow

    def sent(self, r: np.ndarray) -> np.ndarray:
        """Ids that each queue (columns) has sent after r rounds (rows)."""
        r = np.asarray(r, np.int64)
        out = np.zeros((len(r), len(self.totals)), self.kind)
        totals, weights = np.array(self.totals, self.kind), np.array(self.weights, self.kind)
        phase = np.searchsorted([p[0] for p in self.phases], r, "right") - 1
        for i in np.unique(phase):
            first, base, total = self.phases[i]
            at, base = phase == i, np.array(base, self.kind)
            gone = (r[at] - first).astype(self.kind)[:, None]
            out[at] = np.minimum(totals, base + np.where(base < totals, gone * (self.length * weights) // total, 0))
        return out

    def round_of(self, queue: int, position: int) -> int:
        """The round (from 0) that sends this id of the queue: the last r with sent(r) <= position."""
        for first, base, total in reversed(self.phases):
            if base[queue] <= position:
                break
        step = self.length * self.weights[queue]
        r = first + (position - base[queue]) * total // step
        while self._one(queue, r + 1) <= position:
            r += 1
        while r > 0 and self._one(queue, r) > position:
            r -= 1
        return r

    def _one(self, queue: int, r: int) -> int:
        i = max(k for k, p in enumerate(self.phases) if p[0] <= r)
        first, base, total = self.phases[i]
        t = self.totals[queue]
        return min(t, base[queue] + ((r - first) * self.length * self.weights[queue] // total if base[queue] < t else 0))


def queue_of(sources: list[str | None]) -> dict[str | None, int]:
    """A queue for each source, in order of the names."""
    return {s: i for i, s in enumerate(sorted(sources, key=lambda s: (s is not None, s or "")))}


def phases_by_weight(totals: list[int], weights: list[int], length: int) -> list[tuple[int, int, dict[int, int], int]]:
    """The phases of Schedule for any number of queues: first round, rounds, sent before it by weight, sum of live
    weights. Live queues of one weight have sent alike, so a phase is as long as there are different weights."""
    ends = {w: sorted(t for t, x in zip(totals, weights, strict=True) if x == w and t) for w in set(weights)}
    done, sent, r, out = dict.fromkeys(ends, 0), dict.fromkeys(ends, 0), 0, []
    while live := [w for w in ends if done[w] < len(ends[w])]:
        total = sum(w * (len(ends[w]) - done[w]) for w in live)
        rounds = min(-(-(ends[w][done[w]] - sent[w]) * total // (length * w)) for w in live)
        out.append((r, rounds, {w: sent[w] for w in live}, total))
        for w in live:
            sent[w] += rounds * length * w // total
            while done[w] < len(ends[w]) and ends[w][done[w]] <= sent[w]:
                done[w] += 1
        r += rounds
    return out


def sendings(phases: list[tuple[int, int, dict[int, int], int]], total: int, weight: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(round, first id, ids) of each round that sends ids of a queue."""
    for first, rounds, sent, live in phases:
        base, step = sent.get(weight, total), length * weight
        at, end = base, min(total, base + rounds * step // live)
        while at < end:
            g = -(-(at - base + 1) * live // step)
            then = min(total, base + g * step // live)
            yield first + g - 1, at, then - at
            at = then


def pack(tokens: DataFrame, length: int = 2048, mixture: Mapping[str, int] | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Pack the ids of token_rows (which keeps key and source) into sequences of `length` ids in the mixture's
    proportions: mixture maps a source to its integer weight (1 if it isn't named); None: each source's own ids.

    Each source is a queue in ascending order of the key. Every round of the schedule gives a window its share of each
    queue, and sequences are cut every `length` ids of the rounds in a row, so that the last one alone is not full.
    Positions are prefix sums by ranges of (queue, key); only keys and counts are shuffled for them, and one queue with
    most rows still spreads over many ranges. Null source: a queue. Null or repeated keys: their rows are packed one by
    one. Empty table: no rows. Returns a row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source."""
    spark = tokens.sparkSession
    t = cut(tokens.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), "h", "n", "z").withColumn("row", F.monotonically_increasing_id()))
    release(spark)
    by_source = {r.s: r.n for r in t.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    place = queue_of(list(by_source))
    named = spark.createDataFrame(list(place.items()), "named string, q int")
    light = t.join(F.broadcast(named), F.col("s").eqNullSafe(F.col("named"))).select("row", "q", "k", "h", "n")
    order = [F.col("q"), F.col("k").asc_nulls_first(), F.col("h"), F.col("row")]
    dealt = cut(light.repartitionByRange(parts(spark), *order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("q", "part").agg(F.sum("n").alias("sum"))  # a row for each part and each queue it meets
    totals = [by_source[s] for s in place]
    weights = totals if mixture is None else [int(mixture.get(s, 1)) for s in place]
    ahead = sums.select("q", "part", (F.sum("sum").over(Window.partitionBy("q").orderBy("part")) - F.col("sum")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("q", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = dealt.select("row", "q", "n", "part", inside.alias("inside")).join(ahead, ["q", "part"]).select("row", "q", "n", (F.col("inside") + F.col("ahead")).alias("at"))
    kinds = dict(t.dtypes)
    shape = f"k {kinds['k']}, start long, length long, crc long, n long, seq long, off long, s string"
    if len(place) > QUEUES:
        out = _joined(t, placed, totals, weights, length, shape)
        return _named(out, key)
    schedule = Schedule(totals, weights, length)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 64):
                yield cut_up(big.slice(lo, 64))

    def cut_up(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [unpack_ids(z) for z in b.column("z").to_pylist()]
        queue = b.column("q").to_pylist()
        at = b.column("at").to_pylist()
        span = [(schedule.round_of(q, a), schedule.round_of(q, a + len(x) - 1)) for q, a, x in zip(queue, at, ids, strict=True)]
        rounds = np.unique(np.concatenate([np.arange(a, z + 2) for a, z in span])) if span else np.zeros(0, np.int64)
        sent = schedule.sent(rounds)
        whole = sent.sum(1)
        spot = {int(r): i for i, r in enumerate(rounds)}
        which, rows = [], []
        for i, (q, a, x, (first, last)) in enumerate(zip(queue, at, ids, span, strict=True)):
            n, wide = len(x), x.astype("<u4")
            raw = memoryview(wide).cast("B")
            j = np.arange(spot[first], spot[first] + last - first + 1)
            begin, end = np.maximum(sent[j, q], a), np.minimum(sent[j + 1, q], a + n)
            earlier = (sent[j + 1, :q] - sent[j, :q]).sum(1)
            where = whole[j] + earlier + (begin - sent[j, q])
            for s, e, g in zip(begin.tolist(), end.tolist(), where.tolist(), strict=True):
                while s < e:  # at most twice: a round is no longer than a sequence
                    m = min(e - s, length - g % length)
                    which.append(i)
                    rows.append((s - a, m, zlib.crc32(raw[4 * (s - a) : 4 * (s - a + m)]), n, g // length, g % length))
                    s, g = s + m, g + m
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)]
        take = pa.array(which, pa.int64())
        return pa.record_batch([b.column("k").take(take), *columns, b.column("s").take(take)], ["k", "start", "length", "crc", "n", "seq", "off", "s"])

    out = t.select("row", "k", "s", "z").join(placed.drop("n"), "row").select("k", "s", "z", "q", "at")
    return _named(out.mapInArrow(tidy(pieces), shape), key)


def _joined(t: DataFrame, placed: DataFrame, totals: list[int], weights: list[int], length: int, shape: str) -> DataFrame:
    """The pieces by a table of what each queue sends in each round: its prefix sums are the places in the sequences."""
    spark = t.sparkSession
    phases = phases_by_weight(totals, weights, length)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q in b.column("q").to_pylist():
                rows = sendings(phases, totals[q], weights[q], length)
                while some := list(islice(rows, 1 << 14)):
                    yield pa.record_batch([pa.array([q] * len(some), pa.int32()), *[pa.array(c, pa.int64()) for c in zip(*some, strict=True)]], ["q", "r", "begin", "m"])

    queues = spark.range(len(totals)).select(F.col("id").cast("int").alias("q")).repartition(parts(spark), "q")
    sent = queues.mapInArrow(tidy(counts), "q int, r long, begin long, m long")
    sent = cut(sent.repartitionByRange(parts(spark), "r", "q").withColumn("part", F.spark_partition_id()))
    sums = sent.groupBy("part").agg(F.sum("m").alias("sum"))
    ahead = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("ahead"))  # a row for each part
    inside = F.sum("m").over(Window.partitionBy("part").orderBy("r", "q").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    sent = sent.select("q", "begin", "m", "part", inside.alias("inside")).join(F.broadcast(ahead), "part").select("q", "begin", "m", (F.col("inside") + F.col("ahead")).alias("g"))
    buckets = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor((F.col(a) + F.col(n) - 1) / BUCKET)))
    mine = placed.where("n > 0").withColumn("bucket", buckets("at", "n"))
    both = mine.join(sent.withColumn("bucket", buckets("begin", "m")), ["q", "bucket"])
    start, end = F.greatest("at", "begin"), F.least(F.col("at") + F.col("n"), F.col("begin") + F.col("m"))
    both = both.where((start < end) & (F.floor(start / BUCKET) == F.col("bucket")))
    piece = F.struct((start - F.col("at")).alias("s"), (end - start).alias("m"), (F.col("g") + start - F.col("begin")).alias("g"))
    listed = both.groupBy("row").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 64):
                yield cut_up(big.slice(lo, 64))

    def cut_up(b: pa.RecordBatch) -> pa.RecordBatch:
        which, rows = [], []
        for i, (z, spans) in enumerate(zip(b.column("z").to_pylist(), b.column("pieces").to_pylist(), strict=True)):
            x = unpack_ids(z)
            raw = memoryview(x.astype("<u4")).cast("B")
            for p in spans:
                s, g, e = p["s"], p["g"], p["s"] + p["m"]
                while s < e:
                    m = min(e - s, length - g % length)
                    which.append(i)
                    rows.append((s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), len(x), g // length, g % length))
                    s, g = s + m, g + m
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)]
        take = pa.array(which, pa.int64())
        return pa.record_batch([b.column("k").take(take), *columns, b.column("s").take(take)], ["k", "start", "length", "crc", "n", "seq", "off", "s"])

    return t.select("row", "k", "s", "z").join(listed, "row").select("k", "s", "z", "pieces").mapInArrow(tidy(pieces), shape)


def _named(out: DataFrame, key: str) -> DataFrame:
    return out.select(
        F.col("k").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("seq").alias("sequence_id"), F.col("off").alias("offset"), F.col("s").alias("source")
    )
