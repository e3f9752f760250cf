"""Windows of L units (words or bytes) that occur more than once: the shared kernel of the substring operators.

A window's trigger is the leftmost smallest rolling hash of K units among its first W places; it depends on the window's
content alone, so equal windows have it at the same place. The windows of one trigger, a run of neighbouring starts, are
handled as one row: `g` hashes the L - W + 1 units from the trigger on, which all of them hold, and `c` the whole stretch
that they cover. Rows equal in (g, c) hold equal windows throughout (a class). Windows of different classes can be equal
only where the classes share g; there, and only there, the windows of one row of each class are hashed singly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_UNITS, SPACE_WORDS, mix, packed, prefix_hash, run_hash, slices, small_batches, tidy, word_bounds, word_hashes

#: Starts handled at a time inside one text, and low bits of a trigger's sort key that hold its place.
RUN, PLACE = 1 << 18, np.uint64((1 << 28) - 1)
SLICE = 1 << 19


class Spec:
    """window: L units; spread: W places that a trigger is taken from; gram: K units of the rolling hash."""

    def __init__(self, unit: str, window: int, spread: int, gram: int):
        if gram + spread - 1 > window or spread > 1024 or unit not in ("word", "byte"):
            raise ValueError("a trigger must lie inside its window")
        self.unit, self.window, self.spread, self.gram = unit, window, spread, gram

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashed units of all texts, and the first unit of each text (one more at the end)."""
        data, offsets = packed(column)
        if self.unit == "byte":
            return BYTE_UNITS[data], offsets
        starts, ends, first = word_bounds(data, offsets, SPACE_WORDS)
        return word_hashes(data, starts, ends), first

    def triggers(self, units: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, trigger, lowest start, highest start, g, c), places counted from the text's first unit."""
        n, L, W, K = len(units), self.window, self.spread, self.gram
        lo = 0
        while lo + L <= n:
            hi = min(n, lo + RUN + L - 1)  # starts lo .. hi - L
            end_of = first[np.searchsorted(first, np.arange(lo, hi - L + 1), "right")]
            starts = np.flatnonzero(np.arange(lo, hi - L + 1) + L <= end_of)
            if len(starts):
                h = prefix_hash(units[lo:hi])
                at = np.arange(hi - lo - K + 1)
                least = (run_hash(h, at, at + K) & ~PLACE) | at.astype(np.uint64)
                wide = 1
                while wide * 2 <= W:
                    least = np.minimum(least[:-wide], least[wide:])
                    wide *= 2
                if wide < W:
                    least = np.minimum(least[: wide - W], least[W - wide :])
                q = (least[starts] & PLACE).astype(np.int64)
                cut = np.flatnonzero((np.diff(q) != 0) | (np.diff(starts) != 1))
                a, b = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
                q = q[np.concatenate([[0], cut + 1])]
                g = run_hash(h, q, q + L - W + 1)
                c = mix(run_hash(h, a, b + L) + (q - a).astype(np.uint64) * np.uint64(0x9E6C63D0676A9A99))
                text = np.searchsorted(first, lo + a, "right") - 1
                base = first[text] - lo
                yield text, q - base, a - base, b - base, g, c
            lo += RUN


def pack_at(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Trigger, places from the lowest start to it, and from the lowest to the highest start, in 64 bits."""
    return (q << 20) | ((q - a) << 10) | (b - a)


def lowest(at: Column) -> Column:
    return F.shiftright(at, 20) - F.shiftright(at, 10).bitwiseAND(1023)


def highest(at: Column) -> Column:
    return lowest(at) + at.bitwiseAND(1023)


def trigger_rows(docs: DataFrame, spec: Spec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, g, c, at for each trigger of each text. Rows with a null key have none."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in slices(big, "t", SLICE):
                for doc, q, a, b, g, c in spec.triggers(*spec.units(s.column("t"))):
                    yield pa.record_batch([s.column("k").take(pa.array(doc)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(pack_at(q, a, b))], ["k", "g", "c", "at"])

    kind = dict(docs.dtypes)[key]
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidy(rows), f"k {kind}, g long, c long, at long")


def window_rows(docs: DataFrame, wanted: DataFrame, spec: Spec, extra: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, g, *extra, h, start: a row for each single window of the wanted rows (k, g, at, *extra), h its hash."""
    small_batches(docs.sparkSession)
    kinds = dict(wanted.dtypes)
    asked = wanted.groupBy("k").agg(F.collect_list(F.struct("g", "at", *extra)).alias("asked"))  # one text's rows

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in slices(big, "t", SLICE):
                units, first = spec.units(s.column("t"))
                lists = s.column("asked")
                asked = lists.flatten()
                row = np.repeat(np.arange(s.num_rows), np.asarray(lists.value_lengths()))
                fields = dict(zip([f.name for f in asked.type], asked.flatten(), strict=True))
                at = np.asarray(fields["at"])
                a = (at >> 20) - ((at >> 10) & 1023)
                n = (at & 1023) + 1
                n = np.clip(np.diff(first)[row] - spec.window - a + 1, 0, n)  # a key that stands for several texts
                which = np.repeat(np.arange(len(at)), n)
                start = np.repeat(a, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                h = np.empty(len(which), np.uint64)
                begin, of = start + first[row[which]], row[which]
                for i in range(0, len(which), RUN):
                    part = slice(i, i + RUN)
                    lo, hi = first[of[i]], first[of[part][-1] + 1]
                    total = prefix_hash(units[lo:hi])
                    h[part] = run_hash(total, begin[part] - lo, begin[part] - lo + spec.window)
                take = pa.array(which)
                yield pa.record_batch([s.column("k").take(pa.array(of)), *[fields[c].take(take) for c in ["g", *extra]], pa.array(h.view(np.int64)), pa.array(start)], ["k", "g", *extra, "h", "start"])

    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = ", ".join([f"k {kinds['k']}", "g long", *[f"{c} {kinds[c]}" for c in extra], "h long", "start long"])
    return texts.join(asked, "k").select("k", "t", "asked").mapInArrow(tidy(rows), schema)


def cut_out(docs: DataFrame, runs: DataFrame, handle: Callable, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the columns `schema` that handle(text column, runs) makes of each text and its runs (k, a, b) of units to
    remove: arrays of lowest and one-past-highest units, ascending, that don't overlap."""
    small_batches(docs.sparkSession)
    gone = runs.groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    kinds = dict(docs.dtypes)
    others = [c for c in docs.columns if c != text]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in slices(big, "_t", SLICE):
                joined = []
                for x in s.column("_gone"):
                    if x.is_valid:
                        at = x.values.flatten()
                        joined.append(union(np.asarray(at[0]), np.asarray(at[1])))
                    else:
                        joined.append(None)
                yield pa.record_batch([*[s.column(f"_{i}") for i in range(len(others))], *handle(s.column("_t"), joined)], [*[f"_{i}" for i in range(len(others))], *names])

    left = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(others)], F.col(key).alias("_k"), F.col(text).alias("_t"))
    both = left.join(gone.select(F.col("k").alias("_k"), F.col("gone").alias("_gone")), "_k", "left").drop("_k")
    out = both.mapInArrow(tidy(rows), ", ".join([*[f"_{i} {kinds[c]}" for i, c in enumerate(others)], schema]))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(others)], *names)


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of runs [a, b) as ascending maximal runs."""
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[new], reach[np.concatenate([new[1:], [True]])]
