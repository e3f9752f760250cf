"""Substring deduplication: a log-structured index of sorted runs over words, and grouped window hashes over words or bytes."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, cut, delete, packed, parts, release, scratch, slices, small_batches, tidy, word_bounds
from .windows import SLICE, Spec, cut_out, highest, lowest, trigger_rows, union, window_rows

#: Windows of 20 words, triggers from 14 places of 7 words; runs of one level that are compacted into one of the next.
WORDS, FANOUT = Spec("word", 20, 14, 7), 2
#: Windows of 400 bytes, triggers from 128 places of 16 bytes.
BYTES = Spec("byte", 400, 128, 16)
#: Passages of over 50 words, which can have less than 400 bytes.
PASSAGES = Spec("word", 51, 32, 14)


def _covered(judged: DataFrame, texts: DataFrame, spec: Spec, earlier: bool, key: str, text: str) -> DataFrame:
    """k, a, b: runs of units of the new rows of judged (k, g, c, at, new) that windows with another occurrence cover, or
    with an earlier one (old rows come before new ones, then keys and places count).

    Rows equal in (g, c) hold equal windows throughout; an aggregate finds the first of each class, and a join gives it
    back to its rows. Classes that share g are contested: their first rows' windows are hashed one by one, and aggregates
    on (g, window) find equal ones. No window function and no list gathers a group, so a passage that a third of all
    documents hold is summed before the shuffle and its rows can be split over tasks."""
    spark = judged.sparkSession
    me = F.struct("new", "k", "at")
    classes = cut(judged.groupBy("g", "c").agg(F.min(me).alias("first"), F.max(me).alias("last")))
    many = F.col("first") != F.col("last")
    rows = judged.where("new").join(classes.where(many).select("g", "c", "first"), ["g", "c"])
    whole = (rows.where(me != F.col("first")) if earlier else rows).select("k", lowest(F.col("at")).alias("a"), (highest(F.col("at")) + spec.window).alias("b"))
    # aggregates are cut before they are joined, since only a join of two plain shuffles can split a hot key's rows
    heads = cut(classes.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("last.new").alias("any")).where("lo <> hi and any").select("g"))
    wanted = classes.join(heads, "g", "left_semi").select("first.k", "g", "first.at", "first.new", many.alias("many"))
    path = scratch(spark, "windows")  # compressed, unlike a checkpoint
    window_rows(texts, wanted, spec, ["new", "many"], key, text).write.option("compression", "zstd").parquet(path)
    single = spark.read.parquet(path)
    release(spark)
    one = F.struct("new", "k", "start")
    equal = cut(single.groupBy("g", "h").agg(F.min(one).alias("first"), F.max(one).alias("last")).where("first <> last").select("g", "h", *(["first"] if earlier else [])))
    shared = single.where("new" if earlier else "not many").join(equal, ["g", "h"])
    shared = (shared.where(one != F.col("first")) if earlier else shared).select("k", F.col("start").alias("a"), (F.col("start") + spec.window).alias("b"))
    out = cut(whole.union(shared))
    delete(spark, path)
    release(spark)
    return out


class FingerprintIndex:
    """A log-structured index of the windows seen so far, for deduplication batch by batch and job by job.

    A run under `path` is immutable: the first row (g, c, k, at) of each class of windows of a batch (see windows.py), in
    buckets by fingerprint g, each sorted by (g, c). A new batch's classes get the same buckets, so that runs are
    merge-joined with them where they lie, without a shuffle of the index. Classes that the history has, or that come
    later in the batch, are removed whole; where classes differ but share g, their single windows are verified, old ones
    read again from `history`. FANOUT runs of one level are compacted into one of the next, so that each row is rewritten
    a logarithmic number of times. An index on an existing path goes on where it was left."""

    def __init__(self, spark: SparkSession, path: str | None = None, spec: Spec = WORDS, key: str = "doc_id", text: str = "text"):
        self.spark, self.spec, self.key, self.text = spark, spec, key, text
        self.path = path or scratch(spark, "index")
        self.runs: list[tuple[str, int, str]] = []  # table, level, folder
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = jvm.Path(self.path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
        self.next, self.buckets = 0, parts(spark)
        for name in names:
            found = re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", name)
            if found and fs.exists(jvm.Path(f"{self.path}/{name}/_SUCCESS")):  # others are leavings of a lost job
                number, level, self.buckets = map(int, found.groups())
                self.next = number + 1
                self.runs.append((self._open(f"{self.path}/{name}", self.buckets), level, f"{self.path}/{name}"))

    def _open(self, folder: str, buckets: int) -> str:
        name = f"tessera_run_{uuid.uuid4().hex}"
        columns = ", ".join(f"{c} {t}" for c, t in self.spark.read.parquet(folder).dtypes)
        self.spark.sql(f"create table {name} ({columns}) using parquet clustered by (g) sorted by (g, c) into {buckets} buckets location '{folder}'")
        return name

    def _write(self, classes: DataFrame, level: int) -> str:
        """A run of the classes, added to the index; its table."""
        name, folder = f"tessera_run_{uuid.uuid4().hex}", f"{self.path}/run-{self.next:09}-{level}-{self.buckets}"
        self.next += 1
        rows = classes.select("g", "c", "k", "at").repartition(self.buckets, "g")
        rows.write.format("parquet").option("path", folder).option("compression", "zstd").bucketBy(self.buckets, "g").sortBy("g", "c").saveAsTable(name)
        self.runs.append((name, level, folder))
        return name

    def _drop(self, run: tuple[str, int, str]) -> None:
        self.runs.remove(run)
        self.spark.sql(f"drop table if exists {run[0]}")
        delete(self.spark, run[2])

    def compact(self) -> None:
        """Merge the newest runs of a level while there are FANOUT of it: the first row of each class stays."""
        while len(same := [r for r in self.runs if r[1] == self.runs[-1][1]]) >= FANOUT:
            rows = self.spark.table(same[0][0])
            for r in same[1:]:
                rows = rows.unionByName(self.spark.table(r[0]))
            first = rows.repartition(self.buckets, "g").groupBy("g", "c").agg(F.min(F.struct("k", "at")).alias("x"))
            self._write(first.select("g", "c", "x.k", "x.at"), same[0][1] + 1)
            for r in same:
                self._drop(r)
            release(self.spark)

    def ingest(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """k, a, b: runs of units of the batch's documents that windows with an earlier start cover; the batch is in the
        index then. history: the documents of earlier batches, whose keys are all smaller.

        Rows with a null key have no runs and aren't indexed; a repeated key stands for one document. An empty batch, and
        null or short texts, leave no rows."""
        path = scratch(self.spark, "rows")
        trigger_rows(batch.where(F.col(self.key).isNotNull()), self.spec, self.key, self.text).write.option("compression", "zstd").parquet(path)
        rows = self.spark.read.parquet(path)
        older = list(self.runs)
        classes = rows.groupBy("g", "c").agg(F.min(F.struct("k", "at")).alias("x"), F.count("*").alias("n"))
        new = self.spark.table(self._write(classes.select("g", "c", "x.k", "x.at"), 0))
        release(self.spark)
        # fingerprints of which the batch or the history has more than one row; the index itself isn't shuffled
        own = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
        judged = rows.select("k", "g", "c", "at", F.lit(True).alias("new"))
        if older:
            met = None
            for name, _, _ in older:
                old = self.spark.table(name).join(new.select("g"), "g", "left_semi").select("k", "g", "c", "at", F.lit(False).alias("new"))
                met = old if met is None else met.unionByName(old)
            met = cut(met)
            own = own.union(met.select("g")).distinct()
        judged = judged.join(cut(own), "g", "left_semi")
        judged = cut(judged.unionByName(met) if older else judged)
        delete(self.spark, path)
        release(self.spark)
        texts = batch.select(self.key, self.text)
        out = _covered(judged, texts if history is None else history.select(self.key, self.text).unionByName(texts), self.spec, True, self.key, self.text)
        if not self.spark.table(self.runs[-1][0]).take(1):  # a run without rows has no files
            self._drop(self.runs[-1])
        else:
            self.compact()
        return out

    def close(self, keep: bool = False) -> None:
        """Forget the tables; the files go too unless they are kept for a later job."""
        for run in list(self.runs):
            if keep:
                self.spark.sql(f"drop table if exists {run[0]}")
                self.runs.remove(run)
            else:
                self._drop(run)
        if not keep:
            delete(self.spark, self.path)


def repeated_words(docs: DataFrame, batches: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, a, b: runs of words of the documents that 20-word windows with an earlier start cover, found by ingesting the
    documents into a fresh index in `batches` batches of ascending keys.

    A repeated key stands for one document; its rows are alike or share the runs of both. Rows with a null key have no
    runs, and other documents' windows are not compared with theirs. Empty tables, null, empty and short texts have none;
    very long texts are hashed whole, a stretch at a time. Other columns are ignored, whatever their names."""
    index = FingerprintIndex(docs.sparkSession, key=key, text=text)
    docs = docs.select(key, text)
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set((docs.agg(F.percentile_approx(key, shares, 10_000)).first()[0] if shares else None) or []))
    edges = [None, *bounds, None]
    found = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        batch, before = docs, docs.where(F.col(key) <= F.lit(lo)) if lo is not None else None
        if lo is not None:
            batch = batch.where(F.col(key) > F.lit(lo))
        if hi is not None:
            batch = batch.where(F.col(key) <= F.lit(hi))
        runs = index.ingest(batch, before)
        found = runs if found is None else found.union(runs)
    index.close()
    return found


def without_words(docs: DataFrame, runs: DataFrame, digest: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the words of the runs: the text is its other words, joined by one space where any is removed; with
    `digest`, n_words, n_removed and kept_sha256 instead of the text."""

    def handle(column: pa.Array, gone: list) -> list[pa.Array]:
        total, removed, out = [], [], []
        for x, runs in zip(column.cast(pa.binary()), gone, strict=True):
            raw = x.as_py()
            words = (raw or b"").split()
            total.append(len(words))
            removed.append(0)
            if runs is not None:
                keep = np.zeros(len(words) + 1, np.int64)
                a, b = np.minimum(runs[0], len(words)), np.minimum(runs[1], len(words))
                np.add.at(keep, a, 1)
                np.subtract.at(keep, b, 1)
                words = [w for w, k in zip(words, np.cumsum(keep)[:-1].tolist(), strict=True) if not k]
                removed[-1] = total[-1] - len(words)
            if digest:
                out.append(hashlib.sha256(b" ".join(words)).hexdigest())
            else:
                out.append(raw if not removed[-1] else b" ".join(words))
        if digest:
            return [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
        return [pa.array(out, pa.binary()).cast(pa.string())]

    schema = "n_words long, n_removed long, kept_sha256 string" if digest else f"{text} string"
    return cut_out(docs, runs, handle, schema, key, text)


def repeated_bytes(docs: DataFrame, spec: Spec = BYTES, key: str = "doc_id", text: str = "text", earlier: bool = False) -> DataFrame:
    """k, a, b: runs of units (bytes, by default) of the documents that windows of `spec` with another occurrence cover, or
    with `earlier`, with an earlier one: then the first occurrence stays.

    This is not prefix-free parsing: no suffix arrays of a dictionary and a parse are built. Texts are cut at rolling-hash
    triggers into overlapping phrases, each with all windows of one trigger; equal phrases are one class, found by hash.
    Where phrases share the trigger's stretch and yet differ, their windows are hashed and compared one by one. Finding
    repeats of a given length needs equal windows together, but no order. Results are exact up to 64-bit hashes.

    A repeated key stands for one document and is no other occurrence of itself. Rows with a null key have no runs and
    are no occurrences. Empty tables, null, empty and short texts have none; very long texts are hashed whole, a stretch
    at a time. Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    path = scratch(spark, "rows")
    trigger_rows(docs, spec, key, text).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    twice = cut(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    judged = cut(rows.join(twice, "g", "left_semi").select("k", "g", "c", "at", F.lit(True).alias("new")))
    delete(spark, path)
    release(spark)
    return _covered(judged, docs, spec, earlier, key, text)


def covered_units(runs: DataFrame) -> DataFrame:
    """k, n: units that a document's runs (k, a, b) cover; a row for each document with any."""
    listed = runs.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("r"))  # one text's runs
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).cast("long").alias("n"), F.greatest(s["end"], x["b"]).cast("long").alias("end"))
    return listed.select("k", F.aggregate("r", start, step)["n"].alias("n"))


def byte_runs(docs: DataFrame, runs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, a, b: runs of words as the bytes from their first word's start to their last word's end."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in slices(big, "t", SLICE):
                data, offsets = packed(s.column("t"))
                starts, ends, first = word_bounds(data, offsets, SPACE_WORDS)
                which, begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, x in enumerate(s.column("gone")):
                    at = x.values.flatten()
                    a, b = (np.minimum(r, first[i + 1] - first[i]) for r in union(np.asarray(at[0]), np.asarray(at[1])))
                    a, b = a[a < b], b[a < b]  # a key that stands for several texts
                    which.append(np.full(len(a), i))
                    begin.append(starts[first[i] + a] - offsets[i])
                    end.append(ends[first[i] + b - 1] - offsets[i])
                yield pa.record_batch([s.column("k").take(pa.array(np.concatenate(which))), pa.array(np.concatenate(begin), pa.int64()), pa.array(np.concatenate(end), pa.int64())], ["k", "a", "b"])

    gone = runs.groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("gone"))  # one text's runs
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null").join(gone, "k")
    return texts.mapInArrow(tidy(rows), f"k {dict(docs.dtypes)[key]}, a long, b long")


def without_bytes(docs: DataFrame, runs: DataFrame, digest: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the bytes of the runs; with `digest`, n_bytes, n_removed, n_spans and kept_sha256 instead of the text.
    A text keeps whole characters: one that would lose some of its bytes stays whole (digests are of the exact bytes)."""

    def handle(column: pa.Array, gone: list) -> list[pa.Array]:
        rows = []
        for x, runs in zip(column.cast(pa.binary()), gone, strict=True):
            null, raw = not x.is_valid, x.as_py() or b""
            n, kept, at, removed, spans = len(raw), [], 0, 0, 0
            for a, b in zip(*[np.minimum(r, n).tolist() for r in runs], strict=True) if runs is not None else ():
                if not digest:
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b < n and a < b and raw[b] & 0xC0 == 0x80:
                        b -= 1
                if a < b:
                    kept.append(raw[at:a])
                    at, removed, spans = b, removed + b - a, spans + 1
            left = b"".join([*kept, raw[at:]])
            rows.append((n, removed, spans, hashlib.sha256(left).hexdigest()) if digest else (None if null else left,))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.binary()]
        out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return out if digest else [out[0].cast(pa.string())]

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else f"{text} string"
    return cut_out(docs, runs, handle, schema, key, text)
