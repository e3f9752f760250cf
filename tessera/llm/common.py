"""Shared pieces: checkpoints, row slicing, vectorised hashing of packed text."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles at a time (a longer document is handled alone).
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or where it is unset and Spark runs in one process, a temporary
    one. Unset on a cluster, it raises ValueError."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(sc, "_tessera_shared", None)
        if path is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = sc._tessera_shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints of frames that are no longer held.

    Spark removes them some time after the driver's garbage collector has seen that nobody refers to them."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
    if "TESSERA_LEAN" in spark.sparkContext.environment:
        lean_heaps(spark)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, since one document can be very long; and workers that find this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))


def lean_workers(spark: SparkSession) -> None:
    """Python workers that give large freed arrays back to the system at once, for jobs in which workers of several
    stages are alive side by side, and executors that start the next stage with a small heap."""
    env = spark.sparkContext.environment
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "262144"), ("MALLOC_TRIM_THRESHOLD_", "262144"), ("MALLOC_ARENA_MAX", "1"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env[name] = value
    env["TESSERA_LEAN"] = "1"
    lean_heaps(spark)


def lean_heaps(spark: SparkSession) -> None:
    """Let the executors collect their garbage, after which a JVM gives unused heap back to the system. Otherwise a heap
    grows to its limit over the stages and stays there, however little of it lives, beside the Python workers.

    A task for each slot, so that every idle executor has some; results don't depend on which executors they reach."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).where("reflect('java.lang.System', 'gc') is not null").count()


def trim() -> None:
    """Give freed memory of this process back to the system, where its C library can; the powers of the hashes go too,
    16 bytes for each byte of the longest slice."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after which a lean worker gives its freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        if os.environ.get("TESSERA_LEAN"):
            trim()

    return run


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose text comes to about `most` bytes."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    run = np.cumsum(size)
    lo = 0
    while lo < n:
        before = run[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(run, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        m = max(n + 1, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            step = np.full(m + 1, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def prefix_hash(units: np.ndarray) -> np.ndarray:
    """H with which run_hash gives the hash of any run of units; units are scrambled 64-bit words."""
    up, _ = powers(len(units))
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=out[1:])
    return out


def run_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of units[lo:hi], the same wherever the run stands."""
    _, down = powers(len(h))
    return mix((h[hi] - h[lo]) * down[lo] + (hi - lo).astype(np.uint64))


BYTE_UNITS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts and the first word of each text (one more at the end). is_word: by byte."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


#: Everything but space and \x09-\x0D.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False

#: A-Z to a-z, the rest unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Words hashed at a time, so that a very long text needs no more memory than a slice of short ones.
WORD_RUN = 1 << 17


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), WORD_RUN):
        a, b = starts[i : i + WORD_RUN], ends[i : i + WORD_RUN]
        lo = a[0]
        out[i : i + WORD_RUN] = run_hash(prefix_hash(BYTE_UNITS[data[lo : b[-1]]]), a - lo, b - lo)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
