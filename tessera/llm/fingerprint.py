"""Canonical exact digests of documents, grouped by a wide hash with comparison of the bytes."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, release, slices, small_batches, tidy

#: Members of one equal bucket are compared in so many salted runs, and the runs' first texts with one another.
SALTS = 32


def canonical(text: str | None) -> bytes:
    """NFKC, case folded, NFKC again, runs of white space as one space, none at the ends; null is empty."""
    if not text:
        return b""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(text: str | None) -> str:
    """Exact digest of the canonical text: XXH3 of 128 bits, in hexadecimal."""
    return xxhash.xxh3_128_hexdigest(canonical(text))


def equal_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", wide_hash: Callable[[bytes], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """key, fingerprint, class_id, n_class: documents alike in canonical text.

    Rows are grouped by the wide hash and, inside a bucket, their canonical bytes are compared with the distinct texts
    of the row's salted run; the runs of a bucket are matched by the SHA-256 of those texts. A text that differs from
    its bucket's first gets the fingerprint `<hash>-<n>`. class_id is the smallest key of the class. Texts travel
    compressed; a task holds one bucket's distinct texts, which without a collision is one.

    Null text: empty. Null keys: classed, but never a class_id. Repeated rows: a row each. Empty table: no rows."""
    spark = docs.sparkSession
    small_batches(spark)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for big in batches:
            for b in slices(big, "t"):
                texts = [canonical(x) for x in b.column("t").to_pylist()]
                yield pa.record_batch([b.column("k"), pa.array([wide_hash(x) for x in texts]), pa.array([pack(x) for x in texts], pa.binary())], ["k", "h", "z"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidy(folded), f"k {kind}, h string, z binary")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number each row's text among the distinct ones of its run (sorted by h, salt); a text goes along where it is new."""
        unpack = zstandard.ZstdDecompressor().decompress
        run, known = None, []
        for b in batches:
            which, texts = [], []
            for h, salt, z in zip(b.column("h").to_pylist(), b.column("salt").to_pylist(), b.column("z").to_pylist(), strict=True):
                if run != (h, salt):
                    run, known = (h, salt), []
                raw = unpack(z)
                new = raw not in known
                if new:
                    known.append(raw)
                which.append(known.index(raw))
                texts.append(hashlib.sha256(raw).digest() if new else None)
            yield pa.record_batch([b.column("k"), b.column("h"), b.column("salt"), pa.array(which, pa.int32()), pa.array(texts, pa.binary())], ["k", "h", "salt", "nth", "head"])

    run = rows.repartition(parts(spark), "h", "salt").sortWithinPartitions("h", "salt", "k")
    kept = cut(run.mapInArrow(tidy(compared), f"k {kind}, h string, salt int, nth int, head binary"))
    del rows, run
    release(spark)
    heads = kept.where("head is not null").select("h", "salt", "nth", "head")
    order = Window.partitionBy("h").orderBy("head")
    first = heads.withColumn("n", F.dense_rank().over(order) - 1)
    named = kept.drop("head").join(first.select("h", "salt", "nth", "n"), ["h", "salt", "nth"])
    named = named.withColumn("fingerprint", F.when(F.col("n") == 0, F.col("h")).otherwise(F.concat_ws("-", "h", F.col("n").cast("string"))))
    groups = named.groupBy("fingerprint").agg(F.min("k").alias("class_id"), F.count("*").alias("n_class"))
    return named.select("k", "h", "fingerprint").join(groups, "fingerprint").select(F.col("k").alias(key), F.col("h").alias("digest"), "fingerprint", "class_id", "n_class")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text is the text with its last floor(n/2) code points replaced by as many of the first of the next
    document's, in ascending order of the key (the first's after the last). Documents are dealt by ranges of the key and
    read in order; the pairs that straddle two ranges, one for each range, are joined afterwards.

    Null text: empty. Null keys: first. Repeated keys: in order of a hash of the text. One document: its own next.
    Empty table: no rows. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[key]
    names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    schema = pa.schema([("n", pa.int64()), ("sha", pa.string()), ("fp", pa.string()), ("efp", pa.string()), ("nfp", pa.string()), ("end", pa.int8()), ("z", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.record_batch([b.column("k"), b.column("h"), pa.array([pack((x or "").encode()) for x in b.column("t").to_pylist()], pa.binary())], ["k", "h", "z"])

    def outcome(own: str, own_fp: str, after: str, after_fp: str) -> tuple:
        n = len(own)
        edited = own[: n - n // 2] + after[: n // 2]
        return n, hashlib.sha256(edited.encode()).hexdigest(), own_fp, digest(edited), after_fp, 0, None

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of pairs (end 0), and the first (end 1) and last (end 2) document of the range with their texts."""
        unpack = zstandard.ZstdDecompressor().decompress
        last, key_type = None, None
        for b in batches:
            key_type, keys, out = b.schema.field("k").type, [], []
            for k, z in zip(b.column("k").to_pylist(), b.column("z").to_pylist(), strict=True):
                own = unpack(z).decode()
                fp = digest(own)
                if last is None:
                    keys.append(k)
                    out.append((None, None, None, None, None, 1, z))
                else:
                    keys.append(last[0])
                    out.append(outcome(last[1], last[2], own, fp))
                last = (k, own, fp, z)
            yield frame(keys, key_type, out)
        if last is not None:
            yield frame([last[0]], key_type, [(None, None, None, None, None, 2, last[3])])

    def frame(keys: list, key_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.record_batch([pa.array(keys, key_type), *columns], ["k", *schema.names])

    def straddling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = [(unpack(z).decode(), unpack(w).decode()) for z, w in zip(b.column("z").to_pylist(), b.column("w").to_pylist(), strict=True)]
            if texts:
                yield frame(b.column("k").to_pylist(), b.schema.field("k").type, [outcome(x, digest(x), y, digest(y)) for x, y in texts])

    result = f"k {kind}, n long, sha string, fp string, efp string, nfp string, end byte, z binary"
    small = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t")).mapInArrow(tidy(packed), f"k {kind}, h long, z binary")
    dealt = small.repartitionByRange(parts(spark), F.col("k").asc_nulls_first(), "h").sortWithinPartitions(F.col("k").asc_nulls_first(), "h")
    out = cut(dealt.mapInArrow(tidy(paired), result).withColumn("part", F.spark_partition_id()))
    del small, dealt
    release(spark)
    firsts = out.where("end = 1")
    line = Window.orderBy("part")  # a row for each range
    follows = firsts.select("part").withColumn("then", F.coalesce(F.lead("part").over(line), F.first("part").over(line)))
    ends = out.where("end = 2").select("part", "k", "z").join(follows, "part").join(firsts.select(F.col("part").alias("then"), F.col("z").alias("w")), "then")
    straddle = ends.select("k", "z", "w").mapInArrow(tidy(straddling), result)
    return out.where("end = 0").drop("part").union(straddle).select(*[F.col(a).alias(b) for a, b in zip(["k", "n", "sha", "fp", "efp", "nfp"], names, strict=True)]).withColumnRenamed("k", key)
