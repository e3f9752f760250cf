"""Token-id files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, tidy
from .tokens import unpack_ids

#: Longest code in bits, ids of a block (the last document goes in whole), and ids between two checkpoints.
LIMIT, BLOCK, LANE = 18, 1 << 19, 256
HEAD = struct.Struct("<4sIQI")
MAGIC = b"TSH1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, merged = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    for level in range(limit):
        if level:
            pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaves, pairs])
            by = np.argsort(both, kind="stable")
            merged, is_leaf = both[by], by < len(leaves)
        levels.append(np.concatenate([[0], np.cumsum(is_leaf)]))
    need, bits = 2 * len(leaves) - 2, np.zeros(len(leaves) + 1, np.int64)
    for chosen in reversed(levels):
        n = chosen[need]
        bits[0] += 1
        bits[n] -= 1
        need = 2 * (need - n)
    out[order] = np.cumsum(bits)[:-1]
    return out


@dataclass
class Code:
    """The canonical code of `lengths`: codes ascend by (length, id)."""

    lengths: np.ndarray

    @cached_property
    def order(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.argsort(self.lengths[used], kind="stable")]

    @cached_property
    def codes(self) -> np.ndarray:
        size = self.lengths[self.order].astype(np.int64)
        span = np.int64(1) << (LIMIT - size)  # of the code space, in codes of LIMIT bits
        out = np.zeros(len(self.lengths), np.uint64)
        out[self.order] = ((np.cumsum(span) - span) >> (LIMIT - size)).astype(np.uint64)
        return out

    @cached_property
    def table(self) -> np.ndarray:
        """By the next LIMIT bits: id * 32 + length."""
        size = self.lengths[self.order].astype(np.int64)
        filled = np.repeat((self.order.astype(np.uint32) << np.uint32(5)) | size.astype(np.uint32), np.int64(1) << (LIMIT - size))
        return np.concatenate([filled, np.full((1 << LIMIT) - len(filled), 1, np.uint32)])

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bits as 64-bit words, high bit first, and the bit offset of every LANE-th id."""
        size = self.lengths[ids].astype(np.int64)
        if len(size) and not size.min():
            raise ValueError("an id without a code")
        at = np.cumsum(size) - size
        total = int(at[-1] + size[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        if len(ids):
            code, word = self.codes[ids], at >> 6
            room = 64 - (at & 63) - size
            high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] |= np.bitwise_or.reduceat(high, first)
            over = np.flatnonzero(room < 0)  # one at most for each word
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words, at[::LANE]

    def unpack(self, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """n ids, LANE from each bit offset, all lanes in step."""
        out = np.empty((len(at), LANE), np.uint16)
        words = np.concatenate([words, np.zeros(1, np.uint64)])
        at, top, drop = at.astype(np.int64).copy(), len(words) - 2, np.uint64(64 - LIMIT)
        for k in range(LANE if n >= LANE else n):
            word, bit = np.minimum(at >> 6, top), (at & 63).astype(np.uint64)
            # two shifts, since one by 64 bits is undefined
            ahead = (words[word] << bit) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))
            entry = self.table[(ahead >> drop).astype(np.int64)]
            out[:, k] = entry >> np.uint32(5)
            at += (entry & np.uint32(31)).astype(np.int64)
        return out.reshape(-1)[:n] if n >= LANE else out[:, :n].reshape(-1)[:n]


def encode_block(code: Code, ids: np.ndarray, sizes: list[int]) -> bytes:
    """Header (magic, documents, ids, checkpoints), documents' sizes, checkpoints, bits."""
    words, at = code.pack(ids)
    return b"".join([HEAD.pack(MAGIC, len(sizes), len(ids), len(at)), np.array(sizes, "<u8").tobytes(), at.astype("<u8").tobytes(), words.astype(">u8").tobytes()])


def decode_block(code: Code, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the documents' sizes)."""
    magic, n_docs, n, lanes = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    a = HEAD.size
    b, c = a + 8 * n_docs, a + 8 * n_docs + 8 * lanes
    sizes, at = np.frombuffer(raw, "<u8", n_docs, a), np.frombuffer(raw, "<u8", lanes, b)
    words = np.frombuffer(raw, ">u8", -1, c).astype(np.uint64)
    return code.unpack(words, at, n), sizes.astype(np.int64)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows. Each task sums before the shuffle; the result has a row for each id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            some = [unpack_ids(z) for z in b.column("z").to_pylist()]
            total += np.bincount(np.concatenate(some), minlength=1 << 16) if some else 0
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    rows = tokens.select("z").mapInArrow(tidy(counted), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_ids(tokens: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the ids of token_rows under `path`, in ascending order of the key (null first, repeated keys by `h`).

    `path`/code has the code lengths, `path`/blocks a row for each block: part, block, n, the documents' keys, data.
    Parts are ranges of the key in order, and blocks count up inside a part; each can be decoded alone."""
    spark = tokens.sparkSession
    code = Code(code_lengths(id_counts(tokens)))
    spark.createDataFrame([(LIMIT, bytearray(code.lengths.tobytes()))], "max_bits int, lengths binary").coalesce(1).write.parquet(f"{path}/code")
    kind = dict(tokens.dtypes)[key]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, key_type, number = [], [], None, 0

        def done() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            data = encode_block(code, all_ids, [len(x) for x in ids])
            lists = pa.array([keys], pa.list_(key_type))
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([len(all_ids)], pa.int64()), lists, pa.array([data], pa.binary())], ["block", "n", "keys", "data"])

        held = 0
        for b in batches:
            key_type = b.schema.field("k").type
            for k, z in zip(b.column("k").to_pylist(), b.column("z").to_pylist(), strict=True):
                keys.append(k)
                ids.append(unpack_ids(z))
                held += len(ids[-1])
                if held >= BLOCK:
                    yield done()
                    keys, ids, held, number = [], [], 0, number + 1
        if keys:
            yield done()

    order = [F.col("k").asc_nulls_first(), F.col("h")]
    dealt = tokens.select(F.col(key).alias("k"), "h", "z").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    out = dealt.mapInArrow(tidy(blocks), f"block long, n long, keys array<{kind}>, data binary").withColumn("part", F.spark_partition_id())
    out.write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The documents of the files under `path`: key, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are decoded alone, in any order; where a block starts comes from the counts that stand beside the blocks."""
    code = Code(np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()["lengths"]), np.uint8))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, sizes = decode_block(code, b.column("data")[i].as_py())
                ends = np.cumsum(sizes)
                raw, at = memoryview(ids.astype("<u4").tobytes()), (ends - sizes).tolist()
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at, ends.tolist(), strict=True)]
                n = len(sizes)
                same = lambda c: pa.array([b.column(c)[i].as_py()] * n, b.schema.field(c).type)
                yield pa.record_batch([b.column("keys")[i].values, same("part"), same("block"), pa.array(at, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64())], ["k", "part", "block", "at", "size", "crc"])

    # parts' totals are as many as the ranges; blocks are placed inside their part
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    starts = blocks.select("part", "block", inside.alias("inside")).join(F.broadcast(ahead), "part").select("part", "block", (F.col("inside") + F.col("ahead")).alias("first"))
    docs = blocks.select("part", "block", "keys", "data").mapInArrow(tidy(decoded), f"k {kind}, part int, block long, at long, size long, crc long")
    return docs.join(starts, ["part", "block"]).select(F.col("k").alias(key), (F.col("first") + F.col("at")).alias("start"), F.col("size").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
