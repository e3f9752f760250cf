"""Near-duplicate documents by an inverted join of MinHash coordinates, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORDS, cut, mix, packed, parts, prefix_hash, release, run_hash, slices, small_batches, tidy, word_bounds, word_hashes

#: Words of a shingle; coordinates of a signature, and how many of them must agree. Two sets at a similarity of 0.75
#: agree in 48 of 64 on average, and in fewer than 24 with a chance of 4e-11 (the binomial tail), more alike ones less.
SHINGLE, COORDINATES, MATCHES = 5, 64, 24
#: Links hold where 100 * intersection >= SHARE * union.
SHARE = 75
#: Classes of a block, of which two at a time are compared, and shingles of a slice of their incidence matrix.
BLOCK, SLICE = 64, 1 << 15

_odd = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
FACTOR, SHIFT = _odd[:COORDINATES] | np.uint64(1), _odd[COORDINATES:]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    data, offsets = packed(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, SPACE_WORDS)
    h = prefix_hash(word_hashes(data, starts, ends))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        lo = np.arange(a, max(b - SHINGLE, a) + 1) if b > a else np.arange(0)
        out.append(np.unique(run_hash(h, lo, np.minimum(lo + SHINGLE, b))))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    return np.array([(shingles * f + s).min() for f, s in zip(FACTOR, SHIFT, strict=True)], np.uint64)


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, n, sid (digest of the set), sig: the coordinates of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "t"):
                sets = shingle_sets(b.column("t"))
                n = np.array([len(s) for s in sets])
                sig = np.zeros((len(sets), COORDINATES), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    at = np.cumsum(n[some]) - n[some]
                    for j in range(COORDINATES):
                        sig[some, j] = np.minimum.reduceat(flat * FACTOR[j] + SHIFT[j], at)
                sid = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.record_batch([b.column("k"), pa.array(n), sid, pa.array([r.tobytes() for r in sig], pa.binary())], ["k", "n", "sid", "sig"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidy(rows), f"k {kind}, n long, sid binary, sig binary")


def postings(classes: DataFrame) -> DataFrame:
    """p, k, n: each set's representative under each coordinate and value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(77))
        for big in batches:
            for i in range(0, big.num_rows, 2048):
                b = big.slice(i, 2048)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(-1, COORDINATES)
                take = pa.array(np.repeat(np.arange(b.num_rows), COORDINATES))
                yield pa.record_batch([pa.array(mix(sig ^ salt).reshape(-1).view(np.int64)), b.column("k").take(take), b.column("n").take(take)], ["p", "k", "n"])

    return classes.select("k", "n", "sig").mapInArrow(tidy(rows), f"p long, k {dict(classes.dtypes)['k']}, n long")


def shingle_postings(texts: DataFrame) -> DataFrame:
    """p, k, n: as postings(), under the shingles themselves, from the packed texts (k, z)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for big in batches:
            for i in range(0, big.num_rows, 256):
                b = big.slice(i, 256)
                sets = shingle_sets(pa.array([unpack(z) for z in b.column("z").to_pylist()], pa.binary()))
                n = np.array([len(s) for s in sets])
                take = np.repeat(np.arange(b.num_rows), n)
                yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64)), b.column("k").take(pa.array(take)), pa.array(n[take])], ["p", "k", "n"])

    return texts.select("k", "z").mapInArrow(tidy(rows), f"p long, k {dict(texts.dtypes)['k']}, n long")


def rarest(post: DataFrame, matches: Column, as_smaller: Column | None = None) -> DataFrame:
    """p, k, n, pop, small: of each class the postings that it must share one of with any class that it shares `matches`
    with; `small` where that holds for `as_smaller` too, the matches that it needs with a class of its size or larger.

    Postings of one class alone are dropped, then classes with fewer than `matches` left; of the m left, ordered by how
    few classes a posting has, the first m - matches + 1 suffice. pop: classes in all its m postings."""
    freq = cut(post.groupBy("p").agg(F.count("*").alias("f")).where("f > 1"))  # cut, so that the join can split a hot posting
    per = Window.partitionBy("k")
    met = post.join(freq, "p").withColumns({"m": F.count("*").over(per), "pop": F.sum("f").over(per)}).where(F.col("m") >= matches)
    met = met.withColumn("r", F.row_number().over(per.orderBy("f", "p"))).where(F.col("r") <= F.col("m") - matches + 1)
    return met.select("p", "k", "n", "pop", (F.col("r") <= F.col("m") - (matches if as_smaller is None else as_smaller) + 1).alias("small"))


def components(edges: DataFrame) -> DataFrame:
    """k, comp: the smallest key that the edges (u, v) reach from each of their ends. Stars of large and of small
    neighbours alternate until nothing changes; neighbours are never gathered, only their minimum is."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        # done where each key points to one root
        once = e.groupBy("u").agg(F.count("*").alias("n"))
        if e.select(F.col("v").alias("u")).join(once, "u", "left_semi").isEmpty() and once.where("n > 1").isEmpty():
            return e.select(F.col("u").alias("k"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("k"), F.col("v").alias("comp")).distinct())


def _blocks(members: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """u, v: links between the components of each group of members (k, comp, n, g), enough to join all that are linked.

    A group's members are dealt by size class (sizes within a class and its neighbour alone allow a link) and, inside a
    class, by a hash of their keys into blocks of about BLOCK; only their counts are gathered. Two blocks whose sizes allow
    a link are compared at once, by products of slices of their shingles' incidence matrices. A task holds two blocks, and
    emits a forest of links at most."""
    m = members.withColumn("size", F.floor(F.log("n") / F.lit(math.log(100 / SHARE)) + 1e-9))
    many = cut(m.groupBy("g", "size").agg(F.ceil(F.count("*") / BLOCK).alias("of")))
    m = m.join(many, ["g", "size"]).withColumn("b", F.pmod(F.xxhash64("k"), F.col("of")))
    blocks = cut(m.join(texts.select("k", "z"), "k").groupBy("g", "size", "b").agg(F.collect_list(F.struct("k", "comp", "z")).alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    span = blocks.select("g", "size", "b", "lo", "hi")
    after = span.select("g", F.col("size").alias("size2"), F.col("b").alias("c"), F.col("lo").alias("clo"), F.col("hi").alias("chi"))
    fits = (F.col("hi") * 100 >= F.col("clo") * SHARE) & (F.col("chi") * 100 >= F.col("lo") * SHARE)
    near = span.join(after, "g").where((F.struct("size", "b") <= F.struct("size2", "c")) & fits).select("g", "size", "b", "size2", "c")
    both = near.join(blocks.select("g", "size", "b", "d"), ["g", "size", "b"]).join(blocks.select("g", F.col("size").alias("size2"), F.col("b").alias("c"), F.col("d").alias("e")), ["g", "size2", "c"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for big in batches:
            for i in range(big.num_rows):
                d, e = big.column("d")[i].as_py(), big.column("e")[i].as_py()
                rows = d if [x["k"] for x in d] == [x["k"] for x in e] else d + e
                sets = shingle_sets(pa.array([unpack(x["z"]) for x in rows], pa.binary()))
                n = np.array([len(s) for s in sets])
                flat, of = np.concatenate(sets), np.repeat(np.arange(len(rows)), n)
                order = np.argsort(flat, kind="stable")
                flat, of = flat[order], of[order]
                at = np.cumsum(np.diff(flat, prepend=flat[:1]) != 0)
                both = np.zeros((len(rows), len(rows)), np.int64)
                for lo in range(0, int(at[-1]) + 1, SLICE):  # so many shingles at a time, however long the texts
                    part = slice(*np.searchsorted(at, [lo, lo + SLICE]))
                    has = np.zeros((SLICE, len(rows)), np.float32)
                    has[at[part] - lo, of[part]] = 1
                    both += np.rint(has.T @ has).astype(np.int64)
                linked = 100 * both >= SHARE * (n[:, None] + n[None, :] - both)
                root: dict = {}

                def find(x, root=root):
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                found = []
                for x, y in zip(*[r.tolist() for r in np.nonzero(np.triu(linked, 1))], strict=True):
                    p, q = find(rows[x]["comp"]), find(rows[y]["comp"])
                    if p != q:
                        root[p] = q
                        found.append((rows[x]["k"], rows[y]["k"]))
                kinds = big.schema.field("d").type.value_type.field("k").type
                yield pa.record_batch([pa.array([f[j] for f in found], kinds) for j in (0, 1)], ["u", "v"])

    spark = members.sparkSession
    return both.select("d", "e").repartition(parts(spark)).mapInArrow(tidy(compared), f"u {kind}, v {kind}")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept: documents linked by a shingle similarity of 0.75 or more, transitively.

    Documents with equal sets are one class, whose smallest key stands for it. Each class is posted under its 64
    (coordinate, value) pairs; prefixes of the rarest postings (see rarest()) leave the classes that can meet at all.
    For these alone the same is done with the shingles themselves: linked sets share three quarters of the larger and six
    sevenths of the smaller, so that a passage that many documents share brings together only those that it fills.

    In each posting a centre, the class that most others share postings with, is compared with the others: sizes first,
    then the count of agreeing coordinates, then the full sets. Postings that then lie in one component are done with.
    The classes of the others, which are near misses for the most part, are compared in blocks; blocks are joined, not
    classes, and no link is given up for a group's size.

    Fewer than five words: the whole sequence is the one shingle; no words or null text: an empty set, linked with
    nothing. A repeated key stands for one document. A null key is linked with nothing, and kept. Empty table: no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[key]
    all_docs = cut(described(docs, key, text))
    classes = cut(all_docs.where("n > 0 and k is not null").groupBy("sid").agg(F.min(F.struct("k", "n", "sig")).alias("x")).select("sid", "x.*"))
    involved = cut(rarest(postings(classes), F.lit(MATCHES)).select("k").distinct())
    release(spark)

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.record_batch([b.column("k"), pa.array([pack((x or "").encode()) for x in b.column("t").to_pylist()], pa.binary())], ["k", "z"])

    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidy(squeezed), f"k {kind}, z binary")
    texts = cut(texts.join(involved, "k").join(classes.select("k", "sig"), "k").dropDuplicates(["k"]))
    release(spark)
    met = cut(rarest(shingle_postings(texts), F.ceil(F.col("n") * SHARE / 100), F.ceil(F.col("n") * 2 * SHARE / (100 + SHARE))))
    release(spark)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        centre, own = None, None
        for big in batches:
            for i in range(0, big.num_rows, 512):
                b = big.slice(i, 512)
                sig = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, COORDINATES) for c in ("sig", "csig")]
                close = np.flatnonzero((sig[0] == sig[1]).sum(1) >= MATCHES)
                good = []
                others = shingle_sets(pa.array([unpack(b.column("z")[j].as_py()) for j in close.tolist()], pa.binary()))
                for j, other in zip(close.tolist(), others, strict=True):
                    c = b.column("c")[j].as_py()
                    if centre != c:
                        centre, own = c, shingle_sets(pa.array([unpack(b.column("cz")[j].as_py())], pa.binary()))[0]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= SHARE * (len(own) + len(other) - both):
                        good.append(j)
                take = pa.array(good, pa.int64())
                yield pa.record_batch([b.column("c").take(take), b.column("k").take(take)], ["u", "v"])

    def confirm(pairs: DataFrame) -> DataFrame:
        right = texts.select(F.col("k").alias("c"), F.col("z").alias("cz"), F.col("sig").alias("csig"))
        return cut(pairs.join(texts, "k").join(right, "c").select("c", "k", "z", "cz", "sig", "csig").mapInArrow(tidy(confirmed), f"u {kind}, v {kind}"))

    fit = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * SHARE
    fit = fit & F.when(F.col("n") < F.col("cn"), F.col("small")).when(F.col("n") > F.col("cn"), F.col("csmall")).otherwise(F.col("small") | F.col("csmall"))
    # first a centre for each posting, the same in all postings of a group, so that few pairs are compared twice
    left = met.join(met.groupBy("p").agg(F.max(F.struct("pop", "k", "n", "small")).alias("x")), "p")
    pairs = left.withColumns({"c": F.col("x.k"), "cn": F.col("x.n"), "csmall": F.col("x.small")}).where("c <> k").where(fit).select("c", "k").distinct()
    links = confirm(pairs)
    labels = components(links)
    left = met.join(labels, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    span = left.groupBy("p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("small").alias("any"), F.min("k").alias("least")).where("lo <> hi and any")
    left = cut(left.join(span.select("p", "least"), "p").select("k", "comp", "n", "least").distinct())
    release(spark)
    if not left.isEmpty():
        groups = components(left.select(F.col("k").alias("u"), F.col("least").alias("v")))
        members = left.select("k", "comp", "n").distinct().join(groups.withColumnRenamed("comp", "g"), "k")
        links = cut(links.union(_blocks(members, texts, kind)))
        labels = components(links)
    named = classes.select("sid", "k").join(labels, "k", "left").select("sid", F.coalesce("comp", "k").alias("comp"))
    out = all_docs.select("k", "n", "sid").join(named, "sid", "left")
    component = F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.col("comp")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"))
