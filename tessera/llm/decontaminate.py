"""Benchmark decontamination by a generalised suffix automaton of the items' words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, packed, slices, small_batches, tidy, unused, word_bounds, word_hashes

#: Words of a window, and words of items that one automaton holds: more items make more automata, in blocks.
WINDOW, BLOCK_WORDS = 10, 200_000

#: Lower-case ASCII letters, digits, and all that isn't ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def words_of(text: str | None) -> list[bytes]:
    data, offsets = packed(pa.array([text], pa.string()))
    data = LOWER[data]
    starts, ends, _ = word_bounds(data, offsets, IS_WORD)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


class Automaton:
    """Suffix automaton of several word sequences: a state is a set of substrings with the same ends in the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.step = [0], [-1], [{}]
        self.ends: dict[int, set[str]] = {}  # items that have the state's longest string as a beginning
        self.short: dict[int, list[tuple[int, str]]] = {}
        shorts = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for w in ids:
                last = self._extend(last, w)
                self.ends.setdefault(last, set()).add(name)
            if 0 < len(ids) < window:
                shorts.append((name, ids))
        children: list[list[int]] = [[] for _ in self.length]
        for state, up in enumerate(self.link):
            if up >= 0:
                children[up].append(state)
        self.children = children
        for name, ids in shorts:  # a short item occurs wherever a state at or below its own in the link tree is met
            state = 0
            for w in ids:
                state = self.step[state][w]
            below = [state]
            while below:
                s = below.pop()
                self.short.setdefault(s, []).append((len(ids), name))
                below += children[s]
        self.least = min([window, *[len(ids) for _, ids in shorts]])
        self._items: dict[int, frozenset[str]] = {}
        vocabulary = list(self.vocabulary)
        column = pa.array([*vocabulary, b""], pa.binary())
        data, offsets = packed(column)
        hashes = word_hashes(data, offsets[:-2], offsets[1:-1])
        order = np.argsort(hashes)
        self.hashes, self.by_hash = hashes[order], order
        self.words = vocabulary

    def _extend(self, last: int, w: int) -> int:
        length, link, step = self.length, self.link, self.step
        if w in step[last]:
            to = step[last][w]
            return to if length[to] == length[last] + 1 else self._clone(last, w, to)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        at = last
        while at >= 0 and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if at >= 0:
            to = step[at][w]
            link[new] = to if length[to] == length[at] + 1 else self._clone(at, w, to)
        return new

    def _clone(self, at: int, w: int, to: int) -> int:
        length, link, step = self.length, self.link, self.step
        copy = len(length)
        length.append(length[at] + 1)
        link.append(link[to])
        step.append(dict(step[to]))
        link[to] = copy
        while at >= 0 and step[at].get(w) == to:
            step[at][w] = copy
            at = link[at]
        return copy

    def items(self, state: int) -> frozenset[str]:
        """Items in which the state's strings occur."""
        if state not in self._items:
            found, below = set(), [state]
            while below:
                s = below.pop()
                found |= self.ends.get(s, set())
                below += self.children[s]
            self._items[state] = frozenset(found)
        return self._items[state]

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of words [a, b) inside occurrences of windows, ascending, and the items that have these windows."""
        length, link, step, window, short = self.length, self.link, self.step, self.window, self.short
        state, n, hits, found = 0, 0, [], set()
        for i, w in enumerate(ids):
            while state and w not in step[state]:
                state = link[state]
                n = length[state]
            if w in step[state]:
                state = step[state][w]
                n += 1
            if n >= window:
                hits.append((i + 1 - n, i + 1))
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                found |= self.items(s)
            if state in short:
                for m, name in short[state]:
                    if m <= n:
                        hits.append((i + 1 - m, i + 1))
                        found.add(name)
        return merged(hits), found

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers by hash, -1 for words that no item has."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        sieve = np.zeros(1 << 16, bool)
        sieve[self.hashes >> np.uint64(48)] = True
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(sieve[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        good = self.hashes[at] == hashes[maybe]
        out[maybe[good]] = self.by_hash[at[good]]
        return out

    def scan(self, column: pa.Array) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int]], list[str]]]:
        """For each text: words, hit runs of words, the same as runs of bytes, and items."""
        data, offsets = packed(column)
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, IS_WORD)
        ids = self.known(word_hashes(data, starts, ends))
        edge = np.zeros(len(ids) + 1, bool)
        edge[first] = True
        inside = np.concatenate([[False], ids >= 0, [False]])
        begin = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        long = end - begin >= self.least
        out = [(n, [], [], set()) for n in np.diff(first).tolist()]
        of = np.searchsorted(first, begin[long], "right") - 1
        for doc, a, b in zip(of.tolist(), begin[long].tolist(), end[long].tolist(), strict=True):
            hits, found = self.stream(ids[a:b].tolist())
            if hits and any(data[starts[a + i] : ends[a + i]].tobytes() != self.words[ids[a + i]] for x, y in hits for i in range(x, y)):
                hits, found = self._exactly([data[starts[i] : ends[i]].tobytes() for i in range(a, b)])
            base, at = first[doc], offsets[doc]
            for x, y in hits:
                out[doc][1].append((int(a + x - base), int(a + y - base)))
                out[doc][2].append((int(starts[a + x] - at), int(ends[a + y - 1] - at)))
            out[doc][3].update(found)
        return [(n, h, s, sorted(f)) for n, h, s, f in out]

    def _exactly(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """As stream(), by the words themselves: two words shared a hash."""
        hits, found, a = [], set(), 0
        ids = [self.vocabulary.get(w, -1) for w in words] + [-1]
        for i, w in enumerate(ids):
            if w < 0:
                h, f = self.stream(ids[a:i])
                hits += [(a + x, a + y) for x, y in h]
                found |= f
                a = i + 1
        return hits, found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of [a, b) runs as ascending runs that don't overlap (those that touch stay apart unless they overlap)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


RUNS = "array<struct<a: long, b: long>>"


def _lists(rows: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.array([[{"a": a, "b": b} for a, b in r] for r in rows], kind)


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_key: str = "item_id", item_text: str = "text", into: str = "leak") -> DataFrame:
    """docs with a column `into`, in place of one of that name: n_words, words (hit runs of words), spans (the same as runs of UTF-8 bytes), items.

    A word is hit inside any occurrence of a window: `window` consecutive words of an item, or a whole shorter item.
    Texts are streamed whole through the automaton, which tracks the longest match that ends at each word; words that
    no item has reset it and are skipped at once. Items go to the tasks in blocks of BLOCK_WORDS words (a longer item
    makes a block of its own), each an automaton, so what a task holds does not grow with the items.

    Null or wordless texts: no words, no hits; so are such items. Repeated items count once by their key. Items are
    named by their key as a string, null as `null`. Either table may be empty. Null and repeated keys of documents don't matter: each row is marked by itself.
    Very long texts are streamed whole. Other columns stay as they are."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("i"), b.column("t"), pa.array([len(words_of(x)) for x in b.column("t").to_pylist()], pa.int64())], ["i", "t", "w"])

    named = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"))
    named = named.mapInArrow(tidy(counted), "i string, t string, w long").where("w > 0")
    blocks: list[list[tuple[str, list[bytes]]]] = [[]]
    held = 0
    for r in named.orderBy("i", "t").toLocalIterator():
        if held and held + r.w > BLOCK_WORDS:
            blocks.append([])
            held = 0
        blocks[-1].append((r.i, words_of(r.t)))
        held += r.w
    out, columns = docs, []
    for i, block in enumerate(blocks):
        columns.append(unused(out, f"_leak{i}"))
        out = out.withColumn(columns[-1], _marker(Automaton(block, window))(F.col(text)))
    others = [c for c in docs.columns if c.lower() != into.lower()]
    if len(blocks) == 1:
        return out.select(*others, F.col(columns[0]).alias(into))

    @F.arrow_udf(RUNS)
    def union(column: pa.Array) -> pa.Array:
        return _lists([merged([(x["a"], x["b"]) for x in r or []]) for r in column.to_pylist()])

    every = lambda part: union(F.concat(*[F.col(f"{c}.{part}") for c in columns])).alias(part)
    found = F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}.items") for c in columns]))).alias("items")
    return out.select(*others, F.struct(F.col(f"{columns[0]}.n_words").alias("n_words"), every("words"), every("spans"), found).alias(into))


def _marker(automaton: Automaton):
    @F.arrow_udf(f"struct<n_words: long, words: {RUNS}, spans: {RUNS}, items: array<string>>")
    def marked(column: pa.Array) -> pa.Array:
        batch = pa.record_batch([column], ["text"])
        rows = [r for b in slices(batch) for r in automaton.scan(b.column("text"))]
        parts = [pa.array([r[0] for r in rows], pa.int64()), _lists([r[1] for r in rows]), _lists([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(parts, ["n_words", "words", "spans", "items"])

    return marked


def remove(marked: DataFrame, longest: int = 0, coverage: float = 0.5, text: str = "text", leak: str = "leak") -> DataFrame:
    """The documents of mark() without their leaks: spans of more than `longest` words are cut out of the text, and
    documents of which over `coverage` of the words are hit go. The columns are those that mark() was given.
    Null and wordless texts stay as they are."""
    hit = F.aggregate(f"{leak}.words", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])

    @F.arrow_udf("string")
    def cut_out(column: pa.Array, words: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, w, s in zip(column, words.to_pylist(), spans.to_pylist(), strict=True):
            raw = t.as_py()
            gone = [x for x, y in zip(s, w, strict=True) if y["b"] - y["a"] > longest]
            if gone:
                data, kept, at = raw.encode(), [], 0
                for x in gone:
                    kept.append(data[at : x["a"]])
                    at = x["b"]
                raw = b"".join([*kept, data[at:]]).decode()
            out.append(raw)
        return pa.array(out, pa.string())

    kept = marked.where(hit <= F.col(f"{leak}.n_words") * F.lit(coverage))
    return kept.withColumn(text, F.when(F.size(f"{leak}.words") > 0, cut_out(F.col(text), F.col(f"{leak}.words"), F.col(f"{leak}.spans"))).otherwise(F.col(text))).drop(leak)
