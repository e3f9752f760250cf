"""Null and repeated keys, columns of clashing names and long texts, for all corpus operators; the pipeline by brute force."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, fingerprint, huffman, neardup, packing, shard, substrings, tokens, toxicity, warc

#: Names that operators use inside, or give to their results.
CLASH = ["k", "t", "g", "c", "n", "h", "at", "start", "leak", "_leak0", "toxicity", "size", "shard", "text_crc32", "fold", "idx"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated keys, null and empty texts, ties, a text of 60,000 words, and columns whose names clash."""
    rnd = random.Random(9)
    prose = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    same, long = prose(120), prose(60_000)
    rows = [(1, same), (2, same), (2, same), (None, same), (3, None), (None, None), (4, ""), (5, long), (6, prose(40)), (6, prose(30)), (7, same + " " + prose(4))]
    frame = spark.createDataFrame([(i, "s", t) for i, t in rows], "doc_id long, source string, text string")
    return rows, frame.withColumns({c: F.lit(f"own {c}") for c in CLASH}).cache()


def kept_columns(before, after):
    return all(c in after.columns for c in before.columns if c != "text") and after.where(" or ".join(f"`{c}` <> 'own {c}'" for c in CLASH if c in after.columns)).isEmpty()


def test_substrings(odd):
    rows, docs = odd
    for digest, strip, runs in ((True, substrings.without_words, substrings.repeated_words(docs)), (False, substrings.without_bytes, substrings.repeated_bytes(docs))):
        out = strip(docs, runs, digest=False)
        assert out.count() == len(rows) and kept_columns(docs, out)
    got = {r.doc_id: r for r in substrings.without_bytes(docs.select("doc_id", "text"), substrings.repeated_bytes(docs), digest=True).collect()}
    assert got[2].n_removed > 400 and got[5].n_removed == 0 and got[None].n_removed == 0 and got[4].n_bytes == 0


def test_keyed_operators(spark, odd):
    rows, docs = odd
    near = neardup.near_components(docs).collect()
    assert len(near) == len(rows) and {r.component_id for r in near if r.doc_id in (1, 2, 7)} == {1} and all(r.kept for r in near if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in near if r.doc_id in (3, 4, 5))
    classes = fingerprint.equal_classes(docs).collect()
    assert len(classes) == len(rows) and {r.class_id for r in classes if r.doc_id == 2} == {1}
    pairs = fingerprint.edited_pairs(docs).collect()
    assert len(pairs) == len(rows) and max(r.n_chars for r in pairs) == len(rows[7][1])
    shards = shard.shard_by_size(docs).collect()
    assert len(shards) == len(rows) and sorted({r.law for r in shards}) == ["bytes"]


def test_tokens(spark, odd):
    rows, docs = odd
    ids = tokens.token_rows(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1, keep=["doc_id", "source"])
    assert ids.count() == len(rows) and sorted(r.n for r in ids.collect())[:3] == [1, 1, 1]
    pieces = packing.pack(ids).collect()
    total = sum(r.n for r in ids.collect())
    assert sum(r.length for r in pieces) == total and sorted((r.sequence_id, r.offset) for r in pieces)[-1][0] == (total - 1) // 2048
    path = common.scratch(spark, "ids")
    huffman.write_ids(ids, path)
    back = huffman.read_ids(spark, path).collect()
    assert len(back) == len(rows) and sum(r.n_tokens for r in back) == total
    common.delete(spark, path)


def test_light_source(spark):
    """A source with a hundred-thousandth of the ids: its document spans almost all rounds."""
    docs = spark.createDataFrame([(i, "big", "word " * 4000) for i in range(120)] + [(1000, "light", "a b c d")], "doc_id long, source string, text string")
    pieces = packing.pack(tokens.token_rows(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1, keep=["doc_id", "source"])).collect()
    light = [r for r in pieces if r.doc_id == 1000]
    assert sum(r.length for r in light) == light[0].doc_tokens and max(r.sequence_id for r in light) > 100


def test_columns_of_marks_and_scores(spark, odd):
    rows, docs = odd
    items = spark.createDataFrame([(1, " ".join(rows[0][1].split()[:12])), (1, None), (None, "w1")], "item_id long, text string")
    marked = decontaminate.mark(docs.drop("leak"), items)
    assert marked.count() == len(rows) and kept_columns(docs.drop("leak"), marked.drop("leak"))
    assert decontaminate.remove(decontaminate.mark(docs, items, into="mine"), leak="mine").columns == docs.columns
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 0), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels, {"low_quality": "quality = 0", "toxic": "toxic = 1"})
    scored = toxicity.score(docs.drop("toxicity"), chain)
    assert scored.count() == len(rows) and kept_columns(docs.drop("toxicity"), scored.drop("toxicity"))


def test_archives(spark, tmp_path):
    big = "é" * 300_000
    pages = spark.createDataFrame([(1, "u", big), (1, "u", big), (None, None, big), (None, "v", None), (2, "w", "x")], "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("k", "u", "body", "digest", "salt", "keeper")})
    warc.write_archives(pages, str(tmp_path / "a"))
    got = [(r.record_id, r.record_type, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()]
    assert len(got) == 5 and sorted(n for _, _, n in got) == [0, 1, 600_000, 600_000, 600_000]


def test_a_cluster_without_a_shared_folder_is_told(spark):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(key, default):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def brute_stages(docs, items):
    """Near-duplicates, repeats and benchmark windows of small documents by comparing everything with everything."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = {d: t for d, t in docs.items() if find(d) == d}
    yield dict(docs)
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        gone = [False] * len(raw)
        for a in range(len(raw) - 239):
            if raw[a : a + 240] in seen:
                gone[a : a + 240] = [True] * 240
            seen.add(raw[a : a + 240])
        for i in range(len(words) - 50):
            key = tuple(raw[a:b] for a, b in words[i : i + 51])
            if key in seen:
                a, b = words[i][0], words[i + 50][1]
                gone[a:b] = [True] * (b - a)
            seen.add(key)
        out[d] = docs[d] if not any(gone) else bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode()
    docs = out
    yield dict(docs)
    windows = {}
    for t in items:
        w = decontaminate.words_of(t)
        for i in [0] if 0 < len(w) < 10 else range(len(w) - 9):
            windows[tuple(w[i : i + 10])] = 1
    out = {}
    for d, t in docs.items():
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))]
        w = decontaminate.words_of(t)
        hit = [False] * len(w)
        for k in windows:
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit[i : i + len(k)] = [True] * len(k)
        if sum(hit) > 0.5 * len(w):
            continue
        text, i = t, len(w)
        while i:
            j = i
            while j and hit[j - 1]:
                j -= 1
            if j < i:
                text = text[: spans[j][0]] + text[spans[i - 1][1] :]
            i = j if j < i else i - 1
        out[d] = text
    yield out


def test_pipeline_by_brute_force(spark, monkeypatch):
    rnd = random.Random(12)
    prose = lambda n: " ".join(rnd.choice(["ab", "xy", "Q"]) + str(rnd.randrange(10**5)) for _ in range(n))
    shared, item = prose(70), prose(14)
    docs = {i: prose(rnd.randint(0, 150)) for i in range(30)}
    docs |= {100: docs[3] + " end", 101: docs[3], 102: f"{prose(80)} {shared} {prose(60)}", 103: f"{prose(60)} {shared}, {prose(80)}", 104: f"{prose(90)} {item} {prose(20)}", 105: item + " " + prose(3), 106: None, 107: ""}
    held = {"benchmark": spark.createDataFrame([(1, item), (2, "zz zz zz")], "item_id long, text string")}
    monkeypatch.setattr(corpus_pipeline, "read", lambda s, d, name: held[name])
    frame = spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id long, text string").withColumn("lang", F.lit("x"))
    for stage, want in zip((corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats, corpus_pipeline.cut_benchmark), brute_stages(docs, [item, "zz zz zz"]), strict=True):
        frame = stage(spark, frame, "").cache()
        got = {r.doc_id: r.text for r in frame.collect()}
        assert set(got) == set(want) and got == want, stage.__name__
    empty = frame.limit(0)
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats, corpus_pipeline.cut_benchmark):
        assert stage(spark, empty, "").count() == 0
