"""The corpus operators against plain rewritings of what they promise, on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import json
import pathlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import decontaminate, fingerprint, huffman, neardup, packing, queries, shard, substrings, tokens, toxicity, warc

SPACES = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture
def tables(spark, monkeypatch):
    """Lets queries read the given rows as a table."""
    held = {}
    monkeypatch.setattr(queries, "read", lambda s, d, name: held[name])

    def put(name, rows, schema):
        held[name] = spark.createDataFrame(rows, schema).repartition(3)

    return put


def collected(df, key="doc_id"):
    rows = df.collect()
    return {r[key]: r for r in rows}, len(rows)


def words(text):
    return SPACES.findall((text or "").encode())


@pytest.fixture(scope="module")
def corpus():
    """Repeats, copies, low entropy, mixed bytes, null, empty."""
    rnd = random.Random(5)
    base = " ".join(rnd.choice(["é", "a", "bb", "ccc"]) for _ in range(2500))
    docs = []
    for i in range(70):
        kind, a = rnd.randrange(6), rnd.randrange(4000)
        docs.append((i, [
            "a " * rnd.randint(0, 300), "z" * rnd.randint(0, 1200), base[a : a + rnd.randint(0, 1500)], base[a : a + 700] + rnd.choice(["", " Q "]) + base[a + 700 : a + 1300],
            "\t\n".join(str(rnd.randrange(3)) for _ in range(rnd.randint(0, 60))), "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 900))),
        ][kind]))
    return [*docs, (500, None), (501, ""), (502, docs[3][1]), (503, "x" * 50_000)]


def test_op1(tables, corpus):
    tables("documents", corpus, "doc_id long, text string")
    got, n = collected(queries.op1_fingerprint_runs(_spark(), ""))
    seen = set()
    for d, t in sorted(corpus):
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), d
    assert n == len(corpus)


def test_op1_batches_agree(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    whole = lambda b: sorted(tuple(r) for r in substrings.without_words(docs, substrings.repeated_words(docs, b), True).collect())
    assert whole(1) == whole(4)


def test_op1_two_jobs_equal_one(spark, corpus, tmp_path):
    """An index that a second job opens from its path, with compacted runs, an empty batch and rows without a key."""
    docs = spark.createDataFrame([*corpus, (None, corpus[2][1])], "doc_id long, text string")
    first, empty, second, third = docs.where("doc_id < 20"), docs.where("doc_id < 0"), docs.where("doc_id >= 20 and doc_id < 45"), docs.where("doc_id >= 45 or doc_id is null")
    index = substrings.FingerprintIndex(spark, str(tmp_path / "index"))
    found = index.ingest(first).union(index.ingest(empty, first))
    index.close(keep=True)
    index = substrings.FingerprintIndex(spark, str(tmp_path / "index"))
    assert len(index.runs) == 1
    found = found.union(index.ingest(second, first))
    assert [r[1] for r in index.runs] == [1]  # two runs of level 0 have become one of level 1
    found = found.union(index.ingest(third, docs.where("doc_id < 45")))
    assert [r[1] for r in index.runs] == [1, 0]
    index.close()
    whole = lambda r: sorted((tuple(x) for x in substrings.without_words(docs, r, True).collect()), key=repr)
    assert whole(found) == whole(substrings.repeated_words(docs, 1))
    assert not list((tmp_path).glob("index/run*"))


def test_op2(tables, corpus):
    tables("documents", corpus, "doc_id long, text string")
    got, n = collected(queries.op2_exact_digest(_spark(), ""))
    texts = [t or "" for _, t in sorted(corpus)]
    for i, (d, _) in enumerate(sorted(corpus)):
        x, after = texts[i], texts[(i + 1) % len(texts)]
        edited = x[: len(x) - len(x) // 2] + after[: len(x) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == float(fingerprint.canonical(x) == fingerprint.canonical(after)) and r.near_edited == float(fingerprint.canonical(x) == fingerprint.canonical(edited))
    assert n == len(corpus) and got[3].fingerprint == got[502].fingerprint and got[502].class_id == 3


def test_op2_collisions_are_told_apart(spark):
    assert fingerprint.canonical("  Ｆoo BAR ") == b"foo bar"
    rows = [(1, "a"), (2, "A "), (3, None), (None, "a"), (4, "b"), (5, "c"), (6, "B"), (7, "aa")]
    same = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.equal_classes(same).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[2].n_class == 3 and got[3].n_class == 1
    # a wide hash of two buckets, by the text's length: a, b and c collide
    got = {r.doc_id: r for r in fingerprint.equal_classes(same, wide_hash=lambda x: f"{len(x) % 2:032}").collect()}
    assert {got[d].digest for d in (1, 2, 4, 5, 6, None)} == {f"{1:032}"} and len({got[d].fingerprint for d in (1, 4, 5, 3, 7)}) == 5
    assert [got[d].class_id for d in (1, 2, 4, 6, 5, 3, 7)] == [1, 1, 4, 4, 5, 3, 7] and got[None].class_id == 1 and got[1].n_class == 3


def test_op3(spark, tables):
    rnd = random.Random(1)
    docs = [(i, rnd.choice(["a", "b", "c", None]) if i % 3 else "hot", " ".join(rnd.choice(["word", "Ünï", "1 2", "\n"]) for _ in range(rnd.choice([0, 5, 300, 3000])))) for i in range(60)] + [(99, "a", None)]
    tables("documents", docs, "doc_id long, source string, text string")
    rows = queries.op3_deficit_round_robin(spark, "").collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    total = 0
    for d, _, x in docs:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    end = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == end and r.offset + r.length <= 2048
        end += r.length
    assert end == total


def test_schedule_with_weights():
    s = packing.Schedule([1000, 50, 5000], [3, 1, 1], 128)
    sent = s.sent(np.arange(s.rounds + 1))
    assert sent[0].tolist() == [0, 0, 0] and sent[-1].tolist() == [1000, 50, 5000] and (np.diff(sent, axis=0) >= 0).all()
    assert abs(sent[5][0] - 3 * sent[5][2]) <= 9
    for q, n in enumerate([1000, 50, 5000]):
        for p in range(0, n, 7):
            r = s.round_of(q, p)
            assert sent[r][q] <= p < sent[r + 1][q]


def test_op4(tables):
    rnd = random.Random(3)
    mk = lambda n: " ".join(rnd.choice([*"abcde", "é", "A", "x1"]) for _ in range(n))
    items = [(i, mk(rnd.randint(0, 25))) for i in range(12)] + [(50, "b a"), (51, None), (52, "zz")]
    docs = [(i, mk(rnd.randint(0, 60)) + rnd.choice(["", " " + items[rnd.randrange(12)][1], ", ZZ!"])) for i in range(80)] + [(900, None), (901, "")]
    tables("documents", docs, "doc_id long, text string")
    tables("benchmark", items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = decontaminate.words_of(t)
        for a in [0] if 0 < len(w) < 10 else range(len(w) - 9):
            windows[tuple(w[a : a + 10])].add(str(i))
    for block in (decontaminate.BLOCK_WORDS, 30):
        decontaminate.BLOCK_WORDS, before = block, decontaminate.BLOCK_WORDS
        got, _ = collected(queries.op4_suffix_automaton(_spark(), ""))
        decontaminate.BLOCK_WORDS = before
        for d, t in docs:
            w = decontaminate.words_of(t)
            hit, found = [False] * len(w), set()
            for k, names in windows.items():
                for a in range(len(w) - len(k) + 1):
                    if tuple(w[a : a + len(k)]) == k:
                        hit[a : a + len(k)], found = [True] * len(k), found | names
            assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256, got[d].contaminated) == (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))


def test_op5(tables, corpus):
    tables("documents", corpus, "doc_id long, text string")
    got, n = collected(queries.op5_canonical_huffman(_spark(), ""))
    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for d, x in sorted(corpus):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert n == len(corpus)


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5000])
def test_huffman_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.2, n) - 1, 40_000).astype(np.uint16)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=1 << 16)))
    assert (2.0 ** -code.lengths[code.lengths > 0].astype(float)).sum() <= 1 and code.lengths.max(initial=0) <= huffman.LIMIT
    back, sizes = huffman.decode_block(code, huffman.encode_block(code, ids, [n]))
    assert back.tolist() == ids.tolist() and sizes.tolist() == [n]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(spark, sf_dir, name):
    rnd = random.Random(2)
    some = ["a", "B", "word", "Été,", "İ", "'s", " ", "  ", "\n", "\t", "é", "\u0301", "\x85", "\xa0", "\u3000", "1", "23", "²", "½x", "...", "<|endoftext|>", "Σς", "漢", "😀", "\x1c", "re", "don't", "x" * 70, "«", "ª", "ǅ", "_", "\x00"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 25))) for _ in range(6000)] + ["y" * 300_000, "z " * 3000, " " * 300_000, "\n " * 9000 + "x", "=" * 20_000]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0xD800), 32, 10])) for _ in range(40)) for _ in range(3000)]
    texts += [r.text or "" for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").collect()]
    c = tokens.TextCoder(public_tokenizers.path(name))
    assert c.merge
    want = c.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in c.encode(texts)] == [e.ids for e in want]


def test_other_files_go_to_the_library(tmp_path):
    """A file whose ids aren't in the order of its merges, and one with another pattern."""
    file = json.loads(pathlib.Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    merges = file["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    (tmp_path / "a.json").write_text(json.dumps(file))
    file["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "b.json").write_text(json.dumps(file))
    for f in ("a.json", "b.json"):
        c = tokens.TextCoder(str(tmp_path / f))
        assert c.merge is None and c.encode([*tokens.PROOF]) == c.library([*tokens.PROOF])


def test_op6(spark, corpus):
    docs = spark.createDataFrame([*corpus, (502, corpus[3][1]), (None, "n")], "doc_id long, text string")
    rows = shard.shard_by_size(docs.withColumnRenamed("text", "text")).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for d, t in [*corpus, (502, corpus[3][1]), (None, "n")])
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert shard.shard_by_size(docs.limit(0)).count() == 0


def test_op7(tables, corpus):
    tables("documents", corpus, "doc_id long, text string")
    got, n = collected(queries.op7_prefix_free_parsing(_spark(), ""))
    seen = collections.Counter()
    raw = {d: (t or "").encode() for d, t in corpus}
    for b in raw.values():
        seen.update(hash(b[a : a + 400]) for a in range(len(b) - 399))
    for d, b in raw.items():
        gone, reach = bytearray(len(b)), 0
        for a in range(len(b) - 399):
            if seen[hash(b[a : a + 400])] > 1:
                gone[max(a, reach) : a + 400] = b"\1" * (a + 400 - max(a, reach))
                reach = a + 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()), d
    assert n == len(corpus)


def test_first_occurrence_stays(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.without_bytes(docs, substrings.repeated_bytes(docs, earlier=True), True).collect()}
    seen = set()
    for d, t in sorted(corpus):
        b, gone = (t or "").encode(), 0
        reach = 0
        for a in range(len(b) - 399):
            if b[a : a + 400] in seen:
                gone, reach = gone + a + 400 - max(a, reach), a + 400
            seen.add(b[a : a + 400])
        assert got[d].n_removed == gone, d


def test_op8(tables):
    rnd = random.Random(7)

    def edit(w, m):
        w = list(w)
        for _ in range(m):
            w[rnd.randrange(len(w))] = str(rnd.randrange(10**6))
        return w

    base = [[str(rnd.randrange(10**6)) for _ in range(rnd.randint(30, 150))] for _ in range(5)]
    docs = []
    for i in range(120):
        b = rnd.choice(base)
        docs.append((i, " ".join(edit(b, rnd.randint(0, max(1, len(b) // 25))))))
    docs += [(1000, None), (1001, ""), (1002, "A b"), (1003, "a B"), (1004, "a b c")] + [(2000 + i, "x " * i) for i in range(12)]
    tables("documents", docs, "doc_id long, text string")
    got, n = collected(queries.op8_coordinate_join(_spark(), ""))
    sets = {}
    for d, t in docs:
        w = SPACES.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert n == len(docs)
    for d in sets:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), find(d), find(d) == d)


@pytest.mark.parametrize(("sf", "recall"), [("sf0.1", 0.9), ("sf0.01", 0.6)])
def test_op9_held_out(spark, sf_dir, sf, recall):
    """Recall of toxic rows grows with the labels: 2,650 of them here, or 265."""
    big = sf_dir.replace("sf0.001", sf)
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels.where("doc_id % 3 <> 0"), queries.CATEGORIES)
    held = toxicity.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), chain).selectExpr("toxic", "toxicity.toxic as p").collect()
    toxic = [r.p >= chain.cuts[-1] for r in held if r.toxic]
    clean = [r.p >= chain.cuts[-1] for r in held if not r.toxic]
    assert sum(toxic) >= recall * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_op9_scores_by_brute_force(spark):
    """The chain's probabilities from its weights, one feature at a time."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["fool", "idiot", "Garden", "été", "x1"] if i % 4 == 0 else ["rose", "Garden", "été", "x1"]) for _ in range(rnd.randint(3, 20)))) for i in range(200)] + [(900, None), (901, ""), (None, "fool idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(200)] + [(5, 1, 0), (5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels, queries.CATEGORIES)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, chain).collect()}
    for d, text in rows:
        _, found = toxicity.features(toxicity.pa.array([text], toxicity.pa.string()))
        has, early = sorted(set(found.tolist()) & set(chain.known.tolist())), []
        for w, b in zip(chain.weights, chain.bias, strict=True):
            z = b + sum(w[chain.known.tolist().index(f)] for f in has) + sum(w[len(chain.known) + i] * p for i, p in enumerate(early))
            early.append(1 / (1 + np.exp(-z)))
        assert np.allclose(early, [got[d].low_quality, got[d].toxic])
    assert got[0].toxic > chain.cuts[-1] > got[1].toxic


def test_op9_without_labels_or_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels, queries.CATEGORIES)
    assert [r.toxicity.toxic < 0.01 for r in toxicity.score(docs, chain).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_op10(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u", "a WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nzz" + "é" * 900), (5, "u\r\nx", ""), (6, "v", "short"), (7, "v", "short"), (8, "w", big), (9, "w", "WARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for k, (packed, split) in enumerate([("gzip", before), ("none", "700")]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            warc.write_archives(pages, str(tmp_path / str(k)), compression=packed)
            got, n = collected(warc.read_archives(spark, str(tmp_path / str(k))), "record_id")
            assert n == len(rows)
            for i, _, html in rows:
                r, body = got[f"<urn:page:{i}>"], (html or "").encode()
                again = html == big and i != 8
                assert (r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) == (hashlib.sha1(body).hexdigest(), len(body), "revisit" if again else "response", "<urn:page:8>" if again else None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_tables(spark, tables):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        tables(name, [], schema)
    for f in queries.QUERIES.values():
        assert f(spark, "").count() == 0, f.__name__


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.k: r.comp for r in neardup.components(chain).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.active()
