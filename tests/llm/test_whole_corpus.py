"""Whole jobs of the corpus operators."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import public_tokenizers

from tessera.llm import packing
from tessera.llm.tokens import token_rows


def packed(spark, docs, length, mixture=None):
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    return packing.pack(token_rows(frame, public_tokenizers.path("byte_bpe_50k.json"), end=1, keep=["doc_id", "source"]), length, mixture)


def test_every_source_has_its_queue(spark):
    rnd = random.Random(2)
    docs = [(i, f"web{i % 300}", "word " * rnd.randint(1, 9)) for i in range(600)] + [(1000 + i, "big", "word " * 300) for i in range(30)] + [(2000, None, "word " * 40), (2001, "up", "word " * 400)]
    rows = packed(spark, docs, 640, {"up": 338}).orderBy("sequence_id", "offset").collect()
    end = 0
    for r in rows:
        assert r.sequence_id * 640 + r.offset == end
        end += r.length
    of = {r.doc_id: r.doc_tokens for r in rows}
    assert len(of) == len(docs) and sum(of.values()) == end
    # 302 sources of weight 1 and one of 338: it has 338 of the first 640 ids, by the schedule of single queues
    first = {}
    for r in rows:
        if r.sequence_id == 0:
            first[r.source] = first.get(r.source, 0) + r.length
    assert first["up"] == 338 and first["big"] == 1 and len(first) == 303


def test_table_and_dense_counts_agree(spark, monkeypatch):
    rnd = random.Random(4)
    docs = [(i, rnd.choice(["a", "b", None, "c", "c", "c", "d"]), "word " * rnd.choice([0, 3, 50, 700])) for i in range(120)]
    for mixture in (None, {"a": 5, "c": 2}):
        dense = sorted(map(repr, packed(spark, docs, 128, mixture).collect()))
        with monkeypatch.context() as m:
            m.setattr(packing, "QUEUES", 0)
            assert sorted(map(repr, packed(spark, docs, 128, mixture).collect())) == dense


def test_phases_by_weight():
    rnd = random.Random(6)
    totals = [rnd.randint(1, 3000) for _ in range(40)]
    for weights in ([rnd.choice([1, 1, 3, 7]) for _ in totals], totals):
        s = packing.Schedule(totals, weights, 64)
        sent = s.sent(np.arange(s.rounds + 1))
        phases = packing.phases_by_weight(totals, weights, 64)
        for q, (t, w) in enumerate(zip(totals, weights, strict=True)):
            want = [(r, int(sent[r, q]), int(sent[r + 1, q] - sent[r, q])) for r in np.flatnonzero(np.diff(sent[:, q]))]
            assert list(packing.sendings(phases, t, w, 64)) == want


def test_short_words_of_a_passage_are_cut(spark):
    rnd = random.Random(8)
    words = lambda n: " ".join(f"{rnd.randrange(10**6):06}" for _ in range(n))
    short = lambda n: " ".join(rnd.choice("abcdefgh") + rnd.choice("éxyz12345") for _ in range(n))
    long, near = short(51), short(50)
    assert len(long.encode()) < 240
    docs = [(1, f"é {words(30)} {long} {words(30)}"), (2, f"{words(9)}\n{long}\t{words(60)}"), (3, f"{words(30)} {near} {words(9)}"), (4, f"{words(20)} {near} {words(9)}"), (5, None), (6, ""), (None, long)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, frame, "").collect()}
    assert got[2] == docs[1][1].replace(long, "")  # the first occurrence stays
    assert all(got[i] == t for i, t in docs if i != 2)
