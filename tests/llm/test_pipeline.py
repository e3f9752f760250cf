"""The pipeline's stages on planted documents."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.where("lang = 'en'").orderBy(F.length("text").desc()).first()
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    words = lambda n, p: " ".join(f"{p}{i * 7919 % 100003}" for i in range(n))
    shared = words(60, "q")
    planted = [
        (9001, "idiot loser scum " + words(80, "t")), (9002, first.text), (9003, first.text.replace(" the ", " tha ", 1)),
        (9004, words(120, "a") + " " + shared + " " + words(120, "b")), (9005, words(120, "c") + " " + shared + " " + words(120, "d")), (9006, words(150, "e") + " " + item + " " + words(150, "f")), (9007, words(200, "clean")),
    ]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in planted], docs.schema)
    frame = docs.union(extra).withColumn("n_chars", F.length("text").cast("long")).cache()
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir).cache()
        kept.append({r.doc_id: r for r in frame.collect()})
    assert all(corpus_pipeline.STAGES) and frame.columns[0] == "doc_id"
    assert 9007 in kept[0] and 9002 in kept[0]
    assert 9002 not in kept[1] and 9003 not in kept[1] and 9007 in kept[1]
    assert shared in kept[2][9004].text and "q7919 " not in kept[2][9005].text and kept[2][9007].text == planted[-1][1] and 9005 in kept[2]
    assert item not in kept[3][9006].text and kept[3][9006].n_chars == len(kept[3][9006].text) and kept[3][9007].text == planted[-1][1]
    assert set(kept[4]) == set(kept[3])
