"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete, lean_workers, read, scratch, unused
from tessera.llm.decontaminate import mark, remove
from tessera.llm.neardup import near_components
from tessera.llm.packing import pack
from tessera.llm.substrings import PASSAGES, byte_runs, repeated_bytes, without_bytes
from tessera.llm.toxicity import fit_chain, score
from tessera.llm.queries import CATEGORIES
from tessera.llm.tokens import token_rows
from tessera.llm.windows import Spec

#: Repeated strings of so many bytes are cut out, and repeated passages of over 50 words, which can be shorter in bytes.
REPEATS = Spec("byte", 240, 96, 16)
#: Documents of which more than this share stands in benchmark items go; from the others the spans are cut.
COVERAGE = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as it is after a cut."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of `toxic` is below the chain's cut; models are fitted to the labelled ones among them.

    Null and empty texts have no features and stay, as do rows without an id; repeated rows are judged alike; very long texts
    count whole. Without labels all stay. An empty table gives no rows. Other columns stay, whatever their names."""
    lean_workers(spark)
    chain = fit_chain(docs, read(spark, sf_dir, "labels"), CATEGORIES)
    name = unused(docs, "toxicity")
    return score(docs, chain, into=name).where(F.col(f"{name}.toxic") < chain.cuts[-1]).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id stay.

    Null and empty texts are near nothing and stay; a repeated id stands for one document, all of whose rows stay or go. Very
    long texts count whole. An empty table gives no rows. Other columns stay, whatever their names."""
    lean_workers(spark)
    gone = near_components(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of REPEATS and the words of PASSAGES that also stand earlier (in a smaller key, or before
    in the same text): the first occurrence stays, and so does every document. Null and empty texts stay as they are; rows
    without an id are no occurrences. An empty table gives no rows."""
    lean_workers(spark)
    runs = repeated_bytes(docs, REPEATS, earlier=True).unionByName(byte_runs(docs, repeated_bytes(docs, PASSAGES, earlier=True)))
    return _counted(without_bytes(docs, runs, digest=False).select(*docs.columns))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; those that consist mostly of them go.

    Null and wordless texts have no hits and stay, as do rows without an id; repeated rows are judged alike. Very long texts
    are streamed whole. An empty table gives no rows, an empty benchmark changes nothing. Other columns stay."""
    lean_workers(spark)
    name = unused(docs, "leak")
    return _counted(remove(mark(docs, read(spark, sf_dir, "benchmark"), into=name), coverage=COVERAGE, leak=name).select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids in the proportions of the sources.

    Null and empty texts are their end mark alone; a null source is one of the sources; rows without an id, or with a
    repeated one, are packed one by one. Very long texts are cut into as many pieces as they need. An empty table gives no
    rows. Columns besides doc_id, source and text are left out."""
    lean_workers(spark)
    return pack(token_rows(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1, keep=["doc_id", "source"], release=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: No SQL: the classifier, the components and the tokenizer can't be expressed; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each written as Parquet in the shared folder and read by the next."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
