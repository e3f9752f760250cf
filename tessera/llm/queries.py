"""The queries of this subpackage: opN_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, release, scratch
from .decontaminate import mark
from .fingerprint import edited_pairs, equal_classes
from .huffman import read_ids, write_ids
from .neardup import near_components
from .packing import pack
from .shard import shard_by_size
from .substrings import PASSAGES, covered_units, repeated_bytes, repeated_words, without_bytes, without_words
from .tokens import token_rows
from .toxicity import fit_chain, score
from .warc import read_archives, write_archives


def op1_fingerprint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_words(docs, repeated_words(docs), digest=True)


def op2_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = edited_pairs(docs)
    release(spark)
    classes = equal_classes(docs)
    renamed = classes.where("fingerprint <> digest").select("doc_id", F.col("digest").alias("fingerprint"), F.col("fingerprint").alias("verified")).distinct()
    named = pairs.join(renamed, ["doc_id", "fingerprint"], "left").withColumn("fingerprint", F.coalesce("verified", "fingerprint"))
    named = named.join(classes.select("fingerprint", "class_id").distinct(), "fingerprint", "left")
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return named.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"), "class_id",
    )


def op3_deficit_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(token_rows(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1, keep=["doc_id", "source"]))


def op4_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("leak.words", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op5_canonical_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "ids")
    write_ids(cut(token_rows(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, keep=["doc_id"])), path)
    release(spark)
    return read_ids(spark, path)


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(read(spark, sf_dir, "documents"))


def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    passages = covered_units(repeated_bytes(docs, PASSAGES)).select(F.col("k").alias("doc_id"), F.col("n").alias("passage_words"))
    found = without_bytes(docs, repeated_bytes(docs), digest=True).join(passages, "doc_id", "left")
    return found.withColumn("passage_words", F.coalesce("passage_words", F.lit(0)))  # in passages of over 50 words that stand elsewhere too


def op8_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: The chain's categories over the columns of `labels`, in order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op9_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_chain(docs, read(spark, sf_dir, "labels"), CATEGORIES)
    scored = score(docs, chain)
    p = {c: F.col(f"toxicity.{c}") for c in CATEGORIES}
    return scored.select("doc_id", *[v.alias(f"p_{c}") for c, v in p.items()], (p["toxic"] >= chain.cuts[-1]).alias("rejected"))


def op10_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return read_archives(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprint_runs, op2_exact_digest, op3_deficit_round_robin, op4_suffix_automaton, op5_canonical_huffman, op6_sampled_splitters, op7_prefix_free_parsing, op8_coordinate_join, op9_classifier_chain, op10_boundary_chain)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_fingerprint_runs": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        v as (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as s from d),
        k as (select doc_id, s, row_number() over (partition by array_to_string(list_slice(w, s, s + 19), ' ') order by doc_id, s) as nth from v),
        gone as (select distinct doc_id, unnest(range(s, s + 20)) as pos from k where nth > 1),
        p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
        j as (select p.doc_id, string_agg(word, ' ' order by p.pos) filter (gone.pos is null) as kept, count(gone.pos) as n_removed from p left join gone on gone.doc_id = p.doc_id and gone.pos = p.pos group by p.doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join j using (doc_id)""",
    "op4_suffix_automaton": rf"""
        with d as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        i as (select cast(item_id as varchar) as item, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        l as (select item, w, least(len(w), 10) as m, unnest(range(1, greatest(len(w) - 8, 2))) as s from i where len(w) > 0),
        k as (select distinct item, m, array_to_string(list_slice(w, s, s + m - 1), ' ') as t from l),
        v as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as s from d, (select distinct m from k)),
        h as (select doc_id, s, k.m, item from v join k on k.m = v.m and k.t = array_to_string(list_slice(w, s, s + v.m - 1), ' ')),
        n as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + m)) as pos from h) group by doc_id),
        f as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join n using (doc_id) left join f using (doc_id)""",
    "op8_coordinate_join": rf"""
        with recursive d as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
        p as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as s from d where len(w) > 0),
        g as (select distinct doc_id, array_to_string(list_slice(w, s, s + 4), ' ') as t from p),
        c as (select doc_id, count(*) as n from g group by doc_id),
        o as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.t = b.t and a.doc_id < b.doc_id group by all),
        l as (select a, b from o join c x on x.doc_id = a join c y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
        e as (select a, b from l union all select b, a from l),
        r(doc_id, root) as (select doc_id, doc_id from d union select e.b, r.root from r join e on e.a = r.doc_id where r.root < e.b)
        select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(root) as component_id, min(root) = d.doc_id as kept from d join r using (doc_id) left join c using (doc_id) group by d.doc_id""",
    "op10_boundary_chain": """
        with p as (select page_id, sha1(coalesce(html, '')) as payload_digest, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
        k as (select payload_digest, max(page_id) as keeper from p where payload_bytes >= 1000 group by all)
        select page_id, payload_bytes, payload_digest, case when keeper <> page_id then 'revisit' else 'response' end as record_type,
               case when keeper <> page_id then keeper end as refers_to
        from p left join k using (payload_digest)""",
}
