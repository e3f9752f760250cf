"""Queries of splitting, balancing, encoding, batch correction and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import tabular as O
from ..operators.ordered import cumulative
from ..sources.tables import matrix, table
from .registry import LONG, query, r6

EMB = "e as (select vec_id, cast(label as bigint) as label from embeddings)"


def _hash_sql(column: str, seed: int) -> str:
    return f"sha256(concat_ws(':', cast({column} as varchar), '{seed}'))"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))


@query(f"with {EMB} select vec_id, label, case when row_number() over (partition by label order by {_hash_sql('vec_id', 3)}, vec_id) <= ceil(count(*) over (partition by label)*0.2) then 'test' else 'train' end as role from e")
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stratified_holdout(_rows(spark, sf_dir), "vec_id", "label", 0.2, 3)


@query(f"with {EMB} select vec_id, label, (row_number() over (partition by label order by {_hash_sql('vec_id', 5)}, vec_id)-1)%5 as fold from e")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.folds(_rows(spark, sf_dir), "vec_id", ["label"], 5, 5)


@query(f"with u as (select distinct user_id from events), k as (select user_id, (row_number() over (order by {_hash_sql('user_id', 11)}, user_id)-1)%4 as fold from u) select event_id, user_id, fold from events join k using (user_id)")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of whole users: groups are dealt, and rows follow them by a join."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    users = e.select("user_id").distinct().withColumn("all", F.lit(1))
    return e.join(O.folds(users, "user_id", ["all"], 4, 11).drop("all"), "user_id").select("event_id", "user_id", "fold")


@query("""with b as (select date_trunc('day', ts) d, count(*) n from events group by 1), c as (select d, row_number() over (order by d)-1 block, sum(n) over (order by d desc) tail, sum(n) over () total from b),
 q as (select arg_min(block, (abs(tail-0.25*total), block)) cut from c) select e.event_id, c.block as block, case when c.block >= cut then 'test' else 'train' end as role from events e join c on date_trunc('day', e.ts)=c.d, q""")
def temporal_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary between days that leaves nearest to a quarter of the rows behind it, the earliest on a tie."""
    e = O.time_blocks(table(spark, sf_dir, "events").select("event_id", "ts"), F.date_trunc("day", "ts"))
    b = e.groupBy("block").agg(F.count("*").alias("n"))
    c = b.withColumns({"tail": F.sum("n").over(Window.orderBy(F.col("block").desc())), "total": F.sum("n").over(Window.partitionBy())})
    cut = c.agg(F.min_by("block", F.struct(F.abs(F.col("tail") - 0.25 * F.col("total")), "block")).alias("cut"))
    return e.crossJoin(F.broadcast(cut)).select("event_id", "block", F.when(F.col("block") >= F.col("cut"), "test").otherwise("train").alias("role"))  # one row


@query("""with d as (select distinct date_trunc('day', ts) d from events), b as (select d, (row_number() over (order by d)-1)*5//count(*) over () seg from d)
 select g.g as fold, case when seg < g.g then 'train' when seg = g.g then 'test' end as role, count(*) as n_rows from events e join b on date_trunc('day', e.ts)=b.d, range(1,5) g(g) where seg <= g.g group by 1, 2""")
def expanding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in five segments: each fold tests one segment and trains on all before it."""
    e = O.time_blocks(table(spark, sf_dir, "events").select("event_id", "ts"), F.date_trunc("day", "ts"))
    n = e.select("block").distinct().count()
    e = e.withColumn("seg", F.floor(F.col("block") * 5 / n)).withColumn("fold", F.explode(F.array(*[F.lit(g).cast("long") for g in (1, 2, 3, 4)]))).where("seg <= fold")
    return e.groupBy("fold", F.when(F.col("seg") < F.col("fold"), "train").otherwise("test").alias("role")).agg(F.count("*").alias("n_rows"))


@query("with s as (select distinct source from documents where source is not null) select s.source as held_out, count(*) filter (d.source = s.source) as n_test, count(*) filter (d.source <> s.source) as n_train from documents d, s group by s.source")
def leave_one_source_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fold for each source; sizes come from the sources' counts, without pairing rows with folds."""
    n = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n_test"))
    return n.select(F.col("source").alias("held_out"), "n_test", (F.sum("n_test").over(Window.partitionBy()) - F.col("n_test")).alias("n_train"))


@query("""with r as (select user_id, ts, row_number() over (order by ts, event_id) <= 0.7*count(*) over () tr from events)
 select (select count(*) from (select user_id from r where tr intersect select user_id from r where not tr)) as shared_groups, (select max(ts) from r where tr) <= (select min(ts) from r where not tr) as ordered""")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups on both sides of a split in time, and whether training ends before testing begins."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    cut = e.select("ts", "event_id")
    n = cut.count()
    edge = cut.orderBy("ts", "event_id").offset(int(0.7 * n) - 1).limit(1).select(F.struct("ts", "event_id").alias("edge"))
    r = e.crossJoin(F.broadcast(edge)).withColumn("tr", F.struct("ts", "event_id") <= F.col("edge"))  # one row
    both = r.groupBy("user_id").agg(F.bool_or("tr").alias("a"), F.bool_or(~F.col("tr")).alias("b")).agg(F.count_if(F.col("a") & F.col("b")).alias("shared_groups"))
    order = r.agg((F.max(F.when(F.col("tr"), F.col("ts"))) <= F.min(F.when(~F.col("tr"), F.col("ts")))).alias("ordered"))
    return both.crossJoin(order)  # one row each


@query(f"with r as (select doc_id, toxic, row_number() over (partition by toxic order by {_hash_sql('doc_id', 2)}, doc_id) rk from labels) select doc_id, toxic from r where rk <= (select min(c) from (select count(*) c from labels group by toxic))")
def random_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.undersample(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 2)


@query(f"""with r as (select doc_id, toxic, row_number() over (partition by toxic order by {_hash_sql('doc_id', 2)}, doc_id) rk, count(*) over (partition by toxic) n from labels), x as (select *, max(n) over () most from r)
 select doc_id, toxic, unnest(range(1, most//n + (case when rk <= most % n then 1 else 0 end) + 1)) as copy from x""")
def random_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.oversample(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 2).select("doc_id", "toxic", "copy")


@query(f"with {LONG}, s as (select f, avg(v) filter (label=0) m1, avg(v) filter (label<>0) m0, var_samp(v) filter (label=0) v1, var_samp(v) filter (label<>0) v0 from m group by f) select round(max(coalesce(abs(m1-m0)/nullif(sqrt((v1+v0)/2),0),0)),6)+0.0 as max_smd from s")
def worst_mean_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("label") == 0
    s = matrix(spark, sf_dir).groupBy("f").agg(F.avg(F.when(t, F.col("v"))).alias("m1"), F.avg(F.when(~t, F.col("v"))).alias("m0"), F.var_samp(F.when(t, F.col("v"))).alias("v1"), F.var_samp(F.when(~t, F.col("v"))).alias("v0"))
    return s.agg(r6(F.max(F.coalesce(F.abs(F.col("m1") - F.col("m0")) / F.nullif(F.sqrt((F.col("v1") + F.col("v0")) / 2), F.lit(0.0)), F.lit(0.0)))).alias("max_smd"))


@query(f"with {LONG} select row_id, f, round((v-avg(v) over w)/(case when stddev_pop(v) over w > 0 then stddev_pop(v) over w else 1 end),6)+0.0 as z, round((v-min(v) over w)/nullif(max(v) over w-min(v) over w,0),6)+0.0 as u from m window w as (partition by f)")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("row_id", "f", r6(S.standardised("v", ["f"])).alias("z"), r6(S.min_max("v", ["f"], 0.0)).alias("u"))


@query(f"""with {LONG}, q as (select f, v, count(*) c from m group by all), w as (select f, v, (sum(c) over (partition by f order by v) - c/2.0)/sum(c) over (partition by f) p from q) select row_id, m.f, round(p,6)+0.0 as p from m join w on w.f=m.f and w.v=m.v""")
def mid_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(less + less or equal) / 2n of every value, from cumulative counts of distinct values; null for a null value."""
    m = matrix(spark, sf_dir)
    at = cumulative(m, ["f"], "v", c=F.count("*")).select("f", "v", ((2 * F.col("below_c") + F.col("c")) / (2 * F.col("all_c"))).alias("p"))
    return m.join(at, ["f", "v"], "left").select("row_id", "f", r6("p").alias("p"))


BATCH = f"{LONG}, bm as (select *, row_id % 2 as batch from m)"


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).withColumn("batch", F.col("row_id") % 2)


@query(f"""with {BATCH}, g as (select f, avg(v) mu, stddev_samp(v) sd from m group by f), b as (select f, batch, avg(v) bm, stddev_samp(v) bs, count(*) n from bm group by all),
 p as (select f, batch, mu, n/(n+10.0)*(bm-mu) gamma, greatest(0.2,least(5,1+n/(n+10.0)*(bs/nullif(sd,0)-1))) delta from b join g using(f)) select row_id, bm.f, round((v-mu-gamma)/delta+mu,6)+0.0 as adjusted from bm join p using (f, batch)""".replace("bm.f,", "f,"))
def combat_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.combat(_batched(spark, sf_dir), 10.0).select("row_id", "f", r6("adjusted").alias("adjusted"))


@query(f"with {BATCH} select row_id, f, round((v-avg(v) over (partition by f,batch))/nullif(stddev_samp(v) over (partition by f,batch),0)*stddev_samp(v) over (partition by f)+avg(v) over (partition by f),6)+0.0 as adjusted from bm")
def center_scale_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.center_scale(_batched(spark, sf_dir)).select("row_id", "f", r6("adjusted").alias("adjusted"))


@query(f"with {BATCH} select row_id, f, round(v-avg(v) over (partition by f,batch)+avg(v) over (partition by f),6)+0.0 as centred from bm")
def study_centring(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, all_ = Window.partitionBy("f", "batch"), Window.partitionBy("f")
    return _batched(spark, sf_dir).select("row_id", "f", r6(F.col("v") - F.avg("v").over(own) + F.avg("v").over(all_)).alias("centred"))


TRAIN = "doc_id % 5 <> 0"


@query(f"""with lv as (select lang, row_number() over (order by lang) code from (select distinct lang from documents where {TRAIN} and lang is not null)), md as (select median(n_chars) md from documents where {TRAIN})
 select doc_id, round(coalesce(n_chars, md),6)+0.0 as n_chars, case when documents.lang is null then -1.0 else coalesce(cast(code as double),0.0) end as lang_code, coalesce(length(text),0) as text_length from documents left join lv using (lang), md""")
def fold_local_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and category codes learnt on training rows alone; unknown categories are 0, missing ones -1."""
    d = table(spark, sf_dir, "documents")
    train = d.where(TRAIN)
    levels = train.where("lang is not null").select("lang").distinct().withColumn("code", F.row_number().over(Window.orderBy("lang")))
    fill = train.agg(F.median("n_chars").alias("md"))
    d = d.select("doc_id", "lang", "n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("text_length"))  # no text is shuffled
    j = d.join(levels, "lang", "left").crossJoin(F.broadcast(fill))  # one row
    code = F.when(F.col("lang").isNull(), -1.0).otherwise(F.coalesce(F.col("code").cast("double"), F.lit(0.0)))
    return j.select("doc_id", r6(F.coalesce(F.col("n_chars").cast("double"), F.col("md"))).alias("n_chars"), code.alias("lang_code"), "text_length")


BUCKET = "cast(('0x' || substr(sha256(word),1,15)) as bigint) % 64"


@query(f"""with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) word from benchmark), t as (select item_id, {BUCKET} bucket, word from w), n as (select count(*) n from benchmark where item_id % 5 <> 0),
 df as (select bucket, count(distinct item_id) df from t where item_id % 5 <> 0 group by bucket), tf as (select item_id, bucket, count(*) c from t group by all), l as (select item_id, count(*) len from t group by item_id)
 select item_id, bucket, round(c/len*(ln((1+n)/(1+coalesce(df,0)))+1),6)+0.0 as tfidf from tf join l using(item_id) left join df using(bucket), n""")
def hashed_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tf = count / length in 64 hashed buckets; idf = ln((1 + N) / (1 + df)) + 1 from training rows."""
    b = table(spark, sf_dir, "benchmark")
    t = O.token_rows(b, "item_id", "text").select("item_id", S.hash_bucket(F.col("word"), 64).alias("bucket"))
    n = b.where("item_id % 5 <> 0").agg(F.count("*").alias("n"))
    df = t.where("item_id % 5 <> 0").groupBy("bucket").agg(F.count_distinct("item_id").alias("df"))
    tf = t.groupBy("item_id", "bucket").agg(F.count("*").alias("c")).withColumn("len", F.sum("c").over(Window.partitionBy("item_id")))
    j = tf.join(F.broadcast(df), "bucket", "left").crossJoin(F.broadcast(n))  # 64 rows; one row
    return j.select("item_id", "bucket", r6(F.col("c") / F.col("len") * (F.ln((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1)).alias("tfidf"))


@query("""select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month, day(o_orderdate) as day, isodow(o_orderdate)-1 as dow, datediff('day', date '0001-01-01', cast(o_orderdate as date))+1 as ordinal from orders""")
def date_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    parts = {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "dow": F.weekday(d), "ordinal": F.datediff(d, F.lit("0001-01-01").cast("date")) + 1}
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[F.coalesce(c, F.lit(-1 if n == "dow" else 0)).cast("long").alias(n) for n, c in parts.items()])


@query("with g as (select doc_id, cast(('0x' || substr(sha256(source),1,15)) as bigint) % 4 b from documents) select doc_id, " + ", ".join(f"case when b={k} then 1.0::double else 0.0::double end as group_{k}" for k in range(4)) + " from g")
def group_hash_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.hash_bucket(F.col("source"), 4)
    return table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce((b == k).cast("double"), F.lit(0.0)).alias(f"group_{k}") for k in range(4)])


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("with c as (select count(distinct p_name) a, count(distinct p_brand) b, count(distinct p_type) c, count(distinct p_size) d from part) select unnest(['p_name','p_brand','p_type','p_size']) as col, unnest([a,b,c,d]) as cardinality, unnest([a>=20,b>=20,c>=20,d>=20]) as high from c")
def high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["p_name", "p_brand", "p_type", "p_size"]
    one = table(spark, sf_dir, "part").agg(*[F.count_distinct(c).alias(c) for c in cols])
    return one.unpivot([], cols, "col", "cardinality").withColumn("high", F.col("cardinality") >= 20)


@query("select n_regionkey as region, sha256('{\"keys\":[' || string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey) || ']}') as digest from nation group by n_regionkey")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of canonical JSON."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"))
    return n.select("region", F.sha2(F.to_json(F.struct("keys")), 256).alias("digest"))


@query("""with recursive k as (select event_id, 'u' || user_id as k from events union all select event_id, 's' || date_trunc('second', ts) from events),
 r(event_id, component) using key (event_id) as (select event_id, event_id from events union
 (with g as (select k, min(r.component) component from recurring.r as r join k using (event_id) group by k), n as (select event_id, min(g.component) component from k join g using (k) group by event_id) select n.event_id, n.component from n join recurring.r as r using (event_id) where n.component < r.component))
 select event_id, component from r""")
def linked_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every event, named by its smallest event: events of one user, or of one session (a whole second of
    the clock), belong together, over any number of steps."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("second", "ts").alias("session"))
    return O.linked_rows(e, "event_id", ["user_id", "session"])
