"""Queries of kernels, array columns, oracle reliability, knockoff thresholds, interpolation and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import features as FO
from ..operators import tabular as TO
from ..sources.tables import matrix, table
from .registry import LONG, RUNS, query, r6
from .results import _preferences


@query("select vec_id, round(list_sum(list_transform(p, lambda x: -x*ln(x))),5)+0.0 as entropy from (select vec_id, list_transform(e, lambda x: x/list_sum(e)) p from (select vec_id, list_transform(embedding, lambda x: exp(x::double)) e from embeddings))")
def softmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the softmax of an array column, by higher-order functions alone."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("e"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    p = e.withColumn("t", total("e")).select("vec_id", F.transform("e", lambda x: x / F.col("t")).alias("p"))
    return p.select("vec_id", (F.round(total(F.transform("p", lambda x: -x * F.ln(x))), 5) + F.lit(0.0)).alias("entropy"))


@query(f"with {LONG}, r as (select row_id, f, row_number() over (partition by row_id order by v desc, f) rk from m) select row_id, f, rk as place from r where rk <= 3")
def top_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest entries of each row's array, sorted inside the row without a shuffle."""
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x, i: F.struct((-x.cast("double")).alias("v"), i.cast("long").alias("f"))).alias("a"))
    top = a.select("row_id", F.posexplode(F.slice(F.array_sort("a"), 1, 3)).alias("place", "x"))
    return top.select("row_id", F.col("x.f").alias("f"), (F.col("place") + 1).cast("long").alias("place"))


@query(f"""with {LONG}, d as (select a.f, a.row_id i, (a.v-b.v)^2 d2, case when a.label=b.label then 1.0::double else 0.0::double end l from m a join m b on a.f=b.f), s as (select f, sqrt(0.5*median(d2) filter (d2 > 0)) s from d group by f),
 r as (select d.f, i, sum(exp(-d2/(2*s*s))*l) kl, sum(exp(-d2/(2*s*s))) k, sum(l) l from d join s on s.f=d.f group by d.f, i) select f, round(1000*(sum(kl)-2*sum(k*l)/count(*)+sum(k)*sum(l)/(count(*)*count(*)))/((count(*)-1)*(count(*)-1)),6)+0.0 as hsic from r group by f""")
def kernel_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSIC (times 1000) of every feature's RBF kernel, width by the median rule, with the label kernel, both centred."""
    return FO.hsic(matrix(spark, sf_dir)).select("f", r6(1000 * F.col("hsic")).alias("hsic"))


@query(f"""with {RUNS}, o as (select 'ba' oracle, a.method i, b.method j, avg(case when abs(a.ba-b.ba) <= 0.0005 then 0.5 when a.ba > b.ba then 1.0 else 0.0 end) p from runs a join runs b using (dataset, seed) where a.method <> b.method group by all
 union all select 'f1', a.method, b.method, avg(case when abs(a.f1-b.f1) <= 0.0005 then 0.5 when a.f1 > b.f1 then 1.0 else 0.0 end) from runs a join runs b using (dataset, seed) where a.method <> b.method group by all),
 r as (select i, j, avg(p) ref from o group by all), c as (select oracle, abs(p-0.5) > 0.005 and abs(ref-0.5) > 0.005 sure, (p > 0.5) = (ref > 0.5) agree from o join r using (i, j)),
 w as (select oracle, greatest(0, (2*coalesce(avg(case when agree then 1.0 else 0.0 end) filter (sure),0.5)-1)*avg(case when sure then 1.0 else 0.0 end)) w from c group by oracle) select oracle, round(w,6)+0.0 as reliability from w""")
def oracle_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(2 * agreement - 1) * coverage with the oracles' mean, over the pairs that both are sure of."""
    o = _preferences(spark, sf_dir).withColumn("oracle", F.lit("ba")).union(_preferences(spark, sf_dir, "f1").withColumn("oracle", F.lit("f1")))
    ref = o.groupBy("i", "j").agg(F.avg("p").alias("ref"))
    sure = (F.abs(F.col("p") - 0.5) > 0.005) & (F.abs(F.col("ref") - 0.5) > 0.005)
    agree = ((F.col("p") > 0.5) == (F.col("ref") > 0.5)).cast("double")
    g = o.join(ref, ["i", "j"]).groupBy("oracle").agg(F.coalesce(F.avg(F.when(sure, agree)), F.lit(0.5)).alias("a"), F.avg(sure.cast("double")).alias("c"))
    return g.select("oracle", r6(F.greatest(F.lit(0.0), (2 * F.col("a") - 1) * F.col("c"))).alias("reliability"))


@query(f"""with {LONG}, w as (select f, round(avg(v) filter (label=0)-avg(v) filter (label=1),6) w from m group by f), t as (select distinct abs(w) t from w where w <> 0), c as (select t, count(*) filter (w <= -t) neg, count(*) filter (w >= t) pos from t, w group by t)
 select (select round(min(t),6)+0.0 from c where (1.0+neg)/greatest(1,pos) <= 0.9) as threshold, count(*) as n_features from w""")
def knockoff_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest t with (1 + #{W <= -t}) / max(1, #{W >= t}) <= alpha, by cumulative counts in order of |W|."""
    mean = lambda k: F.avg(F.when(F.col("label") == k, F.col("v")))
    w = matrix(spark, sf_dir).groupBy("f").agg(F.round(mean(0) - mean(1), 6).alias("w"))
    down = Window.orderBy(F.abs("w").desc()).rangeBetween(Window.unboundedPreceding, 0)
    c = w.select(F.abs("w").alias("t"), F.sum((F.col("w") < 0).cast("long")).over(down).alias("neg"), F.sum((F.col("w") > 0).cast("long")).over(down).alias("pos"))
    t = F.min(F.when((F.col("t") > 0) & ((1 + F.col("neg")) / F.greatest(F.lit(1), "pos") <= 0.9), F.col("t")))
    return c.agg(r6(t).alias("threshold"), F.count("*").alias("n_features"))


@query("""with x as (select vec_id i, cast(label as bigint) as label, list_transform(embedding, lambda e: e::double) x from embeddings), o as (select *, row_number() over (partition by label order by sha256(concat_ws(':', i, 9)), i)-1 pos, count(*) over (partition by label) n from x),
 c as (select label, n, unnest(range((select max(n) from o)-n)) draw from (select distinct label, n from o)), b as (select c.label, draw, i, x, sha256(concat_ws(':', i, draw, 9)) h from c join o on o.label=c.label and pos=draw%c.n),
 k as (select a.i, e.i j, e.x y, row_number() over (partition by a.i order by list_sum(list_transform(list_zip(a.x, e.x), lambda z: (z[1]-z[2])*(z[1]-z[2]))), e.i)-1 rk from o a join o e on a.label=e.label and a.i<>e.i),
 s as (select label, draw, b.i, j, x, y, (('0x'||substr(h,17,16))::ubigint >> 11)::double/9007199254740992 u from b join k on k.i=b.i and rk=('0x'||substr(h,1,16))::ubigint%5)
 select label, draw, i as row_id, j as neighbour, unnest(range(len(x))) as f, round(unnest(list_transform(list_zip(x, y), lambda z: z[1]+u*(z[2]-z[1]))),6)+0.0 as v from s""")
def minority_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMOTE: synthetic rows between rows and their 5 nearest neighbours for every class, up to the largest one's size."""
    s = TO.smote(table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("long")), "vec_id", "label", "embedding", 5, 9)
    return s.select("label", "draw", "row_id", "neighbour", F.posexplode("x").alias("f", "v")).select("label", "draw", "row_id", "neighbour", F.col("f").cast("long").alias("f"), r6("v").alias("v"))


@query("with r as (select vec_id, label, row_number() over (partition by label order by sha256(concat_ws(':', cast(vec_id as varchar), '9')), vec_id) rk, count(*) over (partition by label) n from embeddings) select vec_id, cast(label as bigint) as label from r where rk <= greatest(1, round(0.3*n))")
def stratified_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    w = Window.partitionBy("label")
    r = r.withColumns({"rk": F.row_number().over(w.orderBy(S.hash_order(F.col("vec_id"), 9), "vec_id")), "n": F.count("*").over(w)})
    return r.where(F.col("rk") <= F.greatest(F.lit(1), F.round(0.3 * F.col("n")))).select("vec_id", "label")


@query("with k as (select vec_id, label, (row_number() over (partition by label order by sha256(concat_ws(':', cast(vec_id as varchar), '5')), vec_id)-1)%5 as fold from embeddings) select fold, count(*) as n_test, (select count(*) from embeddings) - count(*) as n_train, count(distinct label) as classes, count(*) = count(distinct vec_id) as disjoint from k group by fold")
def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, class coverage and disjointness of the folds of an assignment."""
    r = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    k = TO.folds(r, "vec_id", ["label"], 5, 5)
    g = k.groupBy("fold").agg(F.count("*").alias("n_test"), F.count_distinct("label").alias("classes"), (F.count("*") == F.count_distinct("vec_id")).alias("disjoint"))
    return g.select("fold", "n_test", (F.sum("n_test").over(Window.partitionBy()) - F.col("n_test")).alias("n_train"), "classes", "disjoint")


@query("select coalesce(lang, 'missing') as lang, count(*) as n, round(avg(n_chars),4)+0.0 as mean_chars from documents group by 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("missing")).alias("lang"))
    return d.agg(F.count("*").alias("n"), (F.round(F.avg("n_chars"), 4) + F.lit(0.0)).alias("mean_chars"))


@query(f"""with {LONG}, b as (select row_id, f, least(15, floor((v-min(v) over (partition by f))/(max(v) over (partition by f)-min(v) over (partition by f))*16)) x from m), c as (select a.f, b.f g, a.x, b.x y, count(*) c from b a join b on a.row_id=b.row_id and a.f<b.f group by all),
 k as (select f, g, c, sum(c) over (partition by f, g) n, sum(c) over (partition by f, g, x) cx, sum(c) over (partition by f, g, y) cy from c), h as (select f, g, sum(c/n*ln(c*n/(cx*cy))) mi, -sum(c/n*ln(cx/n)) hx, -sum(c/n*ln(cy/n)) hy from k group by f, g) select f, g, round(mi/least(hx,hy),6)+0.0 as nmi from h""")
def information_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information over the smaller entropy of every two features f < g, on a grid of 16 equal widths each way; 0 where
    one has a single value. A feature's grid spans all its values; rows without one of the two values are left out of the
    pair."""
    m = matrix(spark, sf_dir)
    span = m.groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 16)
    cell = F.when(F.col("v").isNotNull(), F.least(F.lit(15), F.coalesce(place, F.lit(0)))).cast("int")
    cells = m.join(F.broadcast(span), "f").groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", cell.alias("x")))), lambda c: c["x"]).alias("x"))  # a row for each feature
    joint = FO.pair_counts(cells, 16).select(F.struct("f", "g").alias("f"), "bin", F.col("other").alias("label"), "c")
    nmi = F.coalesce(F.col("mi") / F.nullif(F.least("hx", "hy"), F.lit(0.0)), F.lit(0.0))
    return FO.information_of(joint).select("f.f", "f.g", r6(nmi).alias("nmi"))
