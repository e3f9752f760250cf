"""Feature-selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import features as O
from ..operators.nearest import whole_vectors
from ..sources.tables import matrix, table
from .registry import LONG, query, r6

ANOVA = """g as (select f, label, count(v) n, avg(v) mu, var_pop(v) var from m group by all), h as (select f, sum(n) n, count(*) k, sum(n*mu)/sum(n) grand, sum(n*var) ssw from g group by f),
 anova as (select f, (sum(g.n*(mu-grand)^2)/(any_value(k)-1)) / nullif(any_value(ssw)/(any_value(h.n)-any_value(k)),0) as score from g join h using(f) group by f)"""
RANK = "rk as (select *, rank() over (partition by f order by v) + (count(*) over (partition by f, v) - 1)/2.0 as rk from m)"
BIN = "e as (select f, list_distinct(quantile_cont(v, [0.125,0.25,0.375,0.5,0.625,0.75,0.875])) edges from m group by f), b as (select m.*, len(list_filter(edges, lambda x: x <= v)) as bin from m join e using(f))"
INFO = """j as (select f, bin, label, count(*) c from b group by all), k as (select *, sum(c) over (partition by f) n, sum(c) over (partition by f, bin) cx, sum(c) over (partition by f, label) cy from j),
 info as (select f, greatest(sum(c/n*ln(c*n/(cx*cy))),0) mi, -sum(c/n*ln(cx/n)) hx, -sum(c/n*ln(cy/n)) hy from k group by f)"""
MULTI = """cnt as (select f, label, v from m), pr as (select x.label a, y.label b from (select distinct label from m) x join (select distinct label from m) y on x.label < y.label),
 sub as (select f, a, b, label, rank() over (partition by f, a, b order by v) + (count(*) over (partition by f, a, b, v) - 1)/2.0 rk from cnt join pr on label = a or label = b),
 au as (select f, a, b, (sum(rk) filter (label = b) - count(*) filter (label = b)*(count(*) filter (label = b)+1)/2.0)/(count(*) filter (label = a)*count(*) filter (label = b)) auc from sub group by all),
 multi as (select f, avg(greatest(auc, 1-auc)) score from au group by f)"""


@query(f"with {LONG}, {ANOVA} select f, round(score, 6)+0.0 as score from anova")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.anova_f(matrix(spark, sf_dir)).select("f", r6("score").alias("score"))


@query(f"""with {LONG}, s as (select f, label, coalesce((v - min(v) over (partition by f))/nullif(max(v) over (partition by f) - min(v) over (partition by f),0),0) u from m),
 o as (select f, label, sum(u) seen, count(*) n from s group by all), x as (select *, sum(seen) over (partition by f)*n/sum(n) over (partition by f) expected from o)
 select f, round(sum((seen-expected)^2/nullif(expected,0)),6)+0.0 as score from x group by f""")
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chi_square(matrix(spark, sf_dir)).select("f", r6("score").alias("score"))


@query(f"""with {LONG}, {RANK}, g as (select f, sum(rk) filter (label=0) s, count(*) filter (label=0) p, count(*) n, stddev_pop(v) sd from rk group by f), a as (select f, sd, (s-p*(p+1)/2.0)/(p*(n-p)) auc from g)
 select f, round(case when sd < 1e-12 then 0 else 2*(greatest(auc,1-auc)-0.5) end, 6)+0.0 as score from a""")
def wmw_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.auc_binary(matrix(spark, sf_dir), F.col("label") == 0).select("f", r6("score").alias("score"))


@query(f"with {LONG}, {MULTI} select f, round(score,6)+0.0 as score from multi")
def wmw_auc_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.auc_multiclass(matrix(spark, sf_dir)).select("f", r6("score").alias("score"))


@query(f"with {LONG}, {BIN}, {INFO} select f, round(mi,6)+0.0 as mi, round(2*mi/nullif(hx+hy,0),6)+0.0 as su, round(hx,6)+0.0 as hx from info")
def binned_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.information(O.quantile_bins(matrix(spark, sf_dir), 8)).select("f", r6("mi").alias("mi"), r6("su").alias("su"), r6("hx").alias("hx"))


@query(f"""with {LONG}, {BIN}, z as (select row_id, bin as z from b where f = 0), j as (select f, z, bin, label, count(*) c from b join z using(row_id) group by all),
 k as (select *, sum(c) over (partition by f, z) nz, sum(c) over (partition by f, z, bin) cx, sum(c) over (partition by f, z, label) cy, sum(c) over (partition by f) n from j)
 select f, round(greatest(sum(c/n*ln(c*nz/(cx*cy))),0),6)+0.0 as cmi from k where nz > 1 group by f""")
def conditional_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = O.quantile_bins(matrix(spark, sf_dir), 8)
    return O.conditional_information(b, b.where("f = 0").select("row_id", F.col("bin").alias("z"))).select("f", r6("cmi").alias("cmi"))


@query(f"""with {LONG}, g as (select f, avg(v) filter (label=0) m1, avg(v) filter (label<>0) m0, var_pop(v) filter (label=0) s1, var_pop(v) filter (label<>0) s0, avg(case when label=0 then 1 else 0 end) w from m group by f),
 h as (select *, sqrt((1-w)*s0+w*s1) sd from g), q as (select median(sd)*1e-3 fl from h) select f, round(abs(m1-m0)/greatest(sd,fl),6)+0.0 as score from h, q""")
def weighted_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.weighted_snr(matrix(spark, sf_dir), F.col("label") == 0).select("f", r6("score").alias("score"))


@query(f"""with {LONG} select f, round((avg(v) filter (label=0) - avg(v) filter (label<>0))/nullif(sqrt(var_samp(v) filter (label=0)/count(v) filter (label=0)+var_samp(v) filter (label<>0)/count(v) filter (label<>0)),0),6)+0.0 as score from m group by f""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.welch_t(matrix(spark, sf_dir), F.col("label") == 0).select("f", r6("score").alias("score"))


@query(f"with {LONG}, v as (select f, var_pop(v) var from m group by f) select f, round(var,6)+0.0 as var from v where var > 0.9 or not (select bool_or(var > 0.9) from v)")
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.variance_filter(matrix(spark, sf_dir), 0.9).select("f", r6("var").alias("var"))


CORR = "c as (select a.f a, b.f b, corr(a.v, b.v) r from m a join m b using (row_id) where a.f < b.f group by all)"


@query(f"with {LONG}, {CORR} select a, b, round(r,6)+0.0 as r from c")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.correlations(matrix(spark, sf_dir)).select("a", "b", r6("r").alias("r"))


@query(f"with {LONG}, {CORR} select distinct f from m where f not in (select b from c where abs(r) > 0.1)")
def correlation_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.uncorrelated(matrix(spark, sf_dir), 0.1)


@query(f"""with {LONG}, p as (select a.f a, b.f b, abs(avg(case when a.v>b.v then 1.0 else 0 end) filter (a.label=0) - avg(case when a.v>b.v then 1.0 else 0 end) filter (a.label<>0)) gap from m a join m b using(row_id) where a.f<b.f group by all)
 select a, b, round(gap,6)+0.0 as gap from p""")
def top_scoring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pair_gaps(matrix(spark, sf_dir), F.col("label") == 0).select("a", "b", r6("gap").alias("gap"))


DIST = "x as (select row_id, label, list(v order by f) x from m group by all), d as (select a.row_id i, b.row_id j, a.label li, b.label lj, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1]-z[2])*(z[1]-z[2])))) d from x a join x b on a.row_id <> b.row_id)"


@query(f"""with {LONG}, {DIST}, n as (select *, row_number() over (partition by i, lj order by d, j) rk from d), p as (select label, count(*)/sum(count(*)) over () p from x group by label),
 w as (select i, j, (case when li=lj then -1.0 else pj.p/(1-pi.p) end)/5 w from n join p pj on pj.label=lj join p pi on pi.label=li where rk <= 5), s as (select f, max(v)-min(v) span from m group by f)
 select f, round(sum(w*abs(a.v-b.v))/count(distinct i)/nullif(any_value(span),0),6)+0.0 as score from w join m a on a.row_id=i join m b on b.row_id=j and b.f=a.f join s on s.f = a.f group by a.f as f""".replace("select f, round(sum(w", "select a.f as f, round(sum(w").replace("group by a.f as f", "group by a.f"))
def relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.relief(matrix(spark, sf_dir), 5, whole_vectors(table(spark, sf_dir, "embeddings"))).select("f", r6("score").alias("score"))


NSC = """g as (select f, label, count(v) n, avg(v) mu, var_pop(v) var from m group by all), h as (select *, sum(n) over w total, count(*) over w classes, sum(n*mu) over w/sum(n) over w grand, sum(n*var) over w ssw from g window w as (partition by f)),
 s as (select *, sqrt(ssw/(total-classes)) s from h), s0 as (select median(s) s0 from (select distinct f, s from s)), nsc as (select f, label, (mu-grand)/(sqrt(1/n-1/total)*(s+s0)) d from s, s0)"""


@query(f"with {LONG}, {NSC} select f, label, round(d,6)+0.0 as d from nsc")
def shrunken_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.shrunken_centroids(matrix(spark, sf_dir)).select("f", "label", r6("d").alias("d"))


@query(f"""with {LONG}, {NSC}, t as (select label, f, abs(d) d from nsc), r as (select f, list(rk order by label) r from (select label, f, rank() over (partition by label order by round(d,6) desc) rk from t) group by f),
 dom as (select x.f, count(y.f) by_n from r x left join r y on x.f<>y.f and list_bool_and(list_transform(list_zip(x.r,y.r), lambda z: z[2]<=z[1])) and list_bool_or(list_transform(list_zip(x.r,y.r), lambda z: z[2]<z[1])) group by x.f)
 select f, by_n as dominated_by, by_n = 0 as front from dom""")
def class_pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features ranked in each class; the front holds those that no other feature beats in every class."""
    d = O.shrunken_centroids(matrix(spark, sf_dir))
    rk = F.rank().over(Window.partitionBy("label").orderBy(F.round(F.abs("d"), 6).desc()))
    r = d.withColumn("rk", rk).groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "rk"))), lambda x: x["rk"]).alias("r"))
    x, y = r.select("f", F.col("r").alias("rx")), r.select(F.col("f").alias("g"), F.col("r").alias("ry"))
    beats = F.forall(F.zip_with("rx", "ry", lambda a, b: b <= a), lambda t: t) & F.exists(F.zip_with("rx", "ry", lambda a, b: b < a), lambda t: t)
    return x.join(y, (F.col("f") != F.col("g")) & beats, "left").groupBy("f").agg(F.count("g").alias("dominated_by")).withColumn("front", F.col("dominated_by") == 0)


BLEND = f"{ANOVA}, {MULTI.replace('cnt as', 'cn as').replace('from cnt', 'from cn')}, bl as (select f, 0.5*(a.score-min(a.score) over ())/(max(a.score) over ()-min(a.score) over ()) + 0.5*(m2.score-min(m2.score) over ())/(max(m2.score) over ()-min(m2.score) over ()) score from anova a join multi m2 using(f))"


@query(f"with {LONG}, {BLEND} select f, round(score,6)+0.0 as score, row_number() over (order by round(score,6) desc, f desc) as rank from bl order by score desc, f desc limit 10")
def feature_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best features by the mean of scaled ANOVA F and Hand-Till AUC."""
    m = matrix(spark, sf_dir)
    both = O.anova_f(m).withColumnRenamed("score", "a").join(O.auc_multiclass(m).withColumnRenamed("score", "b"), "f").withColumn("all", F.lit(1))
    blend = both.select("f", r6(0.5 * S.min_max("a", ["all"], 0.0) + 0.5 * S.min_max("b", ["all"], 0.0)).alias("score"))
    ranked = O.top_k(blend, 10)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("f").desc())).cast("long"))


@query(f"with {LONG} select f, row_number() over (order by sha256(concat_ws(':', cast(f as varchar), '7'))) as rank from (select distinct f from m) order by rank limit 12")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = matrix(spark, sf_dir).select("f").distinct().withColumn("h", S.hash_order(F.col("f"), 7))
    return pool.orderBy("h").limit(12).select("f", F.row_number().over(Window.orderBy("h")).cast("long").alias("rank"))


METHODS = f"""{ANOVA}, {RANK}, wa as (select f, greatest(auc,1-auc) score from (select f, (sum(rk) filter (label=0)-count(*) filter (label=0)*(count(*) filter (label=0)+1)/2.0)/(count(*) filter (label=0)*count(*) filter (label<>0)) auc from rk group by f)),
 va as (select f, var_pop(v) score from m group by f), sc as (select 'anova' method, f, score from anova union all select 'auc', f, score from wa union all select 'variance', f, score from va),
 ms as (select method, f, round(score,6) score, row_number() over (partition by method order by round(score,6) desc, f desc) rank from sc)"""


def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, f, score, rank) of three filters."""
    m = matrix(spark, sf_dir)
    named = lambda name, s: s.select(F.lit(name).alias("method"), "f", F.round("score", 6).alias("score"))
    auc = O.auc_binary(m, F.col("label") == 0).select("f", (F.col("score") / 2 + 0.5).alias("score"))
    scores = named("anova", O.anova_f(m)).union(named("auc", auc)).union(named("variance", m.groupBy("f").agg(F.var_pop("v").alias("score"))))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("method").orderBy(F.col("score").desc(), F.col("f").desc())).cast("long"))


@query(f"with {LONG}, {METHODS} select f, round(sum(0.9^(rank-1)),6)+0.0 as votes, count(*) as methods from ms where rank <= 16 group by f")
def weighted_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = method_scores(spark, sf_dir).where("rank <= 16")
    return top.groupBy("f").agg(r6(F.sum(F.pow(F.lit(0.9), F.col("rank") - 1))).alias("votes"), F.count("*").alias("methods"))


@query(f"with {LONG}, {METHODS} select f, cast(sum(65-rank) as bigint) as borda, row_number() over (order by sum(65-rank) desc, f desc) as place from ms group by f")
def borda_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = method_scores(spark, sf_dir).groupBy("f").agg(F.sum(65 - F.col("rank")).cast("long").alias("borda"))
    return points.withColumn("place", F.row_number().over(Window.orderBy(F.col("borda").desc(), F.col("f").desc())).cast("long"))


@query(f"""with {LONG}, {METHODS}, t as (select method, list(f) s from ms where rank <= 16 group by method)
 select a.method as method_a, b.method as method_b, cast(len(list_intersect(a.s,b.s)) as bigint) as shared, round(len(list_intersect(a.s,b.s))/len(list_distinct(list_concat(a.s,b.s))),6)+0.0 as jaccard from t a join t b on a.method<b.method""")
def selection_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = method_scores(spark, sf_dir).where("rank <= 16").groupBy("method").agg(F.collect_set("f").alias("s"))
    a, b = t.select(F.col("method").alias("method_a"), F.col("s").alias("sa")), t.select(F.col("method").alias("method_b"), F.col("s").alias("sb"))
    both, either = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return a.join(b, F.col("method_a") < F.col("method_b")).select("method_a", "method_b", both.cast("long").alias("shared"), r6(both / either).alias("jaccard"))


@query(f"""with {LONG}, {METHODS}, q as (select f, count(*)/3.0 fr from ms where rank <= 16 group by f), k as (select sum(fr*fr) s2, sum(fr*(1-fr)*3/2.0) vv from q)
 select round(least(1,greatest(-1,(64*s2-16*16)/(16*(64-16.0)))),6)+0.0 as kuncheva, round(1-(vv/64)/((16/64.0)*(1-16/64.0)),6)+0.0 as nogueira from k""")
def selection_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kuncheva's and Nogueira's indices over three runs that choose 16 of 64."""
    q = method_scores(spark, sf_dir).where("rank <= 16").groupBy("f").agg((F.count("*") / 3).alias("fr"))
    g = q.agg(F.sum(F.col("fr") ** 2).alias("s2"), F.sum(F.col("fr") * (1 - F.col("fr")) * 1.5).alias("vv"))
    p, k = 64.0, 16.0
    kuncheva = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (p * F.col("s2") - k * k) / (k * (p - k))))
    return g.select(r6(kuncheva).alias("kuncheva"), r6(1 - (F.col("vv") / p) / ((k / p) * (1 - k / p))).alias("nogueira"))


@query(f"""with {LONG}, {METHODS}, n as (select method, f, case when max(score) over w > min(score) over w then (score-min(score) over w)/(max(score) over w-min(score) over w) else 0.5 end u, avg(score) over w mu, stddev_pop(score) over w sd, score,
 rank() over (partition by method order by score)+(count(*) over (partition by method, score)-1)/2.0 rk, count(*) over w n from ms window w as (partition by method))
 select method, f, round(u,6)+0.0 as min_max, round((score-mu)/sd,6)+0.0 as z, round((rk-1)/(n-1),6)+0.0 as rank01 from n""")
def chunk_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each chunk (here: method) brought to a common scale in three ways."""
    s = method_scores(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("method"))
    return s.select("method", "f", r6(S.min_max("score", ["method"], 0.5)).alias("min_max"), r6(S.standardised("score", ["method"])).alias("z"), r6((S.avg_rank("score", ["method"]) - 1) / (n - 1)).alias("rank01"))


@query(f"""with {LONG}, {METHODS}, p as (select f, exp(-score) p from ms where method='anova'), r as (select f, p, row_number() over (order by p, f) rk, count(*) over () m from p),
 q as (select f, p, rk, m, least(1.0, min(p*m/rk) over (order by p desc, f desc rows unbounded preceding)) q, 1/greatest(least(p,1),1e-12) e from r),
 e as (select *, row_number() over (order by e desc, f) ek from q), kk as (select coalesce(max(ek) filter (e >= m/(0.5*ek)),0) k from e)
 select f, round(p,6)+0.0 as p, round(q,6)+0.0 as q, ek <= k as ebh from e, kk""")
def fdr_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg q values, and the e-BH selection at level 0.5, of pseudo p-values exp(-F)."""
    p = method_scores(spark, sf_dir).where("method = 'anova'").select("f", F.exp(-F.col("score")).alias("p")).withColumn("all", F.lit(1))
    e = p.withColumns({"q": S.bh_q("p", ["all"], "f"), "e": S.e_value(F.col("p")), "m": F.count("*").over(Window.partitionBy("all"))})
    e = e.withColumn("ek", F.row_number().over(Window.partitionBy("all").orderBy(F.col("e").desc(), "f")))
    k = F.coalesce(F.max(F.when(F.col("e") >= F.col("m") / (0.5 * F.col("ek")), F.col("ek"))).over(Window.partitionBy("all")), F.lit(0))
    return e.select("f", r6("p").alias("p"), r6("q").alias("q"), (F.col("ek") <= k).alias("ebh"))
