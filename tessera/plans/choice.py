"""Queries that choose rows, features and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import choice as O
from ..operators import features as FO
from ..operators import models as MO
from ..functions import stats as S
from ..sources.tables import matrix, runs, table
from .features import ANOVA, BIN, INFO, METHODS, method_scores
from .registry import LONG, RUNS, query, r6


@query("""with d as (select doc_id, lang, source, length(coalesce(text,'')) as n from documents)
 select doc_id, case when source = 'src0' or lang = 'de' then 'temporal' when lang = 'fr' then 'grouped' else 'iid' end as task_type, case when n < 500 then 5 else 1 end as repeats, case when n < 500 then 5 else 8 end as folds,
 case when greatest(n,1) < 50 or 64/greatest(n,1) > 500 then 'extreme' when greatest(n,1) < 200 and 64/greatest(n,1) > 50 then 'moderate' else 'standard' end as regime, case when contains(lower(coalesce(source,'')),'rna') then 'rnaseq' else 'auto' end as domain from d""")
def row_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task type, inner validation, regime and domain of every document taken as the description of a dataset."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    tags = F.when(F.col("lang") == "de", F.array(F.lit(" Temporal "))).otherwise(F.array(F.lit("other")))
    time, group = F.when(F.col("source") == "src0", "ts"), F.when(F.col("lang") == "fr", "user")
    d = table(spark, sf_dir, "documents").withColumn("v", O.inner_validation(n))
    return d.select("doc_id", O.task_type(tags, group, time).alias("task_type"), "v.*", O.regime(n, F.lit(64)).alias("regime"), O.data_domain(F.col("source")).alias("domain"))


@query("select p_partkey, trim(split_part(trim(p_brand || '__' || p_type), '__', 1)) as base, 'string:' || p_brand as text_key, 'int:' || cast(cast(p_size as integer) as varchar) as number_key from part")
def stable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", O.base_name(F.concat_ws("__", "p_brand", "p_type")).alias("base"), O.typed_key(F.col("p_brand")).alias("text_key"), O.typed_key(F.col("p_size").cast("int")).alias("number_key"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 1 else 0 end as kind, case when o_orderkey % 3 <> 0 then cast(epoch(cast(o_orderdate as date)) as bigint) else -1 end as at, case when o_orderkey % 3 = 0 then o_orderstatus end as text from orders""")
def time_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys of a column in which a third of the values are no times."""
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.to_date("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").withColumn("k", O.time_key(mixed)).select("o_orderkey", F.col("k.kind"), F.coalesce("k.at", F.lit(-1)).alias("at"), F.col("k.text"))


DESC = f"{RUNS}, ds as (select dataset as name, round(avg(ba)*100,6) fisher, round(avg(f1)*10,6) border, round(avg(sec),6) dim, cast(count(distinct method) as bigint) classes, cast(sum(n) as bigint) rows_n from runs group by dataset)"


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = runs(spark, sf_dir).groupBy(F.col("dataset").alias("name"))
    return g.agg(F.round(F.avg("ba") * 100, 6).alias("fisher"), F.round(F.avg("f1") * 10, 6).alias("border"), F.round(F.avg("sec"), 6).alias("dim"), F.count_distinct("method").alias("classes"), F.sum("n").alias("rows_n"))


@query(f"""with {DESC}, s as (select name, greatest(0,least(1,0.30*greatest(0,least(1,border))+0.25/(1+greatest(0,fisher))+0.20*greatest(0,least(1,greatest(0,dim)/greatest(1.0,64.0)))+0.15*greatest(0,least(1,border/2))+0.10*greatest(0,least(1,border/4)))) score, rows_n, classes from ds)
 select name, case when 6400.0/rows_n >= 220 or classes >= 8 or rows_n < 40 then 'very_hard' when 6400.0/rows_n >= 90 or classes >= 5 or 1.0 < 0.45 then 'hard' when 6400.0/rows_n >= 30 or classes >= 3 or 1.0 < 0.7 then 'medium' else 'easy' end as tier,
 round(score,6)+0.0 as complexity, cast(greatest(1,least(6400,round_even(200*(1+0.5*score),0))) as bigint) as top_k from s""")
def dataset_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = descriptors(spark, sf_dir)
    score = O.complexity(F.col("border"), F.col("fisher"), F.col("dim"), F.col("border") / 2, F.col("border") / 4, F.lit(64.0))
    return d.select("name", O.difficulty(6400.0 / F.col("rows_n"), F.col("classes"), F.lit(1.0), F.col("rows_n")).alias("tier"), r6(score).alias("complexity"), O.widened(200, F.lit(6400).cast("long"), score).alias("top_k"))


@query("""with e as (select event_id, greatest(0.0,least(1.0,value/100)) x from events) select event_id, round(case when x <= 0.1 then 0.05 when x < 0.3 then 0.05+(x-0.1)*((0.2-0.05)/(0.3-0.1)) when x < 0.8 then 0.2+(x-0.3)*((0.9-0.2)/(0.8-0.3)) else 0.9 end,6)+0.0 as calibrated from e""")
def calibration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", r6(O.interpolated(F.col("value") / 100, [0.1, 0.3, 0.8], [0.05, 0.2, 0.9])).alias("calibrated"))


@query(f"with {RUNS}, r as (select *, row_number() over (partition by tier order by ba, dataset, seed, method) rk, count(*) over (partition by tier) n from (select *, dataset||seed||method as k from runs)) select tier, k, ba from (select *, row_number() over (partition by tier order by ba, k) r2, count(*) over (partition by tier) n2 from r) where r2 > least(5, n2-1)")
def worst_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select("tier", F.concat("dataset", F.col("seed").cast("string"), "method").alias("k"), "ba")
    return O.trim_worst(r, ["tier"], "ba", "k", 5)


@query(f"""with {LONG}, {METHODS}, own as (select f, min(rank) rank from ms where method = 'auc' and rank <= 8 group by f), vt as (select f, round(sum(0.9^(rank-1)),9) votes from ms group by f),
 u as (select f, 0 kind, cast(rank as double) b from own union all select f, 1, -votes from vt where f not in (select f from own)) select f, row_number() over (order by kind, b, f desc) as place from u order by kind, b, f desc limit 20""")
def padded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = method_scores(spark, sf_dir)
    votes = s.groupBy("f").agg(F.round(F.sum(F.pow(F.lit(0.9), F.col("rank") - 1)), 9).alias("votes"))
    return O.padded(s.where("method = 'auc' and rank <= 8"), votes, 20)


@query(f"""with {LONG}, {METHODS}, sc2 as (select *, coalesce((score-min(score) over w)/nullif(max(score) over w-min(score) over w,0),0) u, case method when 'anova' then 24 when 'auc' then 12 else 6 end b, case method when 'anova' then 1.0 else 0.5 end x from ms window w as (partition by method)),
 gp as (select f, count(*) filter (rank <= b) strategies, round(sum(x*u),9) score from sc2 group by f) select f, strategies, round(score,6)+0.0 as score from gp where strategies > 0 order by gp.score desc, f desc limit 24""")
def strategy_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = O.pooled(method_scores(spark, sf_dir), {"anova": 24, "auc": 12, "variance": 6}, {"anova": 1.0}, 24)
    return p.select("f", "strategies", r6("score").alias("score"))


@query("""with a as (select 'short' as category, p_partkey from part where p_size < 10 order by p_partkey limit 1), b as (select 'large', p_partkey from part where p_size >= 10 and p_partkey not in (select p_partkey from a) order by p_partkey limit 1),
 c as (select 'any', p_partkey from part where p_partkey not in (select p_partkey from a) and p_partkey not in (select p_partkey from b) order by p_partkey limit 1) select * from a union all select * from b union all select * from c""")
def smoke_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each kind of part, none twice: the report is one row for each category by definition."""
    return O.first_of_each(table(spark, sf_dir, "part"), {"short": F.col("p_size") < 10, "large": F.col("p_size") >= 10, "any": F.lit(True)}, ["p_partkey"], "p_partkey")


@query(f"""with {RUNS}, a as (select * from runs where method='A'), b as (select * from runs where method='R'), j as (select a.dataset, a.seed, case when a.n % 2 = b.n % 2 then 'value' else 'error' end c, case when a.n % 2 = b.n % 2 then (case when a.n % 2 = 0 then -1.0 else 1.0 end)*(b.ba-a.ba) else a.f1-b.f1 end d from a join b using (dataset, seed))
 select dataset, seed, c as compared_on, round(d,6)+0.0 as delta, case when abs(d) <= 1e-12 then 'tie' when d > 0 then 'win' else 'loss' end as outcome from j""")
def resolved_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods' results whose direction differs in places, so that errors decide there."""
    r = runs(spark, sf_dir).withColumn("lower", F.col("n") % 2 == 0)
    out = O.signed_outcomes(r.where("method = 'A'"), r.where("method = 'R'"), ["dataset", "seed"], "ba", "f1", "lower")
    return out.select("dataset", "seed", "compared_on", r6("delta").alias("delta"), "outcome")


VAR = "s as (select f, round(var_pop(v),6) score from m group by f)"


@query(f"""with {LONG}, {VAR}, nl as (select score from s order by score, f limit 20), p as (select f, score, (1.0+(select count(*) from nl where nl.score >= s.score))/21 p from s), r as (select *, row_number() over (order by p, score desc, f) rk, count(*) over () mm from p),
 k as (select coalesce(max(rk) filter (round(p,12) <= round(rk*0.2/mm,12)),0) k from r), i as (select *, rk <= k as ins from r, k) select f, round(p,6)+0.0 as p, ins and row_number() over (order by ins desc, score desc, f) <= 12 as chosen from i""")
def conformal_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose scores stand out of the lower tail's, at a target share of false discoveries."""
    s = matrix(spark, sf_dir).groupBy("f").agg(F.round(F.var_pop("v"), 6).alias("score"))
    p = MO.conformal_p(s, O.lower_tail(s, 0.3, 20))
    return O.select_at_fdp(p, 0.2, 12).select("f", r6("p").alias("p"), "chosen")


@query(f"with {LONG}, {METHODS}, q as (select method, cast(count(*) filter (rank <= 4*length(method)) as double) q, cast(count(*) as double) p from ms group by method) select method, round(greatest(0.500001,least(0.99,0.5*(1+q*q/(12.0*p)))),6)+0.0 as threshold from q")
def stability_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = method_scores(spark, sf_dir).groupBy("method").agg(F.count_if(F.col("rank") <= 4 * F.length("method")).cast("double").alias("q"), F.count("*").cast("double").alias("p"))
    return g.select("method", r6(O.stability_threshold(F.col("q"), F.col("p"), 12.0)).alias("threshold"))


@query("""with c as (select event_type, round(value,1) conf, count(*) n, sum(case when hour(ts) < 2 then 1 else 0 end) e from events group by all), r as (select event_type, conf, sum(n) over w n, sum(e) over w e from c window w as (partition by event_type order by conf desc))
 select event_type, min(conf) filter (n >= 30 and round(e/n+sqrt(ln(1/0.1)/(2*n)),12) <= 0.25) as threshold, cast(max(n) filter (n >= 30 and round(e/n+sqrt(ln(1/0.1)/(2*n)),12) <= 0.25) as bigint) as accepted from r group by event_type""")
def group_risk_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.round("value", 1).alias("conf"), "ts")
    return O.risk_thresholds(e, "event_type", "conf", F.hour("ts") < 2, 0.25, 0.1, 30)


@query(f"""with {LONG}, va as (select f, round(var_pop(v),6) var from m group by f), rk as (select *, row_number() over (order by var desc, f) rk from va), re as (select *, ntile(8) over (order by var, f) s from rk where rk > 4),
 q as (select *, row_number() over (partition by s order by sha256(concat_ws(':', cast(f as varchar), '13')), f) q from re) select f, 'variance' as why from rk where rk <= 4 union all select f, 'stratum' from q where q <= 4""")
def descriptor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = matrix(spark, sf_dir).groupBy("f").agg(F.round(F.var_pop("v"), 6).alias("var"))
    return O.strata_sample(v, 40, 13)


@query(f"""with {LONG}, fs as (select distinct f from m), v as (select f, unnest(range(0,5)) as view from fs), o as (select *, case when view = 0 then '' else sha256(concat_ws(':', cast(f as varchar), cast(view as varchar), '17')) end o from v)
 select view, f, row_number() over (partition by view order by o, f) as place, (f)//7 as chunk from o""")
def frozen_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seeded orders of the features, and their chunks of seven neighbours."""
    f = matrix(spark, sf_dir).select("f").distinct()
    return O.permuted_views(f, 5, 17).join(O.chunks(f, 7), "f").select(F.col("view").cast("long").alias("view"), "f", "place", "chunk")


@query(f"""with {LONG}, e as (select f, stddev_pop(v) sd, list_distinct(quantile_cont(v, [0.0,0.2,0.4,0.6,0.8,1.0])) edges from m group by f), i as (select f, sd, edges[2:len(edges)-1] edges from (select f, sd, list_sort(edges) edges from e))
 select row_id, m.f as f, cast(case when sd < 1e-12 then 0 else len(list_filter(edges, lambda x: x <= v)) end as bigint) as bin from m join i on i.f = m.f""")
def rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rank_bins(matrix(spark, sf_dir), 5).select("row_id", "f", "bin")


RANKF = """rm as (select row_id, label, f, rank() over (partition by f order by v)+(count(*) over (partition by f, v)-1)/2.0 v from m), gk as (select f, label, count(v) n, avg(v) mu, var_pop(v) var from rm group by all), hk as (select f, sum(n) n, count(*) k, sum(n*mu)/sum(n) grand, sum(n*var) ssw from gk group by f),
 kw as (select f, (sum(gk.n*(mu-grand)^2)/(any_value(k)-1))/nullif(any_value(ssw)/(any_value(hk.n)-any_value(k)),0) kw from gk join hk using (f) group by f)"""


@query(f"""with {LONG.replace('cast(label as bigint) as label', 'cast(label = 0 as bigint) as label')}, {ANOVA}, {BIN}, {INFO}, {RANKF}, ef as (select f, abs(avg(v) filter (label=1)-avg(v) filter (label=0))/greatest(1e-8, stddev_pop(v)) effect from m group by f),
 pa as (select f, mi, anova.score anova, effect, kw from info join anova using (f) join ef using (f) join kw using (f)),
 s as (select f, 0.75*(0.5625*(mi-min(mi) over ())/(max(mi) over ()-min(mi) over ())+0.4375*(anova-min(anova) over ())/(max(anova) over ()-min(anova) over ())+0.25*(effect-min(effect) over ())/(max(effect) over ()-min(effect) over ()))+0.25*(kw-min(kw) over ())/(max(kw) over ()-min(kw) over ()) s from pa)
 select f, round((s-min(s) over ())/(max(s) over ()-min(s) over ()),6)+0.0 as score from s""")
def binary_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance for one class against the rest, with binned information and F on ranks."""
    m = matrix(spark, sf_dir).withColumn("label", (F.col("label") == 0).cast("long"))
    mi = FO.information(FO.quantile_bins(m, 8)).select("f", "mi")
    ranked = m.withColumn("v", S.avg_rank("v", ["f"]).cast("double"))
    one = F.avg(F.when(F.col("label") == 1, F.col("v"))) - F.avg(F.when(F.col("label") == 0, F.col("v")))
    effect = m.groupBy("f").agg((F.abs(one) / F.greatest(F.lit(1e-8), F.stddev_pop("v"))).alias("effect"))
    parts = mi.join(FO.anova_f(m).withColumnRenamed("score", "anova"), "f").join(effect, "f").join(FO.anova_f(ranked).withColumnRenamed("score", "kw"), "f")
    return O.binary_relevance(parts).select("f", r6("score").alias("score"))


@query(f"""with {DESC}, x as (select name, unnest(['fisher','border','dim']) as descriptor, unnest([fisher,border,dim]) as x from ds), ev as (select descriptor, quantile_cont(x,0.1) lo, quantile_cont(x,0.9) hi, quantile_cont(x,0.75)-quantile_cont(x,0.25) scale from x group by descriptor),
 b as (select name, greatest(lo-x,x-hi,0.0)/greatest(scale,1e-12) b from x join ev using (descriptor)) select name, count(*) filter (b > 0) as outside, round(max(b),6)+0.0 as excess, count(*) filter (b > 0) > 1 and max(b) > 0.2 as fallback from b group by name""")
def envelope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = descriptors(spark, sf_dir).unpivot("name", ["fisher", "border", "dim"], "descriptor", "x")
    q = lambda p: F.percentile("x", F.lit(p))
    env = x.groupBy("descriptor").agg(q(0.1).alias("lo"), q(0.9).alias("hi"), (q(0.75) - q(0.25)).alias("scale"))
    return O.outside_envelope(x, env, 1, 0.2).select("name", "outside", r6("excess").alias("excess"), "fallback")


@query("""with b as (select lang, doc_id//4096 b, sha256(string_agg(sha256(coalesce(text,'')), '' order by doc_id)) h from documents group by all) select lang, sha256(string_agg(h, '' order by b)) as digest from b group by lang""")
def ordered_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ordered_digest(table(spark, sf_dir, "documents"), ["lang"], "doc_id", F.coalesce("text", F.lit("")))


@query(f"""with {RUNS}, a as (select dataset, seed, n from runs where method = 'A'), b as (select dataset, seed, n from runs where method = 'N') select coalesce(a.dataset,b.dataset) as dataset, coalesce(a.seed,b.seed) as seed, case when b.n is null then 'missing' when a.n is null then 'added' when a.n = b.n then 'same' else 'changed' end as status from a full join b on a.dataset=b.dataset and a.seed=b.seed""")
def contract_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return O.contract_differences(r.where("method = 'A'"), r.where("method = 'N'"), ["dataset", "seed"], "n")


@query(f"""with {LONG}, e as (select var_pop(v) as value from m group by f having var_pop(v) > 0), r as (select value, round(sum(value) over (order by value desc rows unbounded preceding)/sum(value) over (),12) upto, row_number() over (order by value desc) rk from e), md as (select median(value) md from e)
 select round(min(rk) filter (upto >= 0.95)/64,6)+0.0 as dims95, round(avg(case when value > md*pow(1+sqrt(64.0/500),2) then 1.0 else 0.0 end),6)+0.0 as signal from r, md""")
def signal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum of a diagonal covariance: features' variances as eigenvalues."""
    v = matrix(spark, sf_dir).groupBy("f").agg(F.var_pop("v").alias("value"))
    return O.signal_share(v, 500, 64).select(r6("dims95").alias("dims95"), r6("signal").alias("signal"))


@query(f"with {RUNS} select tier, dataset, seed, method, ba, row_number() over (partition by tier order by ba desc, dataset, seed, method) as place, row_number() over (order by abs(ba-0.05) desc, dataset, seed, method) as by_distance from runs")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results numbered within tiers from the best, and over all by distance; ties by the keys."""
    keys = ["dataset", "seed", "method"]
    r = runs(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.col("ba").desc(), *keys)).cast("long")
    far = F.row_number().over(Window.orderBy(F.abs(F.col("ba") - 0.05).desc(), *keys)).cast("long")
    return r.select("tier", *keys, "ba", place.alias("place"), far.alias("by_distance"))
