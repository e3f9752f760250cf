"""Queries of candidates' and oracles' weights, over the datasets' mean results as candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import weights as W
from ..sources.tables import runs
from .features import METHODS, method_scores
from .registry import LONG, RUNS, query, r6

CAND = f"{RUNS}, cand as (select dataset as name, any_value(tier) as tier, round(avg(ba),6) as w, round(avg(f1),6) as f1, round(avg(sec),6) as sec from runs group by dataset)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6)
    return runs(spark, sf_dir).groupBy(F.col("dataset").alias("name")).agg(F.any_value("tier").alias("tier"), mean("ba").alias("w"), mean("f1").alias("f1"), mean("sec").alias("sec"))


@query(f"with {CAND} select round(greatest(1e-4, greatest(stddev_pop(sec), 0.02, 1e-4)*0.5),6)+0.0 as temperature from cand")
def choice_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.temperature(candidates(spark, sf_dir), "sec", gamma=0.5).select(r6("temperature").alias("temperature"))


@query(f"""with {CAND}, s as (select name, w, avg(w) over () mu, count(*) over () k, count(*) over ()*var_pop(w) over () ss from cand)
 select name, round(case when k <= 2 then w when ss <= 1e-12 then mu else mu + greatest(0,least(1,1-(k-3)*(0.25/30000)/greatest(ss,1e-12)))*(w-mu) end,9)+0.0 as shrunk from s""")
def shrunken_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.james_stein(candidates(spark, sf_dir), "w", 30_000).select("name", (F.round("shrunk", 9) + F.lit(0.0)).alias("shrunk"))


@query(f"with {CAND}, s as (select name, (1-0.4)*(w/sum(w) over ()) + 0.4/count(*) over () as x from cand) select name, round(x/sum(x) over (),9)+0.0 as shrunk from s")
def uniform_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy()))
    return W.towards_uniform(c, "share", 2.0, 3).select("name", (F.round("shrunk", 9) + F.lit(0.0)).alias("shrunk"))


@query(f"""with {CAND}, r as (select rank() over (order by w)+(count(*) over (partition by w)-1)/2.0 a, rank() over (order by f1)+(count(*) over (partition by f1)-1)/2.0 b, rank() over (order by sec)+(count(*) over (partition by sec)-1)/2.0 c from cand),
 k as (select abs(corr(a,b)) ab, abs(corr(a,c)) ac, abs(corr(b,c)) bc from r), u as (select 'w' oracle, greatest(ab,ac) m from k union all select 'f1', greatest(ab,bc) from k union all select 'sec', greatest(ac,bc) from k)
 select oracle, round(m,6)+0.0 as max_rho, round(greatest(0,1-m*m),6)+0.0 as penalty from u""")
def oracle_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.redundancy_penalty(candidates(spark, sf_dir), ["w", "f1", "sec"]).select("oracle", r6("max_rho").alias("max_rho"), r6("penalty").alias("penalty"))


@query(f"""with {CAND}, s as (select w, w/sum(w) over () share from cand), r as (select share, row_number() over (order by w desc, share) rk, count(*) over () n from s),
 c as (select rk, n, round(sum(share) over (order by rk),12) upto, round(share-lead(share) over (order by rk),12) d from r), k as (select min(rk) filter (upto >= 0.85) k_mass, coalesce(arg_min(rk, (-d, rk)) filter (d is not null),1) k_elbow, any_value(n) n from c)
 select k_mass, k_elbow, cast(least(least(12,n),greatest(3,cast(round_even((k_mass+k_elbow)*0.5,0) as bigint))) as bigint) as size from k""")
def adaptive_portfolio_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.portfolio_size(candidates(spark, sf_dir), "w", 3, 12)


@query(f"""with {CAND}, p as (select name, tier='hard' m, w/sum(w) over () p from cand), h as (select *, sum(p) filter (m) over () held, 1-sum(p) filter (m) over () rest from p), s as (select *, least(0.6-held, rest) shift from h)
 select name, round(case when held >= 0.6-1e-12 then p when m then p+shift*p/held else p*(rest-shift)/greatest(rest,1e-12) end,9)+0.0 as prior from s""")
def paradigm_prior_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.prior_floor(candidates(spark, sf_dir), "w", F.col("tier") == "hard", 0.6).select("name", (F.round("prior", 9) + F.lit(0.0)).alias("prior"))


@query(f"""with {CAND}, o as (select name, tier, unnest(['stability','diversity','robustness','complexity','other']) oracle, w from cand),
 fac as (select * from (values ('easy','stability',1.25),('easy','diversity',0.80),('easy','robustness',0.90),('easy','complexity',0.95),('hard','robustness',1.20),('hard','complexity',1.10),('hard','diversity',1.05),('hard','stability',0.95)) t(tier, oracle, x))
 select name, oracle, round(w*coalesce(cast(x as double),1.0),9)+0.0 as adjusted from o left join fac using (tier, oracle)""")
def complexity_adjusted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = candidates(spark, sf_dir).withColumn("oracle", F.explode(F.array(*[F.lit(x) for x in ("stability", "diversity", "robustness", "complexity", "other")])))
    return W.tier_weights(o, "oracle", "w", "tier").select("name", "oracle", (F.round("adjusted", 9) + F.lit(0.0)).alias("adjusted"))


ORACLES = ["pw", "pf1", "psec"]
PREF = f"""{CAND}, pr as (select a.name i, b.name j, 1/(1+exp(-(a.w-b.w)*100)) pw, 1/(1+exp(-(a.f1-b.f1)*100)) pf1, 1/(1+exp(-(a.sec-b.sec))) psec from cand a join cand b on a.name < b.name),
 lg as (select greatest(-20,least(20,ln(pw/(1-pw)))) a, greatest(-20,least(20,ln(pf1/(1-pf1)))) b, greatest(-20,least(20,ln(psec/(1-psec)))) c, (pw+pf1+psec)/3 r from pr)"""
VALUES = PREF + ", cv as (" + " union all ".join(["select cast(0 as bigint) mask, 0.0::double as value"] + [f"select cast({m} as bigint), 1-avg(abs(2/(1+exp(-({e})))-1-r)) from lg" for m, e in ((1, "a"), (2, "b"), (3, "(a+b)/2"), (4, "c"), (5, "(a+c)/2"), (6, "(b+c)/2"), (7, "(a+b+c)/3"))]) + ")"


def _coalitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    a, b = c.select(*[F.col(x).alias(x + "_a") for x in ("name", "w", "f1", "sec")]), c.select(*[F.col(x).alias(x + "_b") for x in ("name", "w", "f1", "sec")])
    pairs = a.join(b, F.col("name_a") < F.col("name_b"))  # pairs of candidates, tens of them
    p = lambda x, s: (1 / (1 + F.exp(-(F.col(x + "_a") - F.col(x + "_b")) * s))).alias("p" + x)
    prefs = pairs.select(p("w", 100), p("f1", 100), p("sec", 1)).withColumn("ref", (F.col("pw") + F.col("pf1") + F.col("psec")) / 3)
    return W.coalition_values(prefs, ORACLES, "ref")


@query(f"with {VALUES} select mask, round(value,6)+0.0 as value from cv")
def coalition_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coalitions(spark, sf_dir).select("mask", r6("value").alias("value"))


@query(f"""with {VALUES}, o as (select * from (values (1,'pw'),(2,'pf1'),(4,'psec')) t(bit, oracle)), g as (select oracle, x.mask, y.value-x.value gain, case bit_count(x.mask) when 0 then 1/3.0::double when 1 then 1/6.0::double else 1/3.0::double end share from cv x join o on x.mask & o.bit = 0 join cv y on y.mask = x.mask + o.bit),
 s as (select oracle, sum(share*gain) shapley, avg(gain) banzhaf from g group by oracle), t as (select *, least(0,min(shapley) over ()) ls, least(0,min(banzhaf) over ()) lb from s)
 select oracle, round(shapley,6)+0.0 as shapley, round(banzhaf,6)+0.0 as banzhaf, round((shapley-ls)/sum(shapley-ls) over (),6)+0.0 as shapley_weight, round((banzhaf-lb)/sum(banzhaf-lb) over (),6)+0.0 as banzhaf_weight from t""")
def oracle_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley and Banzhaf values of the oracles, exact over all coalitions."""
    g = W.power_indices(_coalitions(spark, sf_dir), ORACLES)
    return g.select("oracle", *[r6(c).alias(c) for c in ("shapley", "banzhaf", "shapley_weight", "banzhaf_weight")])


@query(f"""with {LONG}, {METHODS}, r as (select f, list_sort(list(rank/17.0::double)) r from ms where rank <= 16 group by f), x as (select f, coalesce(r[1],1.0) a, coalesce(r[2],1.0) b, coalesce(r[3],1.0) c from r),
 p as (select f, least(1.0, 3*a*(1-a)^2+3*a^2*(1-a)+a^3, 3*b^2*(1-b)+b^3, c^3) p from x) select f, round(p,9)+0.0 as p, round(-log10(greatest(p,1e-12)),6)+0.0 as score from p""")
def robust_rank_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.robust_ranks(method_scores(spark, sf_dir), 16, 3).select("f", (F.round("p", 9) + F.lit(0.0)).alias("p"), r6("score").alias("score"))
