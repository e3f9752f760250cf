"""Queries over experiment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import results as O
from ..sources.tables import runs, table
from .registry import RUNS, query, r6

KEYS = ["dataset", "seed"]
PAIRS = f"""{RUNS}, pairs as (select a.dataset, a.seed, b.tier, a.ba base, b.ba cand, round(b.ba-a.ba,6) as delta from runs a join runs b using (dataset, seed) where a.method='A' and b.method='R'),
 out as (select *, case when abs(delta) <= 1e-12 then 'tie' when delta > 0 then 'win' else 'loss' end as outcome from pairs)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.paired(runs(spark, sf_dir), F.col("method") == "A", F.col("method") == "R", KEYS, "ba", ["tier"])


@query(f"with {RUNS} select dataset, method, count(*) as n_seeds, round(avg(ba),6)+0.0 as ba_mean, round(stddev_samp(ba),6)+0.0 as ba_std, round(avg(f1),6)+0.0 as f1_mean, round(avg(sec),6)+0.0 as sec_mean from runs group by all")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("dataset", "method").agg(
        F.count("*").alias("n_seeds"), r6(F.avg("ba")).alias("ba_mean"), r6(F.stddev_samp("ba")).alias("ba_std"), r6(F.avg("f1")).alias("f1_mean"), r6(F.avg("sec")).alias("sec_mean")
    )


@query(f"with {RUNS}, s as (select dataset, avg(ba) m from runs group by dataset) select dataset, round(m,6)+0.0 as mean_ba, case when m < 0.0495 then 'below' when m <= 0.0505 then 'within' else 'above' end as status from s")
def published_range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = runs(spark, sf_dir).groupBy("dataset").agg(F.avg("ba").alias("m"))
    return s.select("dataset", r6("m").alias("mean_ba"), F.when(F.col("m") < 0.0495, "below").when(F.col("m") <= 0.0505, "within").otherwise("above").alias("status"))


@query(f"with {PAIRS} select dataset, seed, tier, delta, outcome from out")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("dataset", "seed", "tier", "delta", "outcome")


@query(f"""with {PAIRS} select coalesce(dataset,'all') as dataset, coalesce(tier,'all') as tier, cast(grouping(dataset)*2+grouping(tier) as bigint) as level, count(*) as n_pairs, count(*) filter (outcome='win') as wins, count(*) filter (outcome='tie') as ties,
 count(*) filter (outcome='loss') as losses, round(avg(delta),6)+0.0 as mean_delta, round(median(delta),6)+0.0 as median_delta from out group by grouping sets ((), (dataset), (tier))""")
def subgroup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall and one subgroup at a time in one pass, by grouping sets."""
    g = pairs(spark, sf_dir).groupingSets([[], [F.col("dataset")], [F.col("tier")]], F.col("dataset"), F.col("tier"))
    out = g.agg(F.grouping_id("dataset", "tier").cast("long").alias("level"), *O.outcome_counts(), r6(F.avg("delta")).alias("mean_delta"), r6(F.median("delta")).alias("median_delta"))
    return out.withColumns({"dataset": F.coalesce("dataset", F.lit("all")), "tier": F.coalesce("tier", F.lit("all"))})


@query(f"with {PAIRS} select tier, round(avg(delta),6)+0.0 as mean, round(median(delta),6)+0.0 as median, round(min(delta),6)+0.0 as min, round(max(delta),6)+0.0 as max, count(*) as n from out group by tier")
def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("tier").agg(*[r6(f("delta")).alias(n) for f, n in ((F.avg, "mean"), (F.median, "median"), (F.min, "min"), (F.max, "max"))], F.count("*").alias("n"))


DETECT = f"""{PAIRS}, rr as (select rank() over (order by ba)+(count(*) over (partition by ba)-1)/2.0 ra, rank() over (order by n)+(count(*) over (partition by n)-1)/2.0 rb from runs),
 g1 as (select 'size_correlation' detector, corr(ra,rb) as value, count(*) >= 6 and abs(corr(ra,rb)) >= 0.6 flagged from rr),
 g2 as (select 'tier_imbalance', avg(delta) filter (tier='hard')-least(avg(delta) filter (tier='easy'),avg(delta) filter (tier='medium')), avg(delta) filter (tier='hard')>0 and (avg(delta) filter (tier='easy')<0 or avg(delta) filter (tier='medium')<0) and avg(delta) filter (tier='hard')-least(avg(delta) filter (tier='easy'),avg(delta) filter (tier='medium'))>=0.03 from pairs),
 g3 as (select 'threshold_hugging', max(s), bool_or(n>=5 and s>=0.5) from (select tier, count(*) n, avg(case when abs(delta-case tier when 'easy' then -0.02 when 'medium' then -0.05 else 0 end)<=0.002 then 1.0 else 0.0 end) s from pairs group by tier)),
 g4 as (select 'seed_variance', max(sd), max(sd) > 0.03 from (select dataset, stddev_pop(cand) sd from pairs group by dataset)),
 u as (select dataset, sum(greatest(delta,0)) up from pairs group by dataset), v as (select up, row_number() over (order by up desc, dataset) rk, count(*) over () n from u),
 g5 as (select 'bellwether', sum(up) filter (rk <= ceil(0.2*n))/nullif(sum(up),0), coalesce(sum(up) filter (rk <= ceil(0.2*n))/nullif(sum(up),0)>=0.7,false) from v),
 det as (select * from g1 union all select * from g2 union all select * from g3 union all select * from g4 union all select * from g5)"""


@query(f"with {DETECT} select detector, round(value,6)+0.0 as value, flagged, bool_or(flagged) over () as any_flagged from det")
def gaming_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks that an improvement is real: correlation with size, gain on hard tiers alone, deltas just at the
    tiers' thresholds, unstable seeds, and uplift from few datasets."""
    r, p = runs(spark, sf_dir), pairs(spark, sf_dir)
    rho = O.spearman(r, "ba", "n").select(F.lit("size_correlation").alias("detector"), F.col("rho").alias("value"), ((F.col("n") >= 6) & (F.abs("rho") >= 0.6)).alias("flagged"))
    mean = lambda t: F.avg(F.when(F.col("tier") == t, F.col("delta")))
    t = p.agg(mean("easy").alias("e"), mean("medium").alias("m"), mean("hard").alias("h")).withColumn("gap", F.col("h") - F.least("e", "m"))
    tiers = t.select(F.lit("tier_imbalance"), "gap", (F.col("h") > 0) & ((F.col("e") < 0) | (F.col("m") < 0)) & (F.col("gap") >= 0.03))
    line = F.when(F.col("tier") == "easy", -0.02).when(F.col("tier") == "medium", -0.05).otherwise(0.0)
    hug = p.groupBy("tier").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("delta") - line) <= 0.002).cast("double")).alias("s")).agg(F.max("s").alias("s"), F.bool_or((F.col("n") >= 5) & (F.col("s") >= 0.5)).alias("x"))
    hugging = hug.select(F.lit("threshold_hugging"), "s", "x")
    seeds = p.groupBy("dataset").agg(F.stddev_pop("cand").alias("sd")).agg(F.max("sd").alias("sd")).select(F.lit("seed_variance"), "sd", F.col("sd") > 0.03)
    up = p.groupBy("dataset").agg(F.sum(F.greatest("delta", F.lit(0.0))).alias("up")).withColumn("rk", F.row_number().over(Window.orderBy(F.col("up").desc(), "dataset"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    share = up.agg((F.sum(F.when(F.col("rk") <= F.ceil(0.2 * F.col("n")), F.col("up"))) / F.nullif(F.sum("up"), F.lit(0.0))).alias("s"))
    bell = share.select(F.lit("bellwether"), "s", F.coalesce(F.col("s") >= 0.7, F.lit(False)))
    out = rho.union(tiers).union(hugging).union(seeds).union(bell)
    return out.select("detector", r6("value").alias("value"), "flagged", F.bool_or("flagged").over(Window.partitionBy()).alias("any_flagged"))


@query(f"""with {PAIRS}, d as (select dataset, any_value(tier) tier, avg(delta) m, min(delta) lo from pairs group by dataset), r as (select *, row_number() over (partition by tier order by m, dataset) rk, count(*) over (partition by tier) n from d),
 g as (select tier, avg(m) filter (rk > least(1, n-1)) trimmed, min(lo) worst, avg(m)/nullif(stddev_samp(m),0) dz, case tier when 'easy' then -0.02 when 'medium' then -0.05 else 0 end floor from r group by tier)
 select tier, round(trimmed,6)+0.0 as trimmed_mean, round(worst,6)+0.0 as worst, round(dz,6)+0.0 as cohen_dz, case when worst < -0.1 then 'VETO' when trimmed >= floor then 'PASS' else 'FAIL' end as verdict from g""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tier: the mean of datasets' deltas without the worst one, a veto on catastrophes, and the effect size."""
    d = pairs(spark, sf_dir).groupBy("dataset").agg(F.any_value("tier").alias("tier"), F.avg("delta").alias("m"), F.min("delta").alias("lo"))
    w = Window.partitionBy("tier")
    d = d.withColumns({"rk": F.row_number().over(w.orderBy("m", "dataset")), "n": F.count("*").over(w)})
    g = d.groupBy("tier").agg(F.avg(F.when(F.col("rk") > F.least(F.lit(1), F.col("n") - 1), F.col("m"))).alias("t"), F.min("lo").alias("w"), (F.avg("m") / F.nullif(F.stddev_samp("m"), F.lit(0.0))).alias("dz"))
    floor = F.when(F.col("tier") == "easy", -0.02).when(F.col("tier") == "medium", -0.05).otherwise(0.0)
    verdict = F.when(F.col("w") < -0.1, "VETO").when(F.col("t") >= floor, "PASS").otherwise("FAIL")
    return g.select("tier", r6("t").alias("trimmed_mean"), r6("w").alias("worst"), r6("dz").alias("cohen_dz"), verdict.alias("verdict"))


@query(f"""with {PAIRS}, i as (select dataset, delta, row_number() over (partition by dataset order by delta, seed) k from pairs), h as (select a.dataset, median((a.delta+b.delta)/2) s from i a join i b on a.dataset=b.dataset and a.k<=b.k group by a.dataset),
 nz as (select dataset, delta, rank() over (partition by dataset order by abs(delta))+(count(*) over (partition by dataset, abs(delta))-1)/2.0 rk from pairs where abs(delta) > 1e-12),
 rb as (select dataset, sum(case when delta>0 then rk else -rk end)/sum(rk) rb from nz group by dataset), c as (select dataset, avg(delta)/nullif(stddev_samp(delta),0) d from pairs group by dataset)
 select dataset, round(s,8)+0.0 as hodges_lehmann, round(rb,6)+0.0 as rank_biserial, round(d,6)+0.0 as cohen_d from h left join rb using(dataset) join c using(dataset)""")
def contrast_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    h = O.hodges_lehmann(p, ["dataset"], "delta", "seed")
    nz = p.where(F.abs("delta") > O.TIE).withColumn("size", F.abs("delta")).withColumn("rk", S.avg_rank("size", ["dataset"]))
    rb = nz.groupBy("dataset").agg((F.sum(F.when(F.col("delta") > 0, F.col("rk")).otherwise(-F.col("rk"))) / F.sum("rk")).alias("rb"))
    c = p.groupBy("dataset").agg((F.avg("delta") / F.nullif(F.stddev_samp("delta"), F.lit(0.0))).alias("d"))
    return h.join(rb, "dataset", "left").join(c, "dataset").select("dataset", (F.round("shift", 8) + F.lit(0.0)).alias("hodges_lehmann"), r6("rb").alias("rank_biserial"), r6("d").alias("cohen_d"))


@query(f"with {RUNS}, b as (select *, row_number() over (partition by dataset, seed order by ba desc, method) rk from runs) select dataset, seed, method, ba, 'official' as origin from runs union all select dataset, seed, 'best_of_all', ba, 'synthetic' from b where rk=1")
def append_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows and, for each dataset and seed, the winner as a synthetic method."""
    r = runs(spark, sf_dir)
    best = O.best_by_group(r, KEYS, "ba", ["method"]).select("dataset", "seed", F.lit("best_of_all").alias("method"), "ba", F.lit("synthetic").alias("origin"))
    return r.select("dataset", "seed", "method", "ba", F.lit("official").alias("origin")).unionByName(best)


@query(f"with {RUNS}, d as (select dataset, seed, method, max(ba) over (partition by dataset, seed)-ba as regret from runs) select method, round(avg(regret),6)+0.0 as mean_regret, round(max(regret),6)+0.0 as max_regret from d group by method")
def fold_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = runs(spark, sf_dir).withColumn("regret", F.max("ba").over(Window.partitionBy(*KEYS)) - F.col("ba"))
    return d.groupBy("method").agg(r6(F.avg("regret")).alias("mean_regret"), r6(F.max("regret")).alias("max_regret"))


@query(f"with {RUNS}, r as (select method, ba, row_number() over (partition by method order by ba, dataset||seed) rk, count(*) over (partition by method) n from runs) select method, round(avg(ba),6)+0.0 as cvar from r where rk <= greatest(1, ceil(0.2*n)) group by method")
def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("id", F.concat("dataset", F.col("seed").cast("string")))
    return O.tail_mean(r, ["method"], "ba", 0.2, "id").select("method", r6("cvar").alias("cvar"))


ROUTER = f"""{RUNS}, def as (select dataset, seed, avg(ba) dba, avg(f1) df1 from runs where method='A' group by all), j as (select s.dataset, s.seed, coalesce(s.ba, dba) ba, coalesce(s.f1, df1) f1, dba, df1 from runs s left join def using(dataset, seed) where s.method='N'),
 u as (select *, 0.7*ba+0.3*f1 su, 0.7*dba+0.3*df1 du from j)"""


@query(f"with {ROUTER} select dataset, seed, round(su,8)+0.0 as utility, round(su-du,8)+0.0 as delta_utility, round(ba-dba,6)+0.0 as delta_ba from u")
def router_realized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    d = r.where("method = 'A'").groupBy(*KEYS).agg(F.avg("ba").alias("dba"), F.avg("f1").alias("df1"))
    j = r.where("method = 'N'").join(d, KEYS, "left").withColumns({"ba": F.coalesce("ba", "dba"), "f1": F.coalesce("f1", "df1")})
    su, du = 0.7 * F.col("ba") + 0.3 * F.col("f1"), 0.7 * F.col("dba") + 0.3 * F.col("df1")
    return j.select("dataset", "seed", (F.round(su, 8) + F.lit(0.0)).alias("utility"), (F.round(su - du, 8) + F.lit(0.0)).alias("delta_utility"), r6(F.col("ba") - F.col("dba")).alias("delta_ba"))


@query(f"""with {ROUTER}, h as (select count(*) n, count(*) filter (round(su-du,8)>0) w, avg(su-du) m, count(*) filter (round(ba-dba,6) < -0.01) harm from u),
 p as (select *, w/n p from h) select n, w as wins, round(m,6)+0.0 as mean_delta, harm, round(greatest(0,(p+1.96*1.96/(2*n)-1.96*sqrt((p*(1-p)+1.96*1.96/(4*n))/n))/(1+1.96*1.96/n)),6)+0.0 as wilson_lower, round(least(1, harm/n+sqrt(-ln(0.05)/(2*n))),6)+0.0 as harm_upper from p""")
def router_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = router_realized_scores(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("delta_utility") > 0).alias("w"), F.avg("delta_utility").alias("m0"), F.count_if(F.col("delta_ba") < -0.01).alias("harm"))
    r = runs(spark, sf_dir)
    j = r.where("method = 'N'").join(r.where("method = 'A'").select(*KEYS, F.col("ba").alias("dba"), F.col("f1").alias("df1")), KEYS, "left")
    m = j.agg(F.avg(0.7 * F.col("ba") + 0.3 * F.col("f1") - (0.7 * F.col("dba") + 0.3 * F.col("df1"))).alias("m"))
    return u.crossJoin(F.broadcast(m)).select("n", F.col("w").alias("wins"), r6("m").alias("mean_delta"), "harm", r6(S.wilson_lower(F.col("w"), F.col("n"))).alias("wilson_lower"), r6(S.hoeffding_upper(F.col("harm"), F.col("n"), 0.05)).alias("harm_upper"))  # one row


@query(f"with {RUNS}, s as (select dataset source, avg(ba) b from runs group by 1) select round(avg(b),6)+0.0 as mean_ba, round(min(b),6)+0.0 as worst_ba, arg_min(source, round(b,6)) as worst_source, count(*) as n_sources, count(*)=25 as complete from s")
def external_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and worst over sources, never pooled over rows."""
    s = runs(spark, sf_dir).groupBy("dataset").agg(F.avg("ba").alias("b"))
    return s.agg(r6(F.avg("b")).alias("mean_ba"), r6(F.min("b")).alias("worst_ba"), F.min_by("dataset", F.round("b", 6)).alias("worst_source"), F.count("*").alias("n_sources"), (F.count("*") == 25).alias("complete"))


@query("""with p as (select l_returnflag t, l_linestatus, case when l_quantity > 30 then 'A' when l_discount > 0.05 then 'N' else 'R' end y from lineitem),
 a as (select l_linestatus, t l, count(*) n, count(*) filter (t=y) tp from p group by all), g as (select l_linestatus, y l, count(*) p from p group by all)
 select l_linestatus, round(avg(tp/n),6)+0.0 as balanced_accuracy, round(avg(2*tp/(n+coalesce(p,0))),6)+0.0 as macro_f1 from a left join g using (l_linestatus, l) group by l_linestatus""")
def classification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("l_quantity") > 30, "A").when(F.col("l_discount") > 0.05, "N").otherwise("R")
    p = table(spark, sf_dir, "lineitem").withColumn("y", y)
    return O.confusion_scores(p, "l_returnflag", "y", ["l_linestatus"]).select("l_linestatus", r6("balanced_accuracy").alias("balanced_accuracy"), r6("macro_f1").alias("macro_f1"))


@query("""with p as (select (l_quantity % 50)/50 conf, case when l_returnflag='A' then 1.0 else 0.0 end as correct from lineitem), b as (select least(floor(conf*10),9) bin, count(*) n, avg(conf) c, avg(correct) a from p group by 1)
 select round(sum(n*abs(c-a))/sum(n),6)+0.0 as ece, count(*) as bins from b""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") % 50 / 50).alias("conf"), (F.col("l_returnflag") == "A").cast("double").alias("ok"))
    b = p.groupBy(F.least(F.floor(F.col("conf") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("ok").alias("a"))
    return b.agg(r6(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.count("*").alias("bins"))


PREF = f"""{RUNS}, pf as (select a.method i, b.method j, avg(case when abs(a.ba-b.ba) <= 0.0005 then 0.5 when a.ba > b.ba then 1.0 else 0.0 end) p from runs a join runs b using (dataset, seed) where a.method <> b.method group by all)"""


@query(f"with {PREF} select i, j, round(p,6)+0.0 as p from pf")
def fold_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one candidate beats another on the same fold; close scores count half."""
    return _preferences(spark, sf_dir).select("i", "j", r6("p").alias("p"))


def _preferences(spark: SparkSession, sf_dir: str, metric: str = "ba") -> DataFrame:
    r = runs(spark, sf_dir)
    a, b = r.select(*KEYS, F.col("method").alias("i"), F.col(metric).alias("x")), r.select(*KEYS, F.col("method").alias("j"), F.col(metric).alias("y"))
    p = F.when(F.abs(F.col("x") - F.col("y")) <= 0.0005, 0.5).when(F.col("x") > F.col("y"), 1.0).otherwise(0.0)
    return a.join(b, KEYS).where("i <> j").groupBy("i", "j").agg(F.avg(p).alias("p"))


@query(f"with {RUNS}, s as (select method, avg(ba) v from runs group by 1), q as (select greatest(stddev_pop(v), 0.0001) t from s) select a.method as i, b.method as j, round(case when abs(a.v-b.v) <= 0.00001 then 0.5 else 1/(1+exp(-greatest(-50,least(50,(a.v-b.v)/t)))) end,6)+0.0 as p from s a join s b on a.method<>b.method, q")
def scalar_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = runs(spark, sf_dir).groupBy("method").agg(F.avg("ba").alias("v"))
    t = s.agg(F.greatest(F.stddev_pop("v"), F.lit(1e-4)).alias("t"))
    a, b = s.select(F.col("method").alias("i"), F.col("v").alias("x")), s.select(F.col("method").alias("j"), F.col("v").alias("y"))
    return a.join(b, F.col("i") != F.col("j")).crossJoin(F.broadcast(t)).select("i", "j", r6(S.scalar_preference(F.col("x"), F.col("y"), 1e-5, F.col("t"))).alias("p"))  # one row


PAYOFF = f"""{RUNS}, o as (select 'ba' oracle, a.method i, b.method j, avg(case when abs(a.ba-b.ba) <= 0.0005 then 0.5 when a.ba > b.ba then 1.0 else 0.0 end) p from runs a join runs b using (dataset, seed) where a.method <> b.method group by all
 union all select 'f1', a.method, b.method, avg(case when abs(a.f1-b.f1) <= 0.0005 then 0.5 when a.f1 > b.f1 then 1.0 else 0.0 end) from runs a join runs b using (dataset, seed) where a.method <> b.method group by all),
 tr as (select oracle, i, j, 0.95*p+0.025 p from o), w as (select *, case oracle when 'ba' then 0.7 else 0.3 end wt from tr), z as (select i, j, greatest(-20,least(20,sum(wt*ln(p/(1-p))))) z from w group by all), pay as (select i, j, 2/(1+exp(-z))-1 a from z)"""


@query(f"with {PAYOFF} select i, j, round(a,6)+0.0 as payoff from pay")
def payoff_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two oracles' preferences, trembled by 0.05 and combined as weighted logits into an antisymmetric payoff."""
    return _payoff(spark, sf_dir).select("i", "j", r6("a").alias("payoff"))


def _payoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _preferences(spark, sf_dir).withColumn("w", F.lit(0.7)).union(_preferences(spark, sf_dir, "f1").withColumn("w", F.lit(0.3)))
    p = 0.95 * F.col("p") + 0.025
    z = o.groupBy("i", "j").agg(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.sum(F.col("w") * F.ln(p / (1 - p))))).alias("z"))
    return z.select("i", "j", (2 / (1 + F.exp(-F.col("z"))) - 1).alias("a"))


@query(f"with {PAYOFF}, v as (select var_samp(a) vs from pay where i < j) select i, j, round(a*0.04/(0.04+vs),6)+0.0 as payoff from pay, v")
def shrunken_payoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payoff shrunk by kappa^2 / (kappa^2 + sample variance above the diagonal), kappa 0.2."""
    a = _payoff(spark, sf_dir)
    v = a.where("i < j").agg(F.var_samp("a").alias("vs"))
    return a.crossJoin(F.broadcast(v)).select("i", "j", r6(F.col("a") * 0.04 / (0.04 + F.col("vs"))).alias("payoff"))  # one row


_STEP = "select i, p*exp(0.5*coalesce((select sum(a*q.p) from pay join {t} q on q.i=pay.j where pay.i={t}.i),0)-0.1*ln(p*3)) u from {t}"


def _descent_sql(steps: int) -> str:
    out = [PAYOFF, "t0 as (select distinct method as i, 1/3.0::double p from runs)"]
    for k in range(steps):
        out.append(f"s{k} as ({_STEP.format(t=f't{k}')}), t{k + 1} as (select i, u/sum(u) over () p from s{k})")
    return "with " + ", ".join(out) + f" select i as method, round(p,6)+0.0 as weight from t{steps}"


@query(_descent_sql(5))
def mirror_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps of p <- p exp(eta A p - lambda ln(p / ref)) on the payoff between candidates (a matrix of candidates, which
    are few, is read to the driver; the steps run there)."""
    rows = _payoff(spark, sf_dir).collect()  # candidates squared
    names = sorted({r.i for r in rows})
    p = {n: 1 / len(names) for n in names}
    import math

    for _ in range(5):
        gain = {n: sum(r.a * p[r.j] for r in rows if r.i == n) for n in names}
        u = {n: p[n] * math.exp(0.5 * gain[n] - 0.1 * math.log(p[n] * len(names))) for n in names}
        total = sum(u.values())
        p = {n: x / total for n, x in u.items()}
    return spark.createDataFrame(list(p.items()), "method string, weight double").select("method", r6("weight").alias("weight"))


@query(f"""with {RUNS}, keys as (select distinct dataset, seed from runs), want as (select k.dataset, k.seed, m.method from keys k, (values ('A'),('N'),('R'),('X')) m(method))
 select w.dataset, w.seed, w.method, r.method is not null as done, case when r.method is null then 'missing' else 'ok' end as status from want w left join runs r using (dataset, seed, method)""")
def plan_against_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's jobs with their status: those without a result are reported, not dropped."""
    r = runs(spark, sf_dir)
    plan = r.select(*KEYS).distinct().withColumn("method", F.explode(F.array(*[F.lit(x) for x in "ANRX"])))
    j = plan.join(r.select(*KEYS, "method", F.lit(True).alias("hit")), [*KEYS, "method"], "left")
    return j.select(*KEYS, "method", F.coalesce("hit", F.lit(False)).alias("done"), F.when(F.col("hit"), "ok").otherwise("missing").alias("status"))


@query(f"with {RUNS} select dataset, seed, method, ba, n from runs where exists (select 1 from part where p_brand = dataset and p_size > 49) order by dataset, seed")
def core_task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = table(spark, sf_dir, "part").where("p_size > 49").select(F.col("p_brand").alias("dataset"))
    return runs(spark, sf_dir).join(core, "dataset", "left_semi").select("dataset", "seed", "method", "ba", "n").orderBy("dataset", "seed")


@query(f"with {RUNS} select dataset, round(avg(ba) filter (method='A'),6)+0.0 as a, round(avg(ba) filter (method='N'),6)+0.0 as n, round(avg(ba) filter (method='R'),6)+0.0 as r from runs group by dataset")
def profile_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = runs(spark, sf_dir).groupBy("dataset").pivot("method", ["A", "N", "R"]).agg(r6(F.avg("ba")))
    return p.select("dataset", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))
