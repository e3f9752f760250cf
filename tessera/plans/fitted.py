"""Queries that fit on four fifths of the rows and apply to all of them; batch 2 is unknown to the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fitted as O
from ..sources.tables import matrix
from .registry import LONG, query, r6

BATCHED = f"{LONG}, bm as (select *, row_id % 3 as batch from m), tr as (select * from bm where row_id % 5 <> 0 and batch <> 2)"
GRID = "[" + ",".join(repr(0.01 + 0.98 * i / 20) for i in range(21)) + "]"


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = matrix(spark, sf_dir).withColumn("batch", F.col("row_id") % 3)
    return rows, rows.where("row_id % 5 <> 0 and batch <> 2")


@query(f"with {BATCHED}, g as (select f, avg(v) mu, case when stddev_pop(v) > 0 then stddev_pop(v) else 1 end sd from tr group by f) select row_id, bm.f as f, round((v-mu)/sd,6)+0.0 as scaled from bm join g on g.f = bm.f")
def fitted_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _rows(spark, sf_dir)
    return O.apply_scale(rows, O.fit_scale(train)).select("row_id", "f", r6("scaled").alias("scaled"))


MODEL = "g as (select f, avg({x}) mu, stddev_samp({x}) sd from tr group by f), b as (select batch, f, avg({x}) bm, stddev_samp({x}) bs, count(*) n from tr group by all), p as (select batch, b.f f, mu, n/(n+10.0)*(bm-mu) gamma, greatest(0.2,least(5,1+n/(n+10.0)*(coalesce(bs/nullif(sd,0),1)-1))) delta from b join g on g.f = b.f)"


@query(f"with {BATCHED}, {MODEL.format(x='v')} select row_id, bm.f as f, p.mu is not null as known, round(case when p.mu is null then v else (v-mu-gamma)/delta+mu end,6)+0.0 as adjusted from bm left join p on p.f = bm.f and p.batch = bm.batch")
def fitted_combat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _rows(spark, sf_dir)
    return O.apply_batches(rows, O.fit_batches(train, 10.0)).select("row_id", "f", "known", r6("adjusted").alias("adjusted"))


@query(f"""with {BATCHED.replace('cast(unnest(embedding) as double)', 'abs(cast(unnest(embedding) as double))*10')}, {MODEL.format(x='ln(1+greatest(v,0))')}
 select row_id, bm.f as f, round(case when p.mu is null then v else greatest(0,exp((ln(1+greatest(v,0))-mu-gamma)/delta+mu)-1) end,5)+0.0 as adjusted from bm left join p on p.f = bm.f and p.batch = bm.batch""")
def fitted_combat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on log(1 + x) of non-negative values."""
    rows, train = (d.withColumn("v", F.abs("v") * 10) for d in _rows(spark, sf_dir))
    return O.apply_batches(rows, O.fit_batches(train, 10.0, log=True), log=True).select("row_id", "f", (F.round("adjusted", 5) + F.lit(0.0)).alias("adjusted"))


@query(f"""with {BATCHED}, g as (select f, avg(v) mu, stddev_samp(v) sd from tr group by f), b as (select batch, f, avg(v) bm, stddev_samp(v) bs from tr group by all), p as (select batch, b.f f, bm m0, case when bs > 0 then bs else sd end bs, mu, sd from b join g on g.f = b.f)
 select row_id, bm.f as f, round(case when p.mu is null then v else coalesce((v-m0)/nullif(bs,0)*sd,0)+mu end,6)+0.0 as adjusted from bm left join p on p.f = bm.f and p.batch = bm.batch""")
def fitted_center_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _rows(spark, sf_dir)
    return O.apply_centres(rows, O.fit_centres(train)).select("row_id", "f", r6("adjusted").alias("adjusted"))


@query(f"""with {BATCHED}, g as (select f, quantile_cont(v, {GRID}) whole from tr group by f), b as (select batch, f, quantile_cont(v, {GRID}) own from tr group by all), p as (select batch, b.f f, own, whole from b join g on g.f = b.f),
 j as (select row_id, bm.f f, v, own, whole, least(greatest(len(list_filter(own, lambda q: q <= v)),1),20) i from bm left join p on p.f = bm.f and p.batch = bm.batch),
 k as (select *, greatest(0,least(1,coalesce((v-own[i])/nullif(own[i+1]-own[i],0),0))) part from j)
 select row_id, f, round(case when own is null then v when own[21]-own[1] <= 1e-12 then v+whole[11]-own[11] else whole[i]+part*(whole[i+1]-whole[i]) end,5)+0.0 as adjusted from k""")
def fitted_quantile_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _rows(spark, sf_dir)
    return O.apply_quantiles(rows, O.fit_quantiles(train)).select("row_id", "f", (F.round("adjusted", 5) + F.lit(0.0)).alias("adjusted"))


@query(f"""with {BATCHED}, n as (select f, count(*) n from tr group by f), c as (select f, v, count(*) c from tr group by all), d as (select distinct f, v from m), j as (select d.f, d.v, coalesce(c.c,0) c from d left join c on c.f = d.f and c.v = d.v),
 k as (select f, v, sum(c) over (partition by f order by v) upto, c from j), p as (select k.f, v, greatest(0.5/n,least(1-0.5/n,(2*upto-c)/(2.0*n))) p from k join n on n.f = k.f) select row_id, m.f as f, round(p,6)+0.0 as p from m join p on p.f = m.f and p.v = m.v""")
def fitted_mid_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _rows(spark, sf_dir)
    return O.apply_ecdf(rows, O.fit_ecdf(train)).select("row_id", "f", r6("p").alias("p"))
