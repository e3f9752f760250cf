"""Queries of count matrices: users by hour of day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts as O
from ..sources.tables import table
from .registry import query, r6

CELLS = "c as (select user_id as row_id, cast(hour(ts) as bigint) as f, cast(count(*) as double) as v from events group by all)"
FACTORS = f"""{CELLS}, lib as (select row_id, sum(v) lib from c group by row_id), md as (select median(lib) md from lib where lib > 0), rf as (select arg_min(row_id, (abs(lib-md), row_id)) ref from lib, md),
 cl as (select c.*, greatest(lib,1.0) lib from c join lib using (row_id)), bs as (select f, v rv, lib rlib from cl, rf where row_id = ref),
 bo as (select row_id, round(log2(v/lib)-log2(rv/rlib),9) m, round(0.5*(log2(v/lib)+log2(rv/rlib)),9) a, 1/greatest(1/v+1/rv,1e-12) w from cl join bs using (f)),
 qs as (select row_id, quantile_cont(m,[0.3,0.7]) qm, quantile_cont(a,[0.05,0.95]) qa from bo group by row_id),
 ra as (select row_id, greatest(pow(2.0, sum(w*m)/nullif(sum(w),0)),1e-8) ratio from bo join qs using (row_id) where m between round(qm[1],9) and round(qm[2],9) and a between round(qa[1],9) and round(qa[2],9) group by row_id),
 rw as (select row_id, lib*coalesce(ratio,1.0) raw from lib left join ra using (row_id)), sc as (select median(raw) scale from rw where raw > 0), fa as (select row_id, greatest(coalesce(raw/scale,1.0),1e-8) factor from rw, sc)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row_id"), F.hour("ts").cast("long").alias("f")).agg(F.count("*").cast("double").alias("v"))


@query(f"""with {CELLS}, s as (select count(distinct row_id)*count(distinct f) total, count(*) held, count(*) filter (v = round(v)) whole, count(*) filter (v = 0) zero, min(v) least from c),
 t as (select case when total > held then least(least,0.0) else least end as min_value, (whole+total-held)/total as i, (zero+total-held)/total as z from s)
 select round(min_value,6)+0.0 as min_value, round(i,6)+0.0 as integer_share, round(z,6)+0.0 as zero_share, case when i >= 0.7 and z >= 0.2 then 'count_like' else 'not_count_like' end as reason, i >= 0.7 and z >= 0.2 as is_counts from t""")
def count_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return O.detect(c, *O.shape(c)).select(r6("min_value").alias("min_value"), r6("integer_share").alias("integer_share"), r6("zero_share").alias("zero_share"), "reason", "is_counts")


@query(f"with {FACTORS} select row_id, round(factor,6)+0.0 as factor from fa")
def trimmed_size_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.size_factors(cells(spark, sf_dir)).select("row_id", r6("factor").alias("factor"))


@query(f"with {FACTORS} select row_id, f, round(log2(v/factor*1e6+1),5)+0.0 as x from c join fa using (row_id)")
def log_count_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return O.log_counts(c, O.size_factors(c)).select("row_id", "f", (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query(f"with {CELLS}, lib as (select row_id, sum(v) lib from c group by row_id), md as (select median(lib) md from lib) select row_id, f, round(ln(1+v/greatest(lib/md,1e-8)),6)+0.0 as x from c join lib using (row_id), md")
def stabilised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stabilised(cells(spark, sf_dir)).select("row_id", "f", r6("x").alias("x"))


@query(f"""with {FACTORS}, lb as (select distinct row_id, row_id % 2 as label from c), nr as (select count(*) n from lb), sz as (select label, count(*) nc from lb group by label), x as (select f, label, v/factor x from c join fa using (row_id) join lb using (row_id)),
 g as (select f, label, sum(x) s, sum(x*x) ss from x group by all), w as (select f, sum(s)/any_value(n) mean, (sum(ss)-sum(s)^2/any_value(n))/(any_value(n)-1) var from g, nr group by f), al as (select *, greatest((var-mean)/nullif(mean^2,0),1e-8) alpha from w),
 ce as (select al.f, mean, var, alpha, 1/alpha r, nc, coalesce(s,0.0) s from al cross join sz left join g on g.f = al.f and g.label = sz.label)
 select f, round(any_value(mean),6)+0.0 as mean, round(any_value(var),6)+0.0 as var, round(greatest(0,2*sum(s*ln(greatest(s/nc,1e-12)/mean)-(s+nc*r)*ln((r+greatest(s/nc,1e-12))/(r+mean)))),4)+0.0 as lr from ce group by f""")
def count_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood ratios of a negative binomial model with a mean for each class (here: parity of the user number)."""
    c = cells(spark, sf_dir)
    labels = c.select("row_id", (F.col("row_id") % 2).alias("label")).distinct()
    g = O.dispersion_moments(c, O.size_factors(c), labels, O.shape(c)[0])
    return g.select("f", r6("mean").alias("mean"), r6("var").alias("var"), (F.round("lr", 4) + F.lit(0.0)).alias("lr"))
