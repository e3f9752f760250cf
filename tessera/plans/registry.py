"""Registers queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


#: Common table expressions of the SQL side.
LONG = "m as (select vec_id as row_id, cast(label as bigint) as label, unnest(range(len(embedding))) as f, cast(unnest(embedding) as double) as v from embeddings)"
RUNS = """runs as (select p_brand as dataset, cast(year(l_shipdate) as bigint) as seed, l_returnflag as method, round(avg(l_discount), 6) as ba,
 round(avg(l_tax), 6) as f1, round(avg(l_quantity), 6) as sec, count(*) as n, any_value(case when p_brand < 'Brand#2' then 'easy' when p_brand < 'Brand#4' then 'medium' else 'hard' end) as tier
 from lineitem join part on l_partkey = p_partkey group by p_brand, year(l_shipdate), l_returnflag)"""
