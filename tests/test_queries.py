"""Every query that has SQL against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tessera import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, sf_dir, duck, name):
    mine = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(mine) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())
