"""Every registered query with SQL gives the rows that DuckDB gives, at the smallest size."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from corvane.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(pdf, names):
    def plain(x):
        if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    data = pdf[names].astype(object)
    return sorted([tuple(map(plain, r)) for r in data.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert len(want), "nothing is compared"
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
