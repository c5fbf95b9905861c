"""Queries against their DuckDB SQL on the smallest tables, where those are present."""

import os

import duckdb
import pytest

from meridian.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark embeddings conversations".split()


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    value = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    return sorted(tuple(str(round(x, 5) if isinstance(x := value(r[i]), float) else x) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, D)
    want = con.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), want.columns)
