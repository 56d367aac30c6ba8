"""Every registered query against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from splitforge import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([value(r[k]) for k in order] for r in records)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    con.execute(f"create or replace view oracle as {plans.ORACLE_SQL[name]}")
    found = con.execute("select * from oracle")
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


def test_every_sql_has_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["run", "split", "n_rows", "n_groups", "fraction"] and out.count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
