"""Every query that has SQL gives what DuckDB gives, on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 6)
    if v.__class__.__name__ == "datetime":
        return str(v)[:19]
    return v


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = query(spark, sf)
    got = df.collect()
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted(repr(tuple(plain(x[c]) for c in order)) for x in got)
    b = sorted(repr(tuple(plain(x[names.index(c)]) for c in order)) for x in r.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, sf, name):
    compare(spark, sf, catalogue.QUERIES[name], catalogue.SQL[name])


def test_a_wrong_query_is_seen(spark, sf):
    with pytest.raises(AssertionError):
        compare(spark, sf, catalogue.QUERIES["authors_summary"], catalogue.SQL["authors_summary"].replace("n > 1)", "n > 100000)"))
