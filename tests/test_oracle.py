"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) if v % 1 else int(v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=repr)
    assert [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in got] == [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in want]


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("driver tables are absent")
    assert entry.entry(spark).columns == ["doc_id", "score"]
