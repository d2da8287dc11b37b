"""Every panel query with SQL gives the same rows on both engines (driver tables at two sizes)."""

import os

import duckdb
import pytest

from panelspark.plans.queries import ORACLE_SQL, QUERIES

SIZES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001,/root/testdata/sf0.01").split(",")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows(spark, name, sf):
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = con.execute(ORACLE_SQL[name])
    assert sorted(d[0] for d in got.description) == columns
    place = [[d[0] for d in got.description].index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in place) for r in got.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert ours == theirs
