"""Every layout query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from foliograph import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(a, b):
    """Numbers by value, all else as it reads."""
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == pytest.approx(b, rel=1e-9, abs=1e-9)
    return str(a) == str(b)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.execute(plans.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert len(got) == len(want) and all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
