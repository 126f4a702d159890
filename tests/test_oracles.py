"""Every query of the library against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from loreframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.item() if hasattr(v, "item") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert df.columns
        return
    cursor = oracle.execute(catalog.ORACLES[name])
    columns = [x[0] for x in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    at = [columns.index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in expected), key=repr)
