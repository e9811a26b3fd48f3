"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from core_data import SF_SMOKE

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def canon(df):
    df = df[sorted(df.columns)]
    out = []
    for rec in df.itertuples(index=False, name=None):
        row = []
        for v in rec:
            if v is None or v is pd.NA or v != v:
                row.append(None)
            elif isinstance(v, (int, float, np.number)) and not isinstance(v, bool):
                row.append(float(f"{v:.12g}"))
            else:
                row.append(v)
        out.append(tuple(row))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "rolling_flux" in df.columns


def test_oracle_keys_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, con, key):
    got = entry.queries()[key](spark, SF_SMOKE).toPandas()
    exp = con.execute(entry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert canon(got) == canon(exp)
