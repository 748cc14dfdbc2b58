"""Every registered query against its SQL on the supplied tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else v


def rows(data):
    return sorted([tuple(plain(v) for v in r) for r in data], key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = rows(df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLES:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    assert got == rows(con.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
