"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import math

import duckdb
import pytest
from stratalake.plans import catalog

from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(rows) == plain(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
