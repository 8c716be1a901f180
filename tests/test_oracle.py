"""Every registered query with an oracle agrees with DuckDB on sf0.001 (exact values)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import TABLES, rows_of

ORACLES = E.oracle_sql()
# Left to scripts/check_oracle.py: model checks that repeat the fits of a sibling, and the optional operators (tests/llm).
SLOW = {"kmeans_elbow_shape", *(k for k in ORACLES if k.startswith(("cluster_", "coded_")) or "_checks_" in k)}
KEYS = sorted(k for k in ORACLES if k not in SLOW and not k.startswith("op"))


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_oracle_key_is_registered():
    assert set(ORACLES) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_small, con, key):
    sdf = E.queries()[key](spark, sf_small)
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    drec = cur.fetchall()
    srec = [tuple(r) for r in sdf.collect()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srec) == len(drec)
    assert rows_of(sdf.columns, srec) == rows_of(dcols, drec)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "not_churn_1w" in df.columns
