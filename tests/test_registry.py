"""The registered queries: names, SQL and one run at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from voxloom import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events embeddings conversations".split()
QUICK = ["fuse", "overlap_summary", "refine_call_center", "idempotent_ingest", "host_waves", "gated_transition"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) - set(oracles.SQL) == {
        "cluster_bisect", "diarise_windows", "diarise_spectral"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample data absent")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([r[c] for c in cols]) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert got == sorted(str([r[at[c]] for c in cols]) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample data absent")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
