"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomgraph.plans import code_files, evaluated, indexed, registry, rowwise

QUERIES = registry.queries() | code_files.queries() | evaluated.queries() | indexed.queries() | rowwise.queries()
ORACLES = registry.oracle_sql() | code_files.ORACLES | evaluated.ORACLES | indexed.ORACLES | rowwise.ORACLES


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    twin = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(twin.columns)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([norm(r[twin.columns.index(c)]) for c in cols]) for r in twin.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_imports_without_training_data(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if "llm" in name else real(name, *a))
    assert "pipeline" not in entry.queries()
    assert "sparse_topk" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
