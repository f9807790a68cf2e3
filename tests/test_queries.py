"""Every named query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from tessera.plans import queries as plans

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(plans.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert _plain(rows) == _plain([tuple(r[i] for i in at) for r in found.fetchall()])


def test_no_query_needs_a_cross_join(spark):
    for name in ("best_overlap_gt", "contacts", "track_export", "temporal_downsample_tracks", "violations_all"):
        plan = plans.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
