"""Queries against their SQL on the smallest folder, and the registry's names."""

import duckdb
import pytest

import __spark_entry__
from gridloom.plans import oracle, queries

SF = "/root/testdata/sf0.001"
NAMES = [
    "flagship", "validate_input", "regularize", "daily_quality", "baseline", "states", "operating_periods",
    "end_candidates", "local_maxima", "prominence", "peak_nms", "der_peak_events", "fam_rank", "load_shape",
    "entity_daily", "coincidence_daily", "asof_nearest", "cp_3p_cool", "breadth", "peakiness", "meter_interval",
    "parse_ts",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    found = con.execute(oracle.SQL[name])
    assert sorted(x[0] for x in found.description) == cols
    place = [[x[0] for x in found.description].index(c) for c in cols]
    plain = lambda rows: sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(got.select(*cols).collect()) == plain([[r[i] for i in place] for r in found.fetchall()])


def test_all_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
