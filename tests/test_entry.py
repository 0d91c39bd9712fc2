"""The registered queries against their SQL on the smallest tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

from marlstone import queries as core

SAMPLE = ["flagship", "grain_week", "filter_not", "agg_mode", "agg_weighted_avg", "having_in", "rolling_filtered", "pop_by_dimension", "cohort_retention_capped", "funnel_3step", "msf_top_percentile", "row_filter_on_top_n", "sql_cte_governed", "materialized_incremental", "quality_check", "access_anomaly", "nl_last_n", "policy_decisions"]


def text(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "NULL" if v is None or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for name in os.listdir(small):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, db, name):
    got = core.QUERIES[name](spark, small).toPandas()
    want = db.sql(core.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert text(got) == text(want)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_file_reader(spark, small):
    """The row filter and the pruned columns are in the scan."""
    e = core.engine(spark, small)
    from marlstone.plans.governance import resolve_identity

    plan = e.explain(resolve_identity(e.catalog, "u", "finance"), {"source": "orders", "metrics": ["gross_revenue"], "dimensions": ["priority"]})["plan"]
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in plan
