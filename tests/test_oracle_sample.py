"""A sample of registered queries against their DuckDB oracles at sf0.001 (the full
set runs with ``python tools/oracle_check.py`` at sf0.01), plus the entry smoke test."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cellar.session import TABLES

SF_SMALL = "/root/testdata/sf0.001"

SAMPLE = [
    "agg_groupby_multi",
    "agg_numeric_profile",
    "agg_categorical_profile",
    "agg_corr_matrix",
    "agg_quality_issues",
    "flt_num_ne",
    "flt_duplicates",
    "flt_outliers_iqr",
    "win_running_total_by_user",
    "win_pct_change",
    "win_percentile_rank",
    "tool_fill_backward_by_user",
    "jn_vlookup",
    "jn_match",
    "top_n",
    "cf_top10pct",
    "ch_histogram",
    "ch_box",
    "fn_text",
    "fn_datedif",
    "clean_pipeline",
    "txt_contact",
    "txt_analyze_pages",
    "jn_job_table_match",
    "ins_rows",
]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _multiset(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _table_queries() -> set[str]:
    """The registered queries but those of the optional corpus operators."""
    from cellar.plans.registry import load_all

    return set(load_all())


def test_every_query_has_an_oracle_or_is_documented():
    q, s = _table_queries(), entry.oracle_sql()
    assert set(s) <= set(entry.queries())
    assert q == set(s) & q


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _multiset(sdf.columns, srows) == _multiset(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "l_quantity_sum" in df.columns


def test_no_query_plans_a_cross_join(spark):
    """Every registered query plans without CartesianProduct / nested-loop joins."""
    bad = []
    for name, fn in entry.queries().items():
        if name not in _table_queries():
            continue
        if name.startswith(("src_text", "sink_", "stream_")):  # writers: checked by their oracles
            continue
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []
