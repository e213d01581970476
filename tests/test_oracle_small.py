"""Registered queries vs their DuckDB oracles on sf0.001 (the driver runs the same at sf0.01)."""

import duckdb
import pytest
from conftest import SF001

from overlap.plans.oracle import TABLES_FOR_ORACLE

import __spark_entry__ as entry_mod

FAST = ["pair_exact", "pair_exact_join", "pair_theta", "theta_sets_location", "pair_approx",
        "register_hll_pairs", "register_hll_merge", "pair_hll", "bucket_exact_one_job",
        "trailing_7d_theta", "trailing_7d_registers", "accuracy_stats", "synth_pair_exact",
        "synth_locations"]


def _norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "NULL" if v is None else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES_FOR_ORACLE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_callable_and_entry_runs(spark):
    qs, os_ = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(os_) <= set(qs)
    df = entry_mod.entry(spark)
    assert df.columns == ["location", "interest", "set_intersection_count"]
    assert df.count() > 0


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, con, name):
    df = entry_mod.queries()[name](spark, SF001)
    res = con.execute(entry_mod.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())
