"""Physical-plan properties: no Python in any plan, keysets join adds no Exchange, co-bucketed
join has no Exchange below the pair aggregate, theta never collects, filters reach Parquet."""

import pytest
from conftest import SF001

from overlap.operators.buckets import bucket_by_pairs
from overlap.operators.pairs import pair_counts
from overlap.operators.theta import theta_pairs
from overlap.plans.inspect import count_nodes, executed_plan, exchanges
from overlap.plans.catalog import registry
from overlap.sources import fixtures


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    fixtures.locations(spark, SF001).write.parquet(f"{root}/l")
    fixtures.interests(spark, SF001).write.parquet(f"{root}/i")
    return spark.read.parquet(f"{root}/l"), spark.read.parquet(f"{root}/i")


def test_no_python_anywhere(spark):
    for name, fn in registry().items():
        if name.startswith("stream"):
            continue
        plan = executed_plan(fn(spark, SF001))
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                     "MapInPandas", "MapInArrow", "FlatMapGroupsInArrow", "PythonUDF"):
            assert node not in plan, (name, node)


def test_keysets_shuffles_each_side_once(spark, inputs):
    locs, ints = inputs
    plan = executed_plan(pair_counts(locs, ints))
    # one pid shuffle per side (after the map-side collect_set) + the final pair shuffle
    assert exchanges(plan, "pid") == 2
    assert count_nodes(plan, "partial_collect_set") == 2
    assert "IsNotNull(pid)" in plan


def test_bucket_by_join_has_no_exchange_below_pairs(spark, inputs):
    locs, ints = inputs
    df = bucket_by_pairs(spark, locs, ints, 4)
    df.collect()
    plan = executed_plan(df)
    assert "Bucketed: true" in plan
    assert exchanges(plan, "pid") == 0
    assert "SortMergeJoin" in plan


def test_theta_grid_from_sketch_tables_only(spark, inputs):
    locs, ints = inputs
    df = theta_pairs(locs, ints)
    df.collect()
    plan = executed_plan(df)
    assert "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan
    assert count_nodes(plan, "partial_theta_sketch_agg") == 2
    assert exchanges(plan, "pid") == 0  # the raw rows of the two inputs never meet


def test_register_pairs_never_shuffle_exploded_rows(spark, inputs):
    import re

    from overlap.operators.registers import estimate_registers, register_pairs

    locs, ints = inputs
    df = estimate_registers(register_pairs(locs, ints), ["location", "interest"])
    plan = executed_plan(df)
    assert exchanges(plan, "reg") == 1
    # the (pair, reg) aggregate runs where the pair rows are produced
    assert not re.search(r"Exchange hashpartitioning\(location#\d+, interest#\d+, reg#", plan)
