"""What grows with the input stays in step with it: joins with tables of many hot keys, triples of the
textbook join, register groups of a task, pairs a sketch aggregate sorts, inputs read several times."""

import re

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from overlap.operators import buckets
from overlap.operators.blocks import block_pairs, heavy_keys
from overlap.operators.buckets import bucket_by_pairs, bucketed_pairs
from overlap.operators.hll import estimate_hll, hll_pairs
from overlap.operators.pairs import dealt_sets, pair_counts
from overlap.plans.catalog import registry
from overlap.plans.inspect import exchanges, executed_plan


@pytest.fixture(scope="module")
def inputs(spark):
    locs = spark.createDataFrame(
        [("a", ["X", "Y"]), ("a", ["Y", None]), ("b", ["X"]), ("c", []), ("d", None), (None, ["X"])],
        "pid string, locations array<string>")
    ints = spark.createDataFrame(
        [("a", "i"), ("a", "i"), ("a", None), ("b", "i"), ("c", "i"), ("d", "j"), (None, "i")],
        "pid string, interest string")
    return locs, ints


def test_many_hot_keys_are_not_broadcast(spark):
    keys = 10_500
    rows = spark.range(2 * keys).select((F.col("id") % keys).cast("string").alias("pid"),
                                        (F.col("id") >= keys).cast("string").alias("v"))
    left, right = rows.withColumnRenamed("v", "a"), rows.withColumnRenamed("v", "b")
    cold = spark.createDataFrame([("x", "t")], "pid string, v string")
    left = left.unionByName(cold.withColumnRenamed("v", "a"))
    right = right.unionByName(cold.withColumnRenamed("v", "b"))
    hot = heavy_keys(left, right, "pid", 1)
    out = block_pairs(left, right, "pid", "a", "b", hot=hot, chunk=1)
    plan = executed_plan(out)
    assert "Broadcast" not in plan
    assert out.count() == out.distinct().count() == 4 * keys + 1


def test_key_sets_of_small_files_are_not_broadcast(spark, inputs):
    assert "Broadcast" not in executed_plan(pair_counts(*inputs))
    assert "Broadcast" not in executed_plan(bucketed_pairs(*inputs, 2))


def test_few_hot_keys_give_the_same_pairs(inputs):
    want = {tuple(r) for r in pair_counts(*inputs).collect()}
    assert {tuple(r) for r in pair_counts(*inputs, strategy="blocks", chunk=1).collect()} == want


@pytest.mark.parametrize("explode", ["late", "early"])
def test_textbook_join_holds_no_triples(inputs, explode):
    out = pair_counts(*inputs, strategy="join", explode=explode)
    assert not re.search(r"keys=\[location#\d+, interest#\d+, pid#", executed_plan(out))
    assert {tuple(r) for r in out.collect()} == {
        ("X", "i", 2), ("Y", "i", 1), (None, "i", 1), ("X", None, 1), ("Y", None, 1), (None, None, 1)}


def test_bucketed_registers_never_shuffle_exploded_rows(inputs):
    plan = executed_plan(bucketed_pairs(*inputs, 4, mode="registers"))
    assert exchanges(plan, "reg") == 1
    assert not re.search(r"Exchange hashpartitioning\([^)]*location#\d+, interest#\d+, reg#", plan)


def test_groups_of_a_register_lie_in_one_task(spark):
    sets = lambda name: spark.range(400).select(
        F.col("id").cast("string").alias("pid"), F.array(F.lit("u"), F.lit("v")).alias(f"{name}_set"))
    per_key = buckets._per_key("registers", "pid", 7, 6, 1)
    rows = buckets._explode_sets(sets("a"), sets("b"), "pid", "a", "b", [], per_key, "registers")
    tasks = rows.withColumn("task", F.spark_partition_id())
    assert rows.count() == 1600
    assert tasks.groupBy("reg").agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.rdd.getNumPartitions() == wanted  # not fewer because the sets have few bytes


def test_keys_are_dealt_by_their_pairs(spark):
    sets = spark.range(100).select("id", F.sequence(F.lit(1), F.lit(10)).alias("l"),
                                   F.sequence(F.lit(1), F.lit(5)).alias("r"))
    out = dealt_sets(sets, "id", "l", "r", 100)
    assert out.rdd.getNumPartitions() == max(50, spark.sparkContext.defaultParallelism)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sets.collect()))
    assert dealt_sets(sets.where("id < 0"), "id", "l", "r").count() == 0


def test_hll_pairs_are_dealt_before_the_explode(spark, inputs):
    want = {(r[0], r[1]): r[2] for r in pair_counts(*inputs).collect()}
    for out in (hll_pairs(*inputs), bucket_by_pairs(spark, *inputs, 2, mode="hll"),
                bucketed_pairs(*inputs, 2, mode="hll")):
        assert "REPARTITION_BY_NUM" in executed_plan(out)
        assert {(r[0], r[1]): r[2] for r in estimate_hll(out).collect()} == want


@pytest.mark.parametrize("name", ["pair_exact_blocks", "hll_small_pairs", "theta_screened_small_pairs",
                                  "theta_small_pairs", "pair_hll_bucket_by", "pair_hll"])
def test_inputs_are_derived_once(spark, name):
    files = registry()[name](spark, SF001).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]
