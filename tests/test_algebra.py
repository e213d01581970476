"""Merge algebra: order-insensitive, idempotent, partition-invariant; bucket sums = exact;
approximation bounds against the exact count on the TPC-H-derived fixture (sf0.001)."""

import math

import pytest
from conftest import SF001, as_dict
from pyspark.sql import functions as F

from overlap.operators.buckets import bucketed_pairs
from overlap.operators.daily import daily_sketches, trailing_exact, trailing_uniques
from overlap.operators.hll import estimate_hll, hll_pairs, merge_hll
from overlap.operators.pairs import pair_counts
from overlap.operators.registers import (estimate_registers, merge_registers, register_hll,
                                          register_pairs)
from overlap.operators.theta import merge_theta_sets, theta_pair_counts, theta_sets
from overlap.sources import fixtures


@pytest.fixture(scope="module")
def fx(spark):
    locs = fixtures.locations(spark, SF001).cache()
    ints = fixtures.interests(spark, SF001).cache()
    exact = pair_counts(locs, ints).cache()
    return locs, ints, exact


def test_registers_partition_invariant(spark, fx):
    _, ints, _ = fx
    one_shot = estimate_registers(register_hll(ints, ["interest"]), ["interest"])
    parts = [register_hll(ints.where(F.pmod(F.hash("pid"), F.lit(3)) == i), ["interest"])
             for i in range(3)]
    merged = parts[2].unionByName(parts[0]).unionByName(parts[1])
    again = merge_registers(merged.unionByName(merged), ["interest"])  # idempotent
    assert as_dict_i(estimate_registers(again, ["interest"])) == as_dict_i(one_shot)


def as_dict_i(df):
    return {r.interest: r.estimate for r in df.collect()}


def test_theta_union_of_partials_equals_one_shot(spark, fx):
    _, ints, _ = fx
    whole = theta_sets(ints, dim="interest", lg_nom=14)
    halves = [theta_sets(ints.where(F.pmod(F.hash("pid"), F.lit(2)) == i), dim="interest",
                         lg_nom=14) for i in range(2)]
    merged = merge_theta_sets(halves[1].unionByName(halves[0]), dim="interest", lg_nom=14)
    est = lambda d: {r.interest: r.n for r in d.select(
        "interest", F.theta_sketch_estimate("sketch").alias("n")).collect()}
    assert est(whole) == est(merged)


def test_bucket_sums_equal_exact(fx):
    locs, ints, exact = fx
    want = as_dict(exact, "distinct_count")
    for n in (1, 7, 64):
        assert as_dict(bucketed_pairs(locs, ints, n, mode="exact"), "distinct_count") == want


def test_theta_exact_regime_matches_exact(fx):
    locs, ints, exact = fx
    ls = theta_sets(locs, dim="locations", name="location", is_array=True, lg_nom=12)
    rs = theta_sets(ints, dim="interest", lg_nom=12)
    got = as_dict(theta_pair_counts(ls, rs, include_zero_pairs=False), "set_intersection_count")
    assert got == {k: float(v) for k, v in as_dict(exact, "distinct_count").items()}


def test_hll_within_bound_and_buckets_merge(fx):
    locs, ints, exact = fx
    want = as_dict(exact, "distinct_count")
    one = as_dict(estimate_hll(hll_pairs(locs, ints), out="n"), "n")
    partials = bucketed_pairs(locs, ints, 5, mode="hll", keep_buckets=True)
    merged = as_dict(estimate_hll(merge_hll(partials, ["location", "interest"]), out="n"), "n")
    rse = 1.04 / math.sqrt(2 ** 13)
    for got in (one, merged):
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert abs(got[k] - v) <= max(1, 5 * rse * v), (k, got[k], v)


def test_approx_and_registers_within_bound(fx):
    locs, ints, exact = fx
    want = as_dict(exact, "distinct_count")
    approx = as_dict(pair_counts(locs, ints, exact=False, rsd=0.05), "approx_pid_count")
    regs = as_dict(estimate_registers(register_pairs(locs, ints), ["location", "interest"]),
                   "estimate")
    for k, v in want.items():
        assert abs(approx[k] - v) <= max(1, 5 * 0.05 * v)
        assert abs(regs[k] - v) <= max(1, 5 * 1.04 / math.sqrt(2 ** 13) * v)


def test_join_strategies_agree(fx):
    locs, ints, exact = fx
    want = as_dict(exact, "distinct_count")
    for strategy, explode in (("join", "late"), ("join", "early")):
        assert as_dict(pair_counts(locs, ints, strategy=strategy, explode=explode),
                       "distinct_count") == want


def test_trailing_window_matches_exact(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    exact = {(r.event_type, r.day): r.uniques for r in trailing_exact(ev, days=3).collect()}
    theta = {(r.event_type, r.day): r.uniques for r in trailing_uniques(
        daily_sketches(ev, kind="theta"), days=3, kind="theta").collect()}
    assert theta == exact
    hll = {(r.event_type, r.day): r.uniques for r in trailing_uniques(
        daily_sketches(ev, kind="hll"), days=3, kind="hll").collect()}
    for k, v in exact.items():
        assert abs(hll[k] - v) <= max(1, 0.05 * v)
    one_day = {(r.event_type, r.day): r.uniques for r in trailing_exact(ev, days=1).collect()}
    daily = daily_sketches(ev, kind="theta").select(
        "event_type", "day", F.theta_sketch_estimate("sketch").alias("n"))
    assert {(r.event_type, r.day): r.n for r in daily.collect()} == one_day


def test_tree_aggregation_same_result(fx):
    locs, ints, exact = fx
    from overlap.operators.theta import theta_pairs
    flat = as_dict(theta_pairs(locs, ints, fanin=1), "set_intersection_count")
    tree = as_dict(theta_pairs(locs.repartition(6), ints.repartition(5), fanin=3),
                   "set_intersection_count")
    assert flat == tree
    want = as_dict(exact, "distinct_count")
    got = as_dict(estimate_hll(hll_pairs(locs.repartition(6), ints, fanin=4), out="n"), "n")
    for k, v in want.items():
        assert abs(got[k] - v) <= max(1, 0.05 * v)


def test_daily_tree_aggregation_same_result(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").repartition(6)
    flat = {(r.event_type, r.day): r.n for r in daily_sketches(ev, fanin=1).select(
        "event_type", "day", F.theta_sketch_estimate("sketch").alias("n")).collect()}
    tree = {(r.event_type, r.day): r.n for r in daily_sketches(ev, fanin=3).select(
        "event_type", "day", F.theta_sketch_estimate("sketch").alias("n")).collect()}
    assert flat == tree
