"""The worked example through every method (exact, approx, theta, HLL, registers, buckets)."""

import pytest
from conftest import EXPECTED_PAIRS, as_dict

from overlap.operators.buckets import bucketed_pairs, two_phase_pairs, bucket_by_pairs
from overlap.operators.hll import estimate_hll, hll_pairs
from overlap.operators.pairs import pair_counts
from overlap.operators.registers import estimate_registers, register_pairs
from overlap.operators.theta import theta_pairs


@pytest.mark.parametrize("strategy,explode", [("keysets", "late"), ("join", "late"),
                                              ("join", "early")])
def test_exact(example, strategy, explode):
    locs, ints = example
    out = pair_counts(locs, ints, strategy=strategy, explode=explode)
    assert out.columns == ["location", "interest", "distinct_count"]
    assert as_dict(out, "distinct_count") == EXPECTED_PAIRS


def test_approx(example):
    locs, ints = example
    out = pair_counts(locs, ints, exact=False)
    assert out.columns == ["location", "interest", "approx_pid_count"]
    assert as_dict(out, "approx_pid_count") == EXPECTED_PAIRS


def test_theta_full_grid_with_zeros(example):
    locs, ints = example
    got = as_dict(theta_pairs(locs, ints), "set_intersection_count")
    assert len(got) == 16
    zeros = {k for k, v in got.items() if v == 0.0}
    assert zeros == {("Shanghai", "Tea"), ("Shanghai", "Lego"), ("Paris", "Math"),
                     ("Dubai", "Math"), ("Shanghai", "Math"), ("Paris", "Gym"),
                     ("Delhi", "Gym")}
    # Math and Dubai share nobody (the published "Math n Dubai = 1" is an erratum)
    assert got[("Dubai", "Math")] == 0.0
    assert {k: v for k, v in got.items() if v} == {k: float(v) for k, v in EXPECTED_PAIRS.items()}


def test_theta_without_zero_pairs(example):
    locs, ints = example
    got = as_dict(theta_pairs(locs, ints, include_zero_pairs=False), "set_intersection_count")
    assert got == {k: float(v) for k, v in EXPECTED_PAIRS.items()}


def test_hll(example):
    locs, ints = example
    got = as_dict(estimate_hll(hll_pairs(locs, ints), out="n"), "n")
    assert got == EXPECTED_PAIRS


def test_registers(example):
    locs, ints = example
    got = as_dict(estimate_registers(register_pairs(locs, ints), ["location", "interest"]),
                  "estimate")
    assert got == EXPECTED_PAIRS


@pytest.mark.parametrize("mode", ["exact", "registers"])
@pytest.mark.parametrize("n", [1, 3, 1000])
def test_bucketed_one_job(example, mode, n):
    locs, ints = example
    out = bucketed_pairs(locs, ints, n, mode=mode)
    if mode == "registers":
        out = estimate_registers(out, ["location", "interest"], out="distinct_count")
    assert as_dict(out, "distinct_count") == EXPECTED_PAIRS


def test_two_phase_and_bucket_by(spark, example):
    locs, ints = example
    assert as_dict(two_phase_pairs(spark, locs, ints, 4, mode="exact"),
                   "distinct_count") == EXPECTED_PAIRS
    assert as_dict(bucket_by_pairs(spark, locs, ints, 4, mode="exact"),
                   "distinct_count") == EXPECTED_PAIRS
    hll = two_phase_pairs(spark, locs, ints, 4, mode="hll")
    assert as_dict(estimate_hll(hll, out="n"), "n") == EXPECTED_PAIRS
