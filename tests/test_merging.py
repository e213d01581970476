"""Screened theta sets, blocks of hot keys, bitmaps, dyadic windows and stored pair sketches."""

import datetime as dt
import random

import pytest
from conftest import EXPECTED_PAIRS, as_dict
from pyspark.sql import functions as F

from overlap.operators import bitmaps, dyadic, screened
from overlap.operators.blocks import block_pairs, heavy_keys
from overlap.operators.daily import trailing_exact, trailing_registers
from overlap.operators.pairs import pair_counts
from overlap.operators.upkeep import PairSketches
from overlap.plans.inspect import executed_plan


def test_worked_example_by_every_new_form(example):
    locs, ints = example
    assert as_dict(pair_counts(locs, ints, strategy="blocks", chunk=1), "distinct_count") == EXPECTED_PAIRS
    assert as_dict(bitmaps.bitmap_pairs(locs, ints), "distinct_count") == EXPECTED_PAIRS
    assert as_dict(screened.screened_pairs(locs, ints), "set_intersection_count") == EXPECTED_PAIRS
    grid = as_dict(screened.screened_pairs(locs, ints, include_zero_pairs=True), "set_intersection_count")
    assert len(grid) == 16 and {k: v for k, v in grid.items() if v} == EXPECTED_PAIRS


def _random_inputs(spark, seed, n=60):
    rng = random.Random(seed)
    keys = [None, "", " ", *[f"k{i}" for i in range(n)]]
    left = [(rng.choice(keys), [rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(4))])
            for _ in range(150)]
    right = [(rng.choice(keys), rng.choice(["x", "y", None])) for _ in range(150)]
    return (spark.createDataFrame(left, "pid string, locations array<string>"),
            spark.createDataFrame(right, "pid string, interest string"))


@pytest.mark.parametrize("seed", range(3))
def test_exact_forms_agree_on_nulls_blanks_and_repeats(spark, seed):
    locs, ints = _random_inputs(spark, seed)
    want = as_dict(pair_counts(locs, ints), "distinct_count")
    assert as_dict(pair_counts(locs, ints, strategy="blocks", chunk=2), "distinct_count") == want
    assert as_dict(bitmaps.bitmap_pairs(locs, ints), "distinct_count") == want
    assert as_dict(screened.screened_pairs(locs, ints), "set_intersection_count") == want
    assert as_dict(screened.screened_pairs(locs, ints, chunk=1), "set_intersection_count") == want


def test_empty_inputs(spark):
    locs = spark.createDataFrame([], "pid string, locations array<string>")
    ints = spark.createDataFrame([], "pid string, interest string")
    for df in (pair_counts(locs, ints, strategy="blocks"), bitmaps.bitmap_pairs(locs, ints),
               screened.screened_pairs(locs, ints), screened.screened_pairs(locs, ints, include_zero_pairs=True)):
        assert df.collect() == []


def test_screened_sets_hold_the_nominal_entries_and_estimate(spark):
    # 20,000 keys of one value, each three times; 100 keys of another
    big = spark.range(60_000).select((F.col("id") % 20_000).cast("string").alias("pid"), F.lit("big").alias("v"))
    small = spark.range(100).select(F.col("id").cast("string").alias("pid"), F.lit("small").alias("v"))
    df = big.union(small)
    sets = screened.screened_sets(df, dim="v", nominal_entries=1024)
    n = {r["v"]: r["count"] for r in sets.groupBy("v").count().collect()}
    assert n["small"] == 100 and 1024 <= n["big"] <= 4096
    est = {r["v"]: r["estimate"] for r in screened.screened_estimates(sets, "v").collect()}
    assert est["small"] == 100 and abs(est["big"] - 20_000) < 4 * 20_000 / 1024 ** 0.5


def test_screened_hash_is_taken_before_the_explode_and_no_grid_is_made(spark, example):
    locs, ints = example
    df = screened.screened_pairs(locs, ints)
    df.collect()
    plan = executed_plan(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    hashed = screened._side(locs, "pid", "locations", True, "drop")[1](F.lit(5))
    lines = executed_plan(hashed).splitlines()
    generate = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert any("xxhash64" in x for x in lines[generate:])
    assert not any("xxhash64" in x for x in lines[:generate])


def test_merging_screened_sets_takes_the_least_limit(spark):
    def part(lo, hi):
        return screened.screened_sets(spark.range(lo, hi).select(
            F.col("id").cast("string").alias("pid"), F.lit("v").alias("v")), dim="v", nominal_entries=256)

    both = screened.merge_screened(part(0, 6000).unionByName(part(3000, 20_000)), "v")
    assert both.select("limit").distinct().count() == 1
    est = screened.screened_estimates(both, "v").first()["estimate"]
    assert abs(est - 20_000) < 5 * 20_000 / 256 ** 0.5


def test_hot_key_is_spread_over_tasks(spark):
    n = 20_000
    side = spark.range(n).select(F.lit("hot").alias("pid"), F.col("id").alias("v"))
    left, right = side.withColumnRenamed("v", "a"), side.withColumnRenamed("v", "b")
    hot = heavy_keys(left, right, "pid")
    assert [r["pid"] for r in hot.collect()] == ["hot"]
    rows = block_pairs(left, right, "pid", "a", "b", hot=hot, tasks=16)
    by_task = rows.groupBy(F.spark_partition_id().alias("t")).count().collect()
    full = [r["count"] for r in by_task if r["count"]]
    assert sum(full) == n * n
    assert len(full) >= 8 and max(full) < 0.3 * n * n


def test_repeated_rows_of_a_hot_key_make_no_more_blocks(spark):
    left = spark.range(5000).select(F.lit("k").alias("pid"), (F.col("id") % 3).alias("a"))
    right = spark.range(5000).select(F.lit("k").alias("pid"), (F.col("id") % 2).alias("b"))
    hot = heavy_keys(left, right, "pid", 100)
    rows = block_pairs(left, right, "pid", "a", "b", hot=hot, chunk=100).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(a, b) for a in range(3) for b in range(2)]


def test_key_numbers_are_dense_and_stay_when_extended(spark):
    a = spark.range(500).select(F.col("id").cast("string").alias("pid"))
    numbers = bitmaps.key_numbers(a, parts=7)
    assert sorted(r["num"] for r in numbers.collect()) == list(range(1, 501))
    more = bitmaps.extend_numbers(numbers, spark.range(400, 700).select(F.col("id").cast("string").alias("pid")))
    got = {r["pid"]: r["num"] for r in more.collect()}
    assert sorted(got.values()) == list(range(1, 701))
    assert all(got[r["pid"]] == r["num"] for r in numbers.collect())


def test_bitmaps_over_several_blocks(spark):
    n = 100_000  # four blocks
    left = spark.range(n).select(F.col("id").cast("string").alias("pid"),
                                 F.array((F.col("id") % 2).cast("string")).alias("locations"))
    right = spark.range(0, n, 3).select(F.col("id").cast("string").alias("pid"), F.lit("t").alias("interest"))
    numbers = bitmaps.key_numbers(left)
    assert bitmaps.value_bitmaps(right, numbers).count() == 4
    got = as_dict(bitmaps.bitmap_pairs(left, right), "distinct_count")
    assert got == {("0", "t"): 16_667, ("1", "t"): 16_667}


def test_window_pieces_cover_each_window_once(spark):
    for days in (1, 2, 3, 7, 28, 90):
        rows = (spark.range(40).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("day"))
                .select("day", F.unix_date("day").alias("n"), dyadic.window_pieces(F.col("day"), days).alias("p"))
                .collect())
        for r in rows:
            got = sorted(d for level, at in r["p"] for d in range(at << level, (at + 1) << level))
            assert got == list(range(r["n"] - days + 1, r["n"] + 1))
            assert len(r["p"]) <= 2 * days.bit_length()


def _events(spark, days=100):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [(rng.choice([None, "u", *[f"u{i}" for i in range(30)]]), rng.choice(["e", "f", None]),
             t0 + dt.timedelta(days=rng.randrange(days))) for _ in range(400)]
    return spark.createDataFrame([*rows, ("u1", "e", None)], "user_id string, event_type string, ts timestamp")


@pytest.mark.parametrize("days", [7, 28, 90])
def test_dyadic_windows_equal_the_exact_form(spark, days):
    ev = _events(spark)
    key = lambda r: (str(r["event_type"]), r["day"], r["uniques"])
    want = sorted(map(key, trailing_exact(ev, days=days).collect()))
    bits = dyadic.trailing_bitmaps(ev, bitmaps.key_numbers(ev, key="user_id"), days=days)
    assert sorted(map(key, bits.collect())) == want
    assert sorted(map(key, dyadic.trailing_theta(ev, days=days).collect())) == want
    regs = sorted(map(key, dyadic.trailing_register_cells(ev, days=days).collect()))
    assert regs == sorted(map(key, trailing_registers(ev, days=days).collect()))


def _batches(spark):
    rng = random.Random(9)
    d = [dt.date(2024, 1, k + 1) for k in range(4)]
    left = [(f"k{rng.randrange(40)}", rng.choice(["a", "b", None])) for _ in range(90)]
    right = [(f"k{rng.randrange(40)}", rng.choice(["x", "y"]), rng.choice(d)) for _ in range(120)]
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    ls, rs = "pid string, location string", "pid string, interest string, day date"
    return [(mk(left[k::3], ls), mk(right[k::3], rs)) for k in range(3)], (mk(left, ls), mk(right, rs))


@pytest.mark.parametrize("kind", ["theta", "registers"])
def test_increments_equal_one_full_build(spark, tmp_path, kind):
    parts, (left, right) = _batches(spark)
    whole = PairSketches(spark, str(tmp_path / "whole"), kind=kind)
    assert whole.apply(0, left, right)
    steps = PairSketches(spark, str(tmp_path / "steps"), kind=kind)
    for k, (l, r) in enumerate(parts):
        assert steps.apply(k, l, r)
        assert not steps.apply(k, l, r)  # committed: nothing changes
    rows = lambda s: sorted(map(str, s.estimates().collect()))
    assert rows(steps) == rows(whole)
    if kind == "registers":
        assert sorted(map(str, steps.cells().collect())) == sorted(map(str, whole.cells().collect()))
    exact = {(r["location"], r["interest"], r["day"]): r["n"] for r in left.join(right, "pid").groupBy(
        "location", "interest", "day").agg(F.count_distinct("pid").alias("n")).collect()}
    if kind == "theta":
        assert {(r["location"], r["interest"], r["day"]): r["uniques"]
                for r in steps.estimates().collect()} == exact


def test_a_batch_that_failed_is_applied_again(spark, tmp_path, monkeypatch):
    parts, _ = _batches(spark)
    store = PairSketches(spark, str(tmp_path / "s"))
    store.apply(0, *parts[0])
    before = sorted(map(str, store.estimates().collect()))
    with monkeypatch.context() as m:
        m.setattr(PairSketches, "_sketched", lambda self, df: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.apply(1, *parts[1])
    assert sorted(map(str, store.estimates().collect())) == before  # not committed, not read
    assert store.apply(1, *parts[1])
    fresh = PairSketches(spark, str(tmp_path / "t"))
    for k in (0, 1):
        fresh.apply(k, *parts[k])
    assert sorted(map(str, store.estimates().collect())) == sorted(map(str, fresh.estimates().collect()))


def test_other_parameters_and_late_numbers_raise(spark, tmp_path):
    parts, _ = _batches(spark)
    PairSketches(spark, str(tmp_path / "s"), lg_nom=12).apply(3, *parts[0])
    with pytest.raises(ValueError, match="stored with"):
        PairSketches(spark, str(tmp_path / "s"), lg_nom=13).estimates()
    with pytest.raises(ValueError, match="comes after"):
        PairSketches(spark, str(tmp_path / "s"), lg_nom=12).apply(1, *parts[1])
