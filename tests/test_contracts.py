"""Wrong answers that must not come back: stale partials, null groups, mixed parameters, blanks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from overlap.functions.keys import bucket_of
from overlap.operators.buckets import bucket_by_pairs, two_phase_pairs
from overlap.operators.daily import (daily_sketches, trailing_exact, trailing_registers,
                                     trailing_uniques)
from overlap.operators.hll import estimate_hll, hll_pairs
from overlap.operators.pairs import pair_counts
from overlap.operators.registers import (estimate_registers, merge_registers, register_hll,
                                          register_pairs, with_spec)
from overlap.operators.theta import merge_theta_sets, theta_pairs, theta_sets
from overlap.plans.inspect import executed_plan


def _inputs(spark, n=40):
    keys = [str(i) for i in range(n)]
    return (spark.createDataFrame([(k, ["x"]) for k in keys], "pid string, locations array<string>"),
            spark.createDataFrame([(k, "y") for k in keys], "pid string, interest string"))


@pytest.mark.parametrize("mode,col", [("exact", "distinct_count"), ("hll", "count")])
def test_rerun_of_a_bucket_that_came_out_empty(spark, tmp_path, mode, col):
    locs, ints = _inputs(spark)
    root = str(tmp_path / "two-phase")
    two_phase_pairs(spark, locs, ints, 4, mode=mode, root=root).collect()
    fewer = locs.where(bucket_of("pid", 4) != 2)
    left = fewer.count()
    assert left < 40
    out = two_phase_pairs(spark, fewer, ints, 4, mode=mode, root=root, buckets=[2])
    if mode == "hll":
        out = estimate_hll(out)
    assert as_dict(out, col) == {("x", "y"): left}


def test_rerun_with_other_parameters_raises(spark, tmp_path):
    locs, ints = _inputs(spark)
    root = str(tmp_path / "two-phase")
    two_phase_pairs(spark, locs, ints, 4, mode="exact", root=root)
    for other in (dict(num_buckets=5, mode="exact"), dict(num_buckets=4, mode="registers")):
        with pytest.raises(ValueError, match="cannot be merged"):
            two_phase_pairs(spark, locs, ints, root=root, buckets=[1], **other)


def test_bucketed_tables_leave_the_catalog(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    locs, ints = _inputs(spark)
    out = bucket_by_pairs(spark, locs, ints, 4, root=str(tmp_path / "b"))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert as_dict(out, "distinct_count") == {("x", "y"): 40}


def _events(spark):
    day = lambda n: dt.datetime(2024, 1, 1 + n, 12)
    rows = [("a", "u1", day(0)), ("a", "u2", day(1)), ("a", "u1", day(4)), (None, "u1", day(0)),
            (None, "u3", day(2)), ("b", "u1", day(9)), ("b", "u1", day(9))]
    return spark.createDataFrame(rows, "event_type string, user_id string, ts timestamp")


@pytest.mark.parametrize("days", [1, 3, 5])
def test_trailing_forms_agree_and_keep_null_groups(spark, days):
    ev = _events(spark)
    rows = [(r.event_type, r.ts.date(), r.user_id) for r in ev.collect()]
    expected = {(t, d): len({k for u, e, k in rows if u == t and 0 <= (d - e).days < days})
                for t, d, _ in rows}
    for out in (trailing_exact(ev, days=days), trailing_registers(ev, days=days),
                trailing_uniques(daily_sketches(ev), days=days),
                trailing_uniques(daily_sketches(ev, kind="hll"), days=days, kind="hll")):
        assert {(r.event_type, r.day): r.uniques for r in out.collect()} == expected


def test_trailing_several_dimensions(spark):
    ev = _events(spark).withColumn("place", F.when(F.col("user_id") == "u1", "p"))
    out = trailing_exact(ev, dim=["event_type", "place"], days=3)
    same = trailing_registers(ev, dim=["event_type", "place"], days=3)
    assert sorted(map(str, out.collect())) == sorted(map(str, same.collect()))
    assert out.count() == 6


def test_trailing_registers_over_many_keys(spark):
    ev = spark.range(6000).select(F.lit("a").alias("event_type"), F.col("id").cast("string").alias("user_id"),
                                  F.timestamp_seconds(F.lit(1704100000) + (F.col("id") % 10) * 86400)
                                  .alias("ts"))
    got = {r.day: r.uniques for r in trailing_registers(ev, days=4, log2m=8, regwidth=6).collect()}
    rows = ev.select("event_type", "user_id", F.to_date("ts").alias("day"))
    for day in sorted(got)[::3]:
        part = rows.where(F.datediff(F.lit(day), "day").between(0, 3))
        whole = estimate_registers(register_hll(part, ["event_type"], "user_id", log2m=8, regwidth=6),
                                   ["event_type"], log2m=8).first().estimate
        assert got[day] == whole


def test_register_tables_of_other_parameters_do_not_merge(spark):
    ints = _inputs(spark)[1]
    tables = [with_spec(register_hll(ints, ["interest"], seed=s), seed=s) for s in (1, 2)]
    mixed = merge_registers(tables[0].unionByName(tables[1]), ["interest"])
    with pytest.raises(Exception, match="cannot be merged"):  # whichever registers they filled
        estimate_registers(mixed, ["interest"]).collect()
    small = [with_spec(register_hll(ints, ["interest"], seed=s, log2m=7), seed=s, log2m=7)
             for s in (1, 2)]
    with pytest.raises(Exception, match="cannot be merged"):  # already where registers meet
        merge_registers(small[0].unionByName(small[1]), ["interest"]).collect()
    with pytest.raises(Exception, match="cannot be estimated"):
        estimate_registers(tables[0], ["interest"], log2m=12).collect()
    same = merge_registers(tables[0].unionByName(tables[0]), ["interest"])
    assert estimate_registers(same, ["interest"]).first().estimate == 40


def test_stored_sketches_of_other_parameters_do_not_merge(spark):
    sets = theta_sets(_inputs(spark)[1], lg_nom=10).withColumn("lg", F.lit(10))
    with pytest.raises(Exception, match="cannot be merged"):
        merge_theta_sets(sets, dim="interest", lg_nom=12).collect()
    daily = daily_sketches(_events(spark), lg_nom=10)
    with pytest.raises(Exception, match="cannot be merged"):
        trailing_uniques(daily, lg_nom=12).collect()
    assert trailing_uniques(daily, lg_nom=10).count() == 6


def test_white_space_keys_are_blank(spark):
    keys = ["k", "", " ", "\t", "\n", " ", " ", " k"]  # a no-break space is no blank
    ints = spark.createDataFrame([(k, "y") for k in keys], "pid string, interest string")
    locs = spark.createDataFrame([(k, ["x"]) for k in keys], "pid string, locations array<string>")
    assert as_dict(pair_counts(locs, ints), "distinct_count") == {("x", "y"): 3}
    from overlap.plans.sql import run_pair_sql
    assert as_dict(run_pair_sql(spark, locs, ints, "exact"), "distinct_count") == {("x", "y"): 3}


def test_one_sketch_per_day_and_pair(spark):
    locs = _inputs(spark, 3)[0]
    ints = spark.createDataFrame([("0", "y", 1), ("1", "y", 1), ("1", "y", 2), ("2", "z", 2)],
                                 "pid string, interest string, day int")
    out = estimate_hll(hll_pairs(locs, ints, extra_groups=["day"]))
    assert {(r.day, r.location, r.interest): r["count"] for r in out.collect()} == {
        (1, "x", "y"): 2, (2, "x", "y"): 1, (2, "x", "z"): 1}
    joined = estimate_hll(hll_pairs(locs, ints, extra_groups=["day"], strategy="join"))
    assert joined.count() == 3


def test_sketch_plans_do_not_depend_on_the_session(spark):
    """The same levels whatever spark.sql.shuffle.partitions says."""
    locs, ints = _inputs(spark)
    conf, shapes = "spark.sql.shuffle.partitions", set()
    before = spark.conf.get(conf)
    try:
        for n in ("8", "2000"):
            spark.conf.set(conf, n)
            plan = executed_plan(theta_pairs(locs, ints))
            shapes.add((plan.count("ObjectHashAggregate"), plan.count("Exchange hashpartitioning")))
    finally:
        spark.conf.set(conf, before)
    assert len(shapes) == 1


def test_wide_registers_hold_every_rank(spark):
    locs, ints = _inputs(spark, 200)
    narrow = register_pairs(locs, ints, log2m=7, regwidth=2).agg(F.max("rho")).first()[0]
    wide = register_pairs(locs, ints, log2m=7, regwidth=6).agg(F.max("rho")).first()[0]
    assert narrow == 3 < wide
