"""Adaptive and folded registers, planned buckets, late rows of streams, people of any number."""

import datetime as dt
import random

import pytest
from conftest import EXPECTED_PAIRS, as_dict
from pyspark.sql import functions as F

from overlap.operators import adaptive, registers, synth
from overlap.operators.bucket_plan import BUCKET, CELLS, pack, plan_buckets, planned_pairs, write_planned
from overlap.operators.daily import daily_sketches
from overlap.operators.pairs import pair_counts
from overlap.streaming.late import DailyStore, start_daily_store_stream


def _keys(spark, lo, hi, value):
    return spark.range(lo, hi).select(F.col("id").cast("string").alias("pid"),
                                      F.lit(value).cast("string").alias("v"))


def _rows(df):
    return sorted(map(str, df.collect()))


def test_adaptive_form_changes_at_the_limit(spark):
    df = (_keys(spark, 0, 100, "at").unionByName(_keys(spark, 0, 101, "above"))
          .unionByName(_keys(spark, 0, 100, None)).unionByName(_keys(spark, 0, 30_000, "big")))
    df = df.unionByName(df)  # repeated rows change nothing
    cells = adaptive.adaptive_hll(df, ["v"], limit=100)
    forms = {r["v"]: (r["h"], r["r"]) for r in cells.groupBy("v").agg(
        F.count("hash").alias("h"), F.count("reg").alias("r")).collect()}
    assert forms["at"] == (100, 0) and forms[None] == (100, 0)
    assert forms["above"][0] == 0 and forms["big"][0] == 0
    dense = registers.register_hll(df.where("v = 'big'"), ["v"])
    assert _rows(cells.where("v = 'big'").select("v", "reg", "rho")) == _rows(dense.select("v", "reg", "rho"))
    est = {r["v"]: r["estimate"] for r in adaptive.estimate_adaptive(cells, ["v"]).collect()}
    want = registers.estimate_registers(dense, ["v"]).first()["estimate"]
    assert est["at"] == est[None] == 100 and est["big"] == want


def test_hashes_that_share_registers_do_not_pass_the_limit(spark):
    # 200 keys in 128 registers: fewer registers than the limit, more keys
    df = _keys(spark, 0, 200, "x")
    cells = adaptive.adaptive_hll(df, ["v"], log2m=7, limit=150)
    assert cells.where("hash is not null").count() == 0 and cells.count() <= 128


@pytest.mark.parametrize("limit", [0, 50, 1000])
def test_merging_adaptive_tables_equals_one_build(spark, limit):
    parts = [_keys(spark, lo, lo + 60, v) for lo in (0, 30, 400) for v in ("a", None)]
    parts.append(_keys(spark, 0, 10, "small"))
    whole = parts[0]
    built = adaptive.adaptive_hll(parts[0], ["v"], limit=limit)
    for p in parts[1:]:
        whole = whole.unionByName(p)
        built = built.unionByName(adaptive.adaptive_hll(p, ["v"], limit=limit))
    merged = adaptive.merge_adaptive(built, ["v"], limit=limit)
    assert _rows(merged) == _rows(adaptive.adaptive_hll(whole, ["v"], limit=limit))
    assert _rows(adaptive.merge_adaptive(merged, ["v"], limit=limit)) == _rows(merged)


def test_adaptive_singletons_and_empty_tables(spark):
    one = adaptive.adaptive_singleton(_keys(spark, 0, 5, "x"))
    assert {r["estimate"] for r in adaptive.estimate_adaptive(one, ["pid"]).collect()} == {1}
    assert adaptive.adaptive_hll(_keys(spark, 0, 0, "x"), ["v"]).collect() == []
    assert adaptive.default_limit(13, 6) == 768


@pytest.mark.parametrize("to", [7, 11, 13])
def test_folding_equals_a_build_at_the_lower_precision(spark, to):
    df = _keys(spark, 0, 5000, "a").unionByName(_keys(spark, 0, 50, None))
    folded = registers.fold_registers(registers.register_hll(df, ["v"]), ["v"], log2m=13, to_log2m=to)
    assert _rows(folded) == _rows(registers.register_hll(df, ["v"], log2m=to))


def test_mixed_precisions_merge_on_request_only(spark):
    a, b = _keys(spark, 0, 3000, "v"), _keys(spark, 2000, 6000, "v")
    fine = registers.with_spec(registers.register_hll(a, ["v"]))
    coarse = registers.with_spec(registers.register_hll(b, ["v"], log2m=11, regwidth=4), log2m=11, regwidth=4)
    both = fine.unionByName(coarse)
    with pytest.raises(Exception, match="cannot be merged"):
        registers.merge_registers(both, ["v"]).collect()
    merged = registers.merge_folded(both, ["v"], log2m=11, regwidth=4)
    want = registers.register_hll(a.unionByName(b), ["v"], log2m=11, regwidth=4)
    assert _rows(merged.drop("spec")) == _rows(want)
    assert registers.merge_registers(merged, ["v"]).count() == want.count()
    with pytest.raises(Exception, match="cannot be folded"):
        registers.merge_folded(both, ["v"], log2m=12, regwidth=4).collect()
    with pytest.raises(Exception, match="cannot be folded"):
        registers.merge_folded(both, ["v"], log2m=11, regwidth=4, seed=7).collect()
    with pytest.raises(ValueError):
        registers.fold_registers(fine.drop("spec"), ["v"], log2m=11, to_log2m=13)


def test_pack_cuts_hot_cells_and_fills_buckets():
    plan = pack({0: (10, 10), 1: (500, 5), 2: (300, 300), 3: (5, 5)}, 10)
    assert len(plan) == CELLS and plan[0][1:] == (1, 1)
    for cell, (l, r) in ((1, (500, 5)), (2, (300, 300))):
        assert l / plan[cell][1] + r / plan[cell][2] <= 1135 / 10
    assert plan[1][2] == 1  # the small side is not cut
    assert plan[3][0] > plan[2][0]


def _hot_inputs(spark, n=30_000):
    """A third of the rows belong to one key."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 4001).cast("string"))
    left = spark.range(n).select(hot.alias("pid"), F.concat(F.lit("a"), F.col("id") % 4000).alias("a"))
    right = spark.range(n).select(hot.alias("pid"), F.concat(F.lit("b"), F.col("id") % 40).alias("b"))
    return left, right


def test_planned_buckets_stay_within_twice_the_mean(spark, tmp_path):
    left, right = _hot_inputs(spark)
    one, two = write_planned(spark, left, right, 16, str(tmp_path / "p"), left_dim="a", left_is_array=False,
                             right_dim="b", left_name="a", right_name="b")
    rows = [side.groupBy(BUCKET).count() for side in (one, two)]
    size = {r[BUCKET]: r["n"] for r in rows[0].unionByName(rows[1]).groupBy(BUCKET).agg(
        F.sum("count").alias("n")).collect()}
    assert max(size.values()) <= 2 * sum(size.values()) / len(size)


def test_planned_pairs_equal_the_exact_counts(spark, tmp_path, example):
    assert as_dict(planned_pairs(spark, *example, 4, str(tmp_path / "e")), "distinct_count") == EXPECTED_PAIRS
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice(["hot", "k", None, " "]), [rng.choice(["x", "y", None])])
                                  for _ in range(60)], "pid string, locations array<string>")
    right = spark.createDataFrame([(rng.choice(["hot", "k", "z"]), rng.choice([None, *map(str, range(30))]))
                                   for _ in range(200)], "pid string, interest string")
    got = planned_pairs(spark, left, right, 8, str(tmp_path / "r"))
    assert as_dict(got, "distinct_count") == as_dict(pair_counts(left, right), "distinct_count")
    none = planned_pairs(spark, left.limit(0), right.limit(0), 8, str(tmp_path / "n"))
    assert none.collect() == []


def test_plan_of_empty_tables(spark):
    empty = spark.createDataFrame([], "pid string, a string")
    plan = plan_buckets(empty, empty, "pid", "a", "a", 4)
    assert {p[1:] for p in plan.cells.values()} == {(1, 1)}


def _events(spark, n=600):
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([None, *[f"u{i}" for i in range(40)]]), rng.choice(["e", "f", None]),
             rng.choice(["x", "y"]), t0 + dt.timedelta(hours=rng.randrange(24 * 20))) for _ in range(n)]
    return spark.createDataFrame(rows, "user_id string, event_type string, place string, ts timestamp")


@pytest.mark.parametrize("kind", ["theta", "hll", "registers"])
def test_shuffled_replay_with_a_restart_equals_the_batch_form(spark, tmp_path, kind, monkeypatch):
    ev = _events(spark)
    src, ckpt = tmp_path / "src", str(tmp_path / "ckpt")
    ev.where("hash(user_id, ts) % 2 = 0").repartition(3).write.parquet(str(src / "one"))
    dims = ["event_type", "place"]
    make = lambda: DailyStore(spark, str(tmp_path / "store"), dim=dims, kind=kind)

    def run(store):
        start_daily_store_stream(store, str(src / "*"), ev.schema, checkpoint=ckpt,
                                 max_files_per_trigger=1).awaitTermination()

    broken, calls, real = make(), [], DailyStore._sketched
    with monkeypatch.context() as m:  # the second batch is lost before its commit
        m.setattr(DailyStore, "_sketched", lambda self, rows: (
            calls.append(1), real(self, rows) if len(calls) < 2 else 1 / 0)[1])
        with pytest.raises(Exception):
            run(broken)
    run(make())
    make().compact()
    ev.where("hash(user_id, ts) % 2 <> 0").repartition(2).write.parquet(str(src / "two"))  # days long read
    run(make())
    store = make()
    assert not store.apply(0, ev)  # committed before
    whole = DailyStore(spark, str(tmp_path / "whole"), dim=dims, kind=kind)
    assert whole.apply(0, ev)
    assert _rows(store.estimates()) == _rows(whole.estimates())
    if kind == "theta":
        exact = ev.where("user_id is not null").groupBy(*dims, F.to_date("ts").alias("day")).agg(
            F.count_distinct("user_id").alias("uniques"))
        assert _rows(store.estimates()) == _rows(exact)
        batch = daily_sketches(ev, dim=dims).select(*dims, "day", F.theta_sketch_estimate("sketch").alias("u"))
        assert _rows(batch) == _rows(store.cells().select(*dims, "day", F.theta_sketch_estimate("sketch").alias("u")))


def test_a_store_of_other_parameters_raises(spark, tmp_path):
    ev = _events(spark, 20)
    DailyStore(spark, str(tmp_path / "s")).apply(0, ev)
    with pytest.raises(ValueError, match="stored with"):
        DailyStore(spark, str(tmp_path / "s"), lg_nom=10).cells()
    with pytest.raises(ValueError, match="no committed batch"):
        DailyStore(spark, str(tmp_path / "none")).cells()


def test_people_of_any_number_in_their_alphabet(spark):
    rows = [r["pid"] for r in synth.numbered_people(spark, 2000, num_partitions=5).collect()]
    assert len(set(rows)) == 2000 and len(synth.SYMBOLS) == 65
    used = set()
    for pid in rows:
        number, suffix = pid.split("_")
        assert 0 <= int(number) < 2000 and len(suffix) == 35
        used |= set(suffix)
    assert used == set(synth.SYMBOLS)
    assert rows == [r["pid"] for r in synth.numbered_people(spark, 2000, num_partitions=2).collect()]
    assert synth.numbered_people(spark, 0).count() == 0
