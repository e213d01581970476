"""Registered end-to-end queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query derives its inputs from the given tables (``overlap.sources.fixtures``) and
runs the library operator over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.functions.metrics import within_bound
from overlap.functions.sketches import theta_estimate
from overlap.operators.buckets import (BUCKET_COL, bucket_by_pairs, bucketed_pairs,
                                        two_phase_pairs, write_bucketed_inputs)
from overlap.operators import synth
from overlap.operators.accuracy import compare_counts, error_stats
from overlap.operators.blocks import written
from overlap.operators.daily import (daily_sketches, trailing_exact, trailing_registers,
                                     trailing_uniques)
from overlap.operators.hll import estimate_hll, hll_pairs
from overlap.operators.pairs import pair_counts
from overlap.operators.registers import estimate_registers, register_hll, register_pairs
from overlap.session import scratch_path
from overlap.operators.theta import theta_pairs, theta_sets
from overlap.plans import merging
from overlap.schema import lg_nominal
from overlap.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

# Theta is exact while a set holds fewer keys than its nominal entries: 1,500 customers
# at sf0.01, 14,999 at sf0.1 -> 16384 keeps every registered theta query exact.
NOMINAL = 16384
APPROX_RSD = 0.05
APPROX_BOUND = 0.25


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.locations(spark, sf_dir), fixtures.interests(spark, sf_dir)


def _inputs_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same rows, written once: for queries that read their inputs several times."""
    locs, ints = _inputs(spark, sf_dir)
    return written(locs, "locations"), written(ints, "interests")


def pair_exact(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return pair_counts(locs, ints)


def pair_exact_join(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return pair_counts(locs, ints, strategy="join", explode="late")


def pair_exact_explode_early(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return pair_counts(locs, ints, strategy="join", explode="early")


def pair_theta(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return theta_pairs(locs, ints, nominal_entries=NOMINAL)


def theta_sets_interest(spark, sf_dir):
    s = theta_sets(fixtures.interests(spark, sf_dir), dim="interest",
                   lg_nom=lg_nominal(NOMINAL))
    return s.select("interest", theta_estimate("sketch").alias("estimate"))


def theta_sets_location(spark, sf_dir):
    s = theta_sets(fixtures.locations(spark, sf_dir), dim="locations", name="location",
                   is_array=True, lg_nom=lg_nominal(NOMINAL))
    return s.select("location", theta_estimate("sketch").alias("estimate"))


def _bounded(estimates: DataFrame, exact: DataFrame, est_col: str, bound: float) -> DataFrame:
    """(location, interest, distinct_count, within_bound) over the union of both pair sets."""
    e = estimates.select(F.col("location").alias("el"), F.col("interest").alias("ei"), est_col)
    j = exact.join(e, F.col("location").eqNullSafe(F.col("el"))
                   & F.col("interest").eqNullSafe(F.col("ei")), "full")
    here = F.col("distinct_count").isNotNull()
    return j.select(F.when(here, F.col("location")).otherwise(F.col("el")).alias("location"),
                    F.when(here, F.col("interest")).otherwise(F.col("ei")).alias("interest"),
                    F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
                    F.coalesce(within_bound(est_col, "distinct_count", bound), F.lit(False))
                     .alias("within_bound"))


def pair_approx(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    approx = pair_counts(locs, ints, exact=False, rsd=APPROX_RSD)
    return _bounded(approx, pair_counts(locs, ints), "approx_pid_count", APPROX_BOUND)


def pair_approx_raw(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return pair_counts(locs, ints, exact=False, rsd=APPROX_RSD)


HLL_LG_K = 13
HLL_BOUND = 0.05
NUM_BUCKETS = 8


def _hll_bounded(locs: DataFrame, ints: DataFrame, hll: DataFrame) -> DataFrame:
    return _bounded(estimate_hll(hll, out="hll_estimate"), pair_counts(locs, ints),
                    "hll_estimate", HLL_BOUND)


def register_hll_q(spark, sf_dir):
    regs = register_hll(fixtures.interests(spark, sf_dir), ["interest"])
    return estimate_registers(regs, ["interest"])


def register_hll_pairs(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return estimate_registers(register_pairs(locs, ints), ["location", "interest"])


def register_hll_merge(spark, sf_dir):
    """Per-bucket register partials, merged: identical to the one-shot registers."""
    locs, ints = _inputs(spark, sf_dir)
    merged = bucketed_pairs(locs, ints, NUM_BUCKETS, mode="registers")
    return estimate_registers(merged, ["location", "interest"])


def register_hll_two_phase(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    merged = two_phase_pairs(spark, locs, ints, NUM_BUCKETS, mode="registers")
    return estimate_registers(merged, ["location", "interest"])


def pair_hll(spark, sf_dir):
    locs, ints = _inputs_once(spark, sf_dir)
    return _hll_bounded(locs, ints, hll_pairs(locs, ints, lg_config_k=HLL_LG_K))


def pair_hll_raw(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return estimate_hll(hll_pairs(locs, ints, lg_config_k=HLL_LG_K), out="hll_estimate")


def pair_hll_two_phase(spark, sf_dir):
    locs, ints = _inputs_once(spark, sf_dir)
    hll = two_phase_pairs(spark, locs, ints, NUM_BUCKETS, mode="hll", lg_config_k=HLL_LG_K)
    return _hll_bounded(locs, ints, hll)


def pair_hll_bucket_by(spark, sf_dir):
    locs, ints = _inputs_once(spark, sf_dir)
    hll = bucket_by_pairs(spark, locs, ints, NUM_BUCKETS, mode="hll", lg_config_k=HLL_LG_K)
    return _hll_bounded(locs, ints, hll)


def bucket_exact_one_job(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return bucketed_pairs(locs, ints, NUM_BUCKETS, mode="exact")


def bucket_exact_two_phase(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return two_phase_pairs(spark, locs, ints, NUM_BUCKETS, mode="exact")


def bucket_by_join_exact(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    return bucket_by_pairs(spark, locs, ints, NUM_BUCKETS, mode="exact")


def bucket_slice_totals(spark, sf_dir):
    """Rows written per side, summed over every bucket directory read back."""
    locs, ints = _inputs(spark, sf_dir)
    lpath, rpath = write_bucketed_inputs(spark, locs, ints, NUM_BUCKETS,
                                         scratch_path(spark, "slices"))
    per_bucket = [spark.read.parquet(p).groupBy(BUCKET_COL).agg(F.count(F.lit(1)).alias("n"))
                  .select(F.lit(side).alias("side"), "n")
                  for side, p in (("left", lpath), ("right", rpath))]
    return (per_bucket[0].unionByName(per_bucket[1]).groupBy("side")
            .agg(F.sum("n").cast("bigint").alias("n_rows")))


TRAILING_DAYS = 7


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts")


def trailing_7d_exact(spark, sf_dir):
    return trailing_exact(_events(spark, sf_dir), days=TRAILING_DAYS)


def trailing_7d_theta(spark, sf_dir):
    daily = daily_sketches(_events(spark, sf_dir), kind="theta", lg_nom=lg_nominal(NOMINAL))
    return trailing_uniques(daily, days=TRAILING_DAYS, kind="theta", lg_nom=lg_nominal(NOMINAL))


def trailing_7d_registers(spark, sf_dir):
    return trailing_registers(_events(spark, sf_dir), days=TRAILING_DAYS)


def trailing_7d_hll(spark, sf_dir):
    ev = _events(spark, sf_dir)
    est = trailing_uniques(daily_sketches(ev, kind="hll", lg_config_k=HLL_LG_K),
                           days=TRAILING_DAYS, kind="hll", lg_config_k=HLL_LG_K, out="hll_uniques")
    exact = trailing_exact(ev, days=TRAILING_DAYS).select(
        F.col("event_type").alias("xt"), F.col("day").alias("xd"), "uniques")
    j = est.join(exact, F.col("event_type").eqNullSafe(F.col("xt")) & (F.col("day") == F.col("xd")),
                 "full")
    here = F.col("day").isNotNull()
    return j.select(F.when(here, F.col("event_type")).otherwise(F.col("xt")).alias("event_type"),
                    F.coalesce("day", "xd").alias("day"), F.coalesce("uniques", F.lit(0)).alias("uniques"),
                    F.coalesce(within_bound("hll_uniques", "uniques", HLL_BOUND), F.lit(False))
                    .alias("within_bound"))


def _accuracy(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    est = estimate_registers(register_pairs(locs, ints), ["location", "interest"])
    return compare_counts(est, pair_counts(locs, ints), count_a="estimate",
                          count_b="distinct_count")


def accuracy_join(spark, sf_dir):
    return _accuracy(spark, sf_dir)


def accuracy_stats(spark, sf_dir):
    s = error_stats(_accuracy(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns[:3]], "pairs")


def accuracy_theta_lg8_stats(spark, sf_dir):
    """Theta at 256 nominal entries (approximate regime) vs exact: error summary."""
    locs, ints = _inputs(spark, sf_dir)
    cmp = compare_counts(theta_pairs(locs, ints, nominal_entries=256), pair_counts(locs, ints),
                         how="full")
    return error_stats(cmp)


def accuracy_approx_stats(spark, sf_dir):
    locs, ints = _inputs(spark, sf_dir)
    cmp = compare_counts(pair_counts(locs, ints, exact=False, rsd=APPROX_RSD),
                         pair_counts(locs, ints))
    return error_stats(cmp)


def _synth_inputs(spark, sf_dir):
    ppl = synth.people(spark, sf_dir)
    return synth.person_locations(ppl), synth.person_interests(ppl)


def synth_people(spark, sf_dir):
    return synth.people(spark, sf_dir)


def synth_locations(spark, sf_dir):
    locs, _ = _synth_inputs(spark, sf_dir)
    return locs.select("pid", F.explode("locations").alias("location"))


def synth_interests(spark, sf_dir):
    _, ints = _synth_inputs(spark, sf_dir)
    return ints


def synth_pair_exact(spark, sf_dir):
    return pair_counts(*_synth_inputs(spark, sf_dir))


def synth_pair_theta(spark, sf_dir):
    return theta_pairs(*_synth_inputs(spark, sf_dir), nominal_entries=NOMINAL)


def stream_daily_theta(spark, sf_dir):
    """Streaming daily sketches run to completion (availableNow); closed days read back."""
    from overlap.streaming.daily import start_daily_sketch_stream

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    sink = scratch_path(spark, "stream-sink")
    q = start_daily_sketch_stream(spark, f"{sf_dir}/events*.parquet", schema, sink,
                                  lg_nom=lg_nominal(NOMINAL), lg_config_k=HLL_LG_K)
    q.awaitTermination()
    return spark.read.parquet(sink).select(
        "event_type", "day", F.theta_sketch_estimate("theta").alias("uniques"))


def pair_exact_sql(spark, sf_dir):
    from overlap.plans.sql import run_pair_sql

    return run_pair_sql(spark, *_inputs(spark, sf_dir), "exact")


def pair_theta_sql(spark, sf_dir):
    from overlap.plans.sql import run_pair_sql

    return run_pair_sql(spark, *_inputs(spark, sf_dir), "theta", lg_nom=lg_nominal(NOMINAL))


def theta_union_merge(spark, sf_dir):
    """A5: partial theta sketches per (brand, order year), unioned per brand."""
    from overlap.operators.theta import merge_theta_sets
    from overlap.schema import key_predicate, sketch_input

    lg = lg_nominal(NOMINAL)
    rows = fixtures.interests_by_year(spark, sf_dir).where(key_predicate("pid"))
    partials = rows.groupBy("interest", "year").agg(
        F.theta_sketch_agg(sketch_input(F.col("pid")), lg).alias("sketch"))
    merged = merge_theta_sets(partials.withColumn("lg", F.lit(lg)), dim="interest", lg_nom=lg)
    return merged.select("interest", theta_estimate("sketch").alias("estimate"))


# ---- estimating paths: small sketches, so that sets are far above the exact regime ----------
SMALL_NOMINAL = 256
SMALL_LG_K = 8
SMALL_LOG2M = 7


def _register_small(spark, sf_dir, regwidth):
    locs, ints = _inputs(spark, sf_dir)
    regs = register_pairs(locs, ints, log2m=SMALL_LOG2M, regwidth=regwidth)
    return estimate_registers(regs, ["location", "interest"], log2m=SMALL_LOG2M)


def register_small_width4(spark, sf_dir):
    return _register_small(spark, sf_dir, 4)


def register_small_width6(spark, sf_dir):
    return _register_small(spark, sf_dir, 6)


def theta_small_sets(spark, sf_dir):
    """Theta at 256 nominal entries: (brand, exact keys, estimate within 4 standard errors)."""
    ints = fixtures.interests(spark, sf_dir)
    est = theta_sets(ints, dim="interest", lg_nom=lg_nominal(SMALL_NOMINAL)).select(
        F.col("interest").alias("i"), theta_estimate("sketch").alias("est"))
    exact = ints.distinct().groupBy("interest").agg(F.count(F.lit(1)).alias("keys"))
    return exact.join(est, F.col("interest").eqNullSafe(F.col("i"))).select(
        "interest", "keys", within_bound("est", "keys", 4 / SMALL_NOMINAL ** 0.5).alias("within_bound"))


def theta_small_pairs(spark, sf_dir):
    """The same for intersections; their error follows the size of the union."""
    locs, ints = _inputs_once(spark, sf_dir)
    left = locs.select("pid", F.explode("locations").alias("location"))
    # one row a customer, whose locations are distinct
    nl = left.groupBy("location").agg(F.count(F.lit(1)).alias("nl"))
    nr = ints.distinct().groupBy("interest").agg(F.count(F.lit(1)).alias("nr"))
    est = theta_pairs(locs, ints, nominal_entries=SMALL_NOMINAL)
    j = est.join(pair_counts(locs, ints), ["location", "interest"], "left")
    j = j.join(nl, "location").join(nr, "interest").withColumn(
        "distinct_count", F.coalesce("distinct_count", F.lit(0)))
    union = F.col("nl") + F.col("nr") - F.col("distinct_count")
    bound = 4 * F.sqrt(F.col("distinct_count") * union / F.lit(float(SMALL_NOMINAL))) + 1
    return j.select("location", "interest", "distinct_count",
                    (F.abs(F.col("set_intersection_count") - F.col("distinct_count")) <= bound)
                    .alias("within_bound"))


def hll_small_pairs(spark, sf_dir):
    """HLL at lgK 8: (pair, exact keys, estimate within 5 standard errors)."""
    locs, ints = _inputs_once(spark, sf_dir)
    est = estimate_hll(hll_pairs(locs, ints, lg_config_k=SMALL_LG_K), out="hll_estimate")
    return _bounded(est, pair_counts(locs, ints), "hll_estimate", 5 * 1.04 / 16)


def accuracy_theta_lg8_checked(spark, sf_dir):
    """Error summary of theta at 256 entries: pairs compared, average below 50 per cent."""
    s = accuracy_theta_lg8_stats(spark, sf_dir)
    return s.select("pairs", (F.col("avg_percent_difference") < 50).alias("average_small"))


def accuracy_approx_checked(spark, sf_dir):
    s = accuracy_approx_stats(spark, sf_dir)
    return s.select("pairs", (F.col("avg_percent_difference") < 100 * APPROX_RSD).alias("average_small"))


# ---- trailing uniques per pair of dimensions ------------------------------------------------
def _pair_events(spark, sf_dir):
    """Events with the nation of the user, as (location, interest) pairs of a day."""
    users = (spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
             .join(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"),
                   F.col("c_nationkey") == F.col("n_nationkey")))
    return _events(spark, sf_dir).join(users, F.col("user_id") == F.col("c_custkey")).select(
        "user_id", "ts", F.col("n_name").alias("location"), F.col("event_type").alias("interest"))


PAIR_DIMS = ["location", "interest"]


def trailing_7d_pair_theta(spark, sf_dir):
    lg = lg_nominal(NOMINAL)
    daily = daily_sketches(_pair_events(spark, sf_dir), dim=PAIR_DIMS, kind="theta", lg_nom=lg)
    return trailing_uniques(daily, dim=PAIR_DIMS, days=TRAILING_DAYS, kind="theta", lg_nom=lg)


def trailing_7d_pair_registers(spark, sf_dir):
    return trailing_registers(_pair_events(spark, sf_dir), dim=PAIR_DIMS, days=TRAILING_DAYS)


def trailing_7d_pair_exact(spark, sf_dir):
    return trailing_exact(_pair_events(spark, sf_dir), dim=PAIR_DIMS, days=TRAILING_DAYS)


# ---- sinks, scalar sketch functions and the SQL surface -------------------------------------
def bucket_slices_read(spark, sf_dir):
    """Every bucket directory of the left side read on its own (S2); rows add up."""
    from overlap.sources.sinks import read_bucket

    lpath, _ = write_bucketed_inputs(spark, *_inputs(spark, sf_dir), NUM_BUCKETS,
                                     scratch_path(spark, "slices"))
    out = None
    for b in range(NUM_BUCKETS):
        one = read_bucket(spark, lpath, b).select("pid", "location")
        out = one if out is None else out.unionByName(one)
    return out


def parquet_overwrite_append(spark, sf_dir):
    """Overwrite twice, then append (S4, S5) into a set number of files (S11); rows by value."""
    from overlap.sources.sinks import write_parquet

    path = scratch_path(spark, "sink")
    ints = fixtures.interests(spark, sf_dir).distinct().select("pid", F.col("interest").alias("value"))
    locs = fixtures.exploded_locations(spark, sf_dir).distinct().select(
        "pid", F.col("location").alias("value"))
    write_parquet(locs, path, num_partitions=2)
    write_parquet(ints, path, num_partitions=4)
    write_parquet(locs, path, mode="append", num_partitions=2)
    return spark.read.parquet(path).groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))


def bucketed_table_dropped(spark, sf_dir):
    """A bucketed table is read, then dropped from the catalog."""
    import uuid

    from overlap.sources.sinks import drop_table, write_bucketed_table

    table = f"overlap_drop_{uuid.uuid4().hex[:10]}"
    rows = fixtures.interests(spark, sf_dir).distinct()
    write_bucketed_table(rows, table, NUM_BUCKETS, "pid", scratch_path(spark, "drop"))
    before = spark.catalog.tableExists(table)
    counts = spark.table(table).groupBy("interest").agg(F.count(F.lit(1)).alias("n_rows"))
    drop_table(spark, table)
    return counts.select("interest", "n_rows", F.lit(before).alias("was_there"),
                         F.lit(spark.catalog.tableExists(table)).alias("is_there"))


def accuracy_report_csv(spark, sf_dir):
    """The comparison written as CSV (S9) and read back."""
    from overlap.operators.accuracy import write_report

    path = scratch_path(spark, "report")
    write_report(_accuracy(spark, sf_dir).select("location1", "interest1", "count_1", "count_2"), path)
    return spark.read.option("header", True).schema(
        "location1 string, interest1 string, count_1 long, count_2 long").csv(path)


def accuracy_by_column_name(spark, sf_dir):
    """Count columns found by their names."""
    locs, ints = _inputs(spark, sf_dir)
    a = bucketed_pairs(locs, ints, NUM_BUCKETS, mode="exact").withColumnRenamed(
        "distinct_count", "Pid_Count")
    return compare_counts(a, pair_counts(locs, ints)).select(
        "location1", "interest1", "count_1", "count_2")


def _brand_years(spark, sf_dir):
    """Every brand with every order year of the table: the cells a report asks for."""
    rows = fixtures.interests_by_year(spark, sf_dir)
    years = rows.select("year").distinct()
    return rows.select("interest").distinct().crossJoin(F.broadcast(years))  # some years a brand


def empty_sketches(spark, sf_dir):
    """Keys of the nation with the fewest customers a (brand, year): a cell that no row has is the
    empty sketch and estimates 0 (A13)."""
    from overlap.functions.sketches import empty_hll, empty_hll_bytes, hll_estimate
    from overlap.operators.hll import hll_sets

    rows = fixtures.interests_by_year(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("pid"), "c_nationkey")
    least = users.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "n", "c_nationkey").limit(1)
    few = rows.join(users.join(least, "c_nationkey").select("pid"), "pid")
    some = hll_sets(few, ["interest", "year"]).withColumnsRenamed({"interest": "i", "year": "y"})
    empty = F.lit(empty_hll_bytes(spark))
    return (_brand_years(spark, sf_dir)
            .join(some, F.col("interest").eqNullSafe(F.col("i")) & F.col("year").eqNullSafe(F.col("y")), "left")
            .select("interest", "year", hll_estimate(empty_hll(F.col("hll_bytes"), empty)).alias("estimate")))


def _with_last_year(sets: DataFrame) -> DataFrame:
    """Each (brand, year) beside the brand's sketch of the year before (null where there is none)."""
    before = sets.select(F.col("interest").alias("i"), (F.col("year") + 1).alias("y"),
                         F.col("sketch").alias("last"))
    both = sets.join(before, F.col("interest").eqNullSafe(F.col("i")) & (F.col("year") == F.col("y")), "full")
    here = F.col("year").isNotNull()
    return both.select(F.when(here, F.col("interest")).otherwise(F.col("i")).alias("interest"),
                       F.coalesce("year", "y").alias("year"), "sketch", "last")


def theta_union_of_two(spark, sf_dir):
    """Union of two stored theta sketches (E2): each brand's years with the year before."""
    from overlap.functions.sketches import theta_merge
    from overlap.schema import sketch_input

    lg = lg_nominal(NOMINAL)
    sets = fixtures.interests_by_year(spark, sf_dir).groupBy("interest", "year").agg(
        F.theta_sketch_agg(sketch_input(F.col("pid")), lg).alias("sketch"))
    merged = F.coalesce(theta_merge("sketch", "last", lg_nom=lg), F.col("sketch"), F.col("last"))
    return _with_last_year(sets).select("interest", "year", theta_estimate(merged).alias("estimate"))


def hll_union_of_two(spark, sf_dir):
    """Union of two stored HLL sketches (E3), against the exact keys of both years."""
    from overlap.functions.sketches import hll_estimate, hll_merge
    from overlap.operators.hll import hll_sets

    rows = fixtures.interests_by_year(spark, sf_dir)
    both = _with_last_year(hll_sets(rows, ["interest", "year"], lg_config_k=HLL_LG_K, out="sketch"))
    spread = rows.withColumn("y", F.explode(F.array("year", F.col("year") + 1)))
    exact = spread.groupBy(F.col("interest").alias("i"), "y").agg(F.count_distinct("pid").alias("keys"))
    est = hll_estimate(F.coalesce(hll_merge("sketch", "last"), F.col("sketch"), F.col("last")))
    return both.join(exact, F.col("interest").eqNullSafe(F.col("i")) & (F.col("year") == F.col("y"))).select(
        "interest", "year", "keys", within_bound(est, "keys", HLL_BOUND).alias("within_bound"))


def hll_union_sql(spark, sf_dir):
    """Stored HLL sketches per (brand, year), united per brand in SQL."""
    from overlap.operators.hll import hll_sets
    from overlap.plans.sql import run_union_sql

    rows = fixtures.interests_by_year(spark, sf_dir)
    stored = hll_sets(rows, ["interest", "year"], lg_config_k=HLL_LG_K, out="sketch")
    est = run_union_sql(spark, stored.withColumnRenamed("interest", "value"), "hll")
    exact = rows.groupBy("interest").agg(F.count_distinct("pid").alias("keys"))
    return exact.join(est, F.col("interest").eqNullSafe(F.col("value"))).select(
        "interest", "keys", within_bound("estimate", "keys", HLL_BOUND).alias("within_bound"))


def one_key_sketches(spark, sf_dir):
    """A sketch of one key each (F4) estimates 1."""
    from overlap.operators.registers import singleton

    return estimate_registers(singleton(fixtures.people(spark, sf_dir)), ["pid"])


def pair_approx_sql(spark, sf_dir):
    from overlap.plans.sql import run_pair_sql

    locs, ints = _inputs(spark, sf_dir)
    return _bounded(run_pair_sql(spark, locs, ints, "approx", rsd=APPROX_RSD),
                    pair_counts(locs, ints), "approx_pid_count", APPROX_BOUND)


def pair_hll_sql(spark, sf_dir):
    from overlap.plans.sql import run_pair_sql

    locs, ints = _inputs(spark, sf_dir)
    return _hll_bounded(locs, ints, run_pair_sql(spark, locs, ints, "hll", lg_k=HLL_LG_K))


def theta_union_sql(spark, sf_dir):
    """Stored theta sketches per (brand, year), united per brand in SQL."""
    from overlap.plans.sql import run_union_sql
    from overlap.schema import key_predicate, sketch_input

    lg = lg_nominal(NOMINAL)
    rows = fixtures.interests_by_year(spark, sf_dir).where(key_predicate("pid"))
    stored = rows.groupBy("interest", "year").agg(
        F.theta_sketch_agg(sketch_input(F.col("pid")), lg).alias("sketch"))
    return run_union_sql(spark, stored.withColumnRenamed("interest", "value"), "theta",
                         lg_nom=lg).withColumnRenamed("value", "interest")


def registry() -> dict[str, Query]:
    return {
        "pair_exact": pair_exact,
        "pair_exact_join": pair_exact_join,
        "pair_exact_explode_early": pair_exact_explode_early,
        "pair_theta": pair_theta,
        "theta_sets_interest": theta_sets_interest,
        "theta_sets_location": theta_sets_location,
        "theta_union_merge": theta_union_merge,
        "pair_approx": pair_approx,
        "pair_approx_raw": pair_approx_raw,
        "register_hll": register_hll_q,
        "register_hll_pairs": register_hll_pairs,
        "register_hll_merge": register_hll_merge,
        "register_hll_two_phase": register_hll_two_phase,
        "pair_hll": pair_hll,
        "pair_hll_raw": pair_hll_raw,
        "pair_hll_two_phase": pair_hll_two_phase,
        "pair_hll_bucket_by": pair_hll_bucket_by,
        "bucket_exact_one_job": bucket_exact_one_job,
        "bucket_exact_two_phase": bucket_exact_two_phase,
        "bucket_by_join_exact": bucket_by_join_exact,
        "bucket_slice_totals": bucket_slice_totals,
        "trailing_7d_exact": trailing_7d_exact,
        "trailing_7d_theta": trailing_7d_theta,
        "trailing_7d_registers": trailing_7d_registers,
        "trailing_7d_hll": trailing_7d_hll,
        "accuracy_join": accuracy_join,
        "accuracy_stats": accuracy_stats,
        "accuracy_theta_lg8_stats": accuracy_theta_lg8_stats,
        "accuracy_approx_stats": accuracy_approx_stats,
        "synth_people": synth_people,
        "synth_locations": synth_locations,
        "synth_interests": synth_interests,
        "synth_pair_exact": synth_pair_exact,
        "synth_pair_theta": synth_pair_theta,
        "stream_daily_theta": stream_daily_theta,
        "pair_exact_sql": pair_exact_sql,
        "pair_theta_sql": pair_theta_sql,
        "pair_approx_sql": pair_approx_sql,
        "pair_hll_sql": pair_hll_sql,
        "theta_union_sql": theta_union_sql,
        "register_small_width4": register_small_width4,
        "register_small_width6": register_small_width6,
        "theta_small_sets": theta_small_sets,
        "theta_small_pairs": theta_small_pairs,
        "hll_small_pairs": hll_small_pairs,
        "accuracy_theta_lg8_checked": accuracy_theta_lg8_checked,
        "accuracy_approx_checked": accuracy_approx_checked,
        "trailing_7d_pair_theta": trailing_7d_pair_theta,
        "trailing_7d_pair_registers": trailing_7d_pair_registers,
        "trailing_7d_pair_exact": trailing_7d_pair_exact,
        "bucket_slices_read": bucket_slices_read,
        "parquet_overwrite_append": parquet_overwrite_append,
        "bucketed_table_dropped": bucketed_table_dropped,
        "accuracy_report_csv": accuracy_report_csv,
        "accuracy_by_column_name": accuracy_by_column_name,
        "empty_sketches": empty_sketches,
        "theta_union_of_two": theta_union_of_two,
        "hll_union_of_two": hll_union_of_two,
        "one_key_sketches": one_key_sketches,
        "hll_union_sql": hll_union_sql,
        **merging.registry(),
    }
