"""Registered queries of the mergeable forms: screened theta sets, bitmaps, blocks, dyadic windows
stored daily pair sketches that are kept up to date, adaptive and folded registers, planned buckets and
late rows of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from overlap.functions.metrics import within_bound
from overlap.operators import adaptive, bitmaps, dyadic, screened, synth
from overlap.operators.blocks import written
from overlap.operators.bucket_plan import planned_pairs
from overlap.operators.pairs import pair_counts
from overlap.operators.registers import (estimate_registers, fold_registers, merge_folded, register_hll,
                                          with_spec)
from overlap.operators.upkeep import PairSketches
from overlap.session import scratch_path
from overlap.sources import fixtures
from overlap.streaming.late import DailyStore, start_daily_store_stream

NOMINAL = 16384
SMALL_NOMINAL = 256
LOW_LOG2M = 11
EXPLICIT = 100  # key hashes that a group may keep: small, so that the test tables have both forms
PLANNED_BUCKETS = 32
BLOCK = 8  # values of a key in a chunk: small, so that the test tables' keys are cut too


def _inputs(spark, sf_dir):
    return fixtures.locations(spark, sf_dir), fixtures.interests(spark, sf_dir)


def pair_theta_screened(spark, sf_dir):
    """The whole grid of pairs, zeros included, from screened sets."""
    return screened.screened_pairs(*_inputs(spark, sf_dir), nominal_entries=NOMINAL, include_zero_pairs=True)


def pair_theta_sparse(spark, sf_dir):
    """Only pairs that share a key: the work follows the overlap."""
    return screened.screened_pairs(*_inputs(spark, sf_dir), nominal_entries=NOMINAL)


def _inputs_once(spark, sf_dir):
    """The same rows, written once: for queries that read their inputs several times."""
    locs, ints = _inputs(spark, sf_dir)
    return written(locs, "locations"), written(ints, "interests")


def theta_screened_sets(spark, sf_dir):
    sets = screened.screened_sets(fixtures.interests(spark, sf_dir), nominal_entries=NOMINAL)
    return screened.screened_estimates(sets, "interest")


def theta_screened_union(spark, sf_dir):
    """Sets of each order year, united per brand."""
    rows = fixtures.interests_by_year(spark, sf_dir)
    by_year = screened.screened_sets(
        rows.withColumn("cell", F.struct("interest", "year")), dim="cell", nominal_entries=NOMINAL)
    stored = by_year.select(F.col("cell.interest").alias("interest"), "hash", "limit")
    return screened.screened_estimates(screened.merge_screened(stored, "interest"), "interest")


def theta_screened_small_sets(spark, sf_dir):
    """256 entries: estimates within 4 standard errors of the exact keys."""
    ints = fixtures.interests(spark, sf_dir)
    est = screened.screened_estimates(screened.screened_sets(ints, nominal_entries=SMALL_NOMINAL), "interest")
    exact = ints.distinct().groupBy(F.col("interest").alias("i")).agg(F.count(F.lit(1)).alias("keys"))
    return est.join(exact, F.col("interest").eqNullSafe(F.col("i"))).select(
        "interest", "keys", within_bound("estimate", "keys", 4 / SMALL_NOMINAL ** 0.5).alias("within_bound"))


def theta_screened_small_pairs(spark, sf_dir):
    """The same for pairs; an intersection's error follows the size of the union."""
    locs, ints = _inputs_once(spark, sf_dir)
    left = locs.select("pid", F.explode("locations").alias("location"))
    # one row a customer, whose locations are distinct
    nl = left.groupBy("location").agg(F.count(F.lit(1)).alias("nl"))
    nr = ints.distinct().groupBy("interest").agg(F.count(F.lit(1)).alias("nr"))
    est = screened.screened_pairs(locs, ints, nominal_entries=SMALL_NOMINAL, include_zero_pairs=True)
    j = est.join(pair_counts(locs, ints), ["location", "interest"], "left")
    j = j.join(nl, "location").join(nr, "interest").withColumn(
        "distinct_count", F.coalesce("distinct_count", F.lit(0)))
    union = F.col("nl") + F.col("nr") - F.col("distinct_count")
    bound = 4 * F.sqrt(F.col("distinct_count") * union / F.lit(float(SMALL_NOMINAL))) + 1
    return j.select("location", "interest", "distinct_count",
                    (F.abs(F.col("set_intersection_count") - F.col("distinct_count")) <= bound)
                    .alias("within_bound"))


def pair_exact_blocks(spark, sf_dir):
    return pair_counts(*_inputs_once(spark, sf_dir), strategy="blocks", chunk=BLOCK)


def pair_exact_bitmaps(spark, sf_dir):
    return bitmaps.bitmap_pairs(*_inputs(spark, sf_dir))


def bitmap_uniques(spark, sf_dir):
    """Bitmaps of each order year, united per brand: exact distinct keys."""
    rows = fixtures.interests_by_year(spark, sf_dir)
    numbers = bitmaps.key_numbers(rows)
    stored = bitmaps.value_bitmaps(rows, numbers, extra=["year"])
    return bitmaps.bitmap_uniques(bitmaps.merge_bitmaps(stored, ["interest"]), ["interest"])


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts")


def _trailing_bitmaps(days):
    def query(spark, sf_dir):
        ev = _events(spark, sf_dir)
        return dyadic.trailing_bitmaps(ev, bitmaps.key_numbers(ev, key="user_id"), days=days)
    return query


def _trailing_theta(days):
    return lambda spark, sf_dir: dyadic.trailing_theta(
        _events(spark, sf_dir), days=days, lg_nom=NOMINAL.bit_length() - 1)


def trailing_7d_dyadic_registers(spark, sf_dir):
    return dyadic.trailing_register_cells(_events(spark, sf_dir), days=7)


def _upkeep(spark, sf_dir, kind):
    """Events and users arrive in three batches each, at different times; every row is used."""
    users = (spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
             .join(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"),
                   F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.col("c_custkey").alias("pid"), F.col("n_name").alias("location")))
    events = _events(spark, sf_dir).select(F.col("user_id").alias("pid"), F.col("event_type").alias("interest"),
                                           F.to_date("ts").alias("day"))
    arrival = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    store = PairSketches(spark, scratch_path(spark, f"upkeep-{kind}"), kind=kind,
                         lg_nom=NOMINAL.bit_length() - 1)
    for batch in range(3):
        store.apply(batch, users.where(arrival("pid") == batch), events.where(arrival("day") == 2 - batch))
    return store.estimates()


def pair_daily_upkeep_theta(spark, sf_dir):
    return _upkeep(spark, sf_dir, "theta")


def pair_daily_upkeep_registers(spark, sf_dir):
    return _upkeep(spark, sf_dir, "registers")


def adaptive_sets(spark, sf_dir):
    """Brands of a year: exact up to the limit, registers above it."""
    rows = fixtures.interests_by_year(spark, sf_dir)
    groups = ["interest", "year"]
    return adaptive.estimate_adaptive(adaptive.adaptive_hll(rows, groups, limit=EXPLICIT), groups)


def adaptive_merge(spark, sf_dir):
    """Adaptive tables of each year, united per brand."""
    rows = fixtures.interests_by_year(spark, sf_dir)
    stored = adaptive.adaptive_hll(rows, ["interest", "year"], limit=EXPLICIT).drop("year")
    return adaptive.estimate_adaptive(
        adaptive.merge_adaptive(stored, ["interest"], limit=EXPLICIT), ["interest"])


def adaptive_singletons(spark, sf_dir):
    """One-key sketches of all customers."""
    return adaptive.estimate_adaptive(adaptive.adaptive_singleton(fixtures.people(spark, sf_dir)), ["pid"])


def register_fold(spark, sf_dir):
    """Built at log2m 13, folded to 11."""
    regs = fold_registers(register_hll(fixtures.interests(spark, sf_dir), ["interest"]), ["interest"],
                          log2m=13, to_log2m=LOW_LOG2M)
    return estimate_registers(regs, ["interest"], log2m=LOW_LOG2M)


def register_mixed_merge(spark, sf_dir):
    """Odd years stored at log2m 13, even years at 11, united at 11."""
    rows = fixtures.interests_by_year(spark, sf_dir)
    stored = [with_spec(register_hll(rows.where(F.col("year") % 2 == odd), ["interest"], log2m=m), log2m=m)
              for odd, m in ((1, 13), (0, LOW_LOG2M))]
    merged = merge_folded(stored[0].unionByName(stored[1]), ["interest"], log2m=LOW_LOG2M, regwidth=6)
    return estimate_registers(merged, ["interest"], log2m=LOW_LOG2M)


def pair_exact_planned(spark, sf_dir):
    return planned_pairs(spark, *_inputs(spark, sf_dir), PLANNED_BUCKETS, scratch_path(spark, "planned"))


def synth_people_symbols(spark, sf_dir):
    return synth.symbol_people(fixtures.people(spark, sf_dir), "pid")


def _late(kind):
    def query(spark, sf_dir):
        """All events, streamed as four files in an order that has nothing to do with their days."""
        ev, source = _events(spark, sf_dir), scratch_path(spark, f"late-{kind}-source")
        ev.repartition(4, "user_id").write.parquet(source)
        store = DailyStore(spark, scratch_path(spark, f"late-{kind}"), kind=kind,
                           lg_nom=NOMINAL.bit_length() - 1)
        start_daily_store_stream(store, source, ev.schema, max_files_per_trigger=1).awaitTermination()
        return store.estimates()
    return query


def registry() -> dict:
    return {
        "adaptive_sets": adaptive_sets,
        "adaptive_merge": adaptive_merge,
        "adaptive_singletons": adaptive_singletons,
        "register_fold": register_fold,
        "register_mixed_merge": register_mixed_merge,
        "pair_exact_planned": pair_exact_planned,
        "synth_people_symbols": synth_people_symbols,
        "stream_late_theta": _late("theta"),
        "stream_late_registers": _late("registers"),
        "pair_theta_screened": pair_theta_screened,
        "pair_theta_sparse": pair_theta_sparse,
        "theta_screened_sets": theta_screened_sets,
        "theta_screened_union": theta_screened_union,
        "theta_screened_small_sets": theta_screened_small_sets,
        "theta_screened_small_pairs": theta_screened_small_pairs,
        "pair_exact_blocks": pair_exact_blocks,
        "pair_exact_bitmaps": pair_exact_bitmaps,
        "bitmap_uniques": bitmap_uniques,
        "trailing_7d_bitmaps": _trailing_bitmaps(7),
        "trailing_28d_bitmaps": _trailing_bitmaps(28),
        "trailing_28d_dyadic_theta": _trailing_theta(28),
        "trailing_90d_dyadic_theta": _trailing_theta(90),
        "trailing_7d_dyadic_registers": trailing_7d_dyadic_registers,
        "pair_daily_upkeep_theta": pair_daily_upkeep_theta,
        "pair_daily_upkeep_registers": pair_daily_upkeep_registers,
    }
