"""Path-to-path jobs: what a user of the reference runs (read -> compute -> write).

* ``pair_job``      -- Q1-Q4: pair counts / sketches from two Parquet inputs to Parquet,
  with the method, bucketing technique and sketch parameters as arguments.
* ``accuracy_job``  -- Q6: compare an approximate result with an exact one from their
  Parquet outputs (HLL bytes are estimated first), CSV report, min/max/avg.
* ``generate_job``  -- Q7: people / locations / interests tables from a given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.operators import synth
from overlap.operators.accuracy import compare_counts, error_stats, sketch_counts, write_report
from overlap.operators.buckets import bucket_by_pairs, bucketed_pairs, two_phase_pairs
from overlap.operators.hll import hll_pairs
from overlap.operators.pairs import pair_counts
from overlap.operators.registers import (DEFAULT_LOG2M, DEFAULT_REGWIDTH, DEFAULT_SEED,
                                          estimate_registers, register_pairs, with_spec)
from overlap.operators.theta import theta_pairs
from overlap.sources.sinks import write_parquet

METHODS = ("exact", "approx", "theta", "hll", "registers")
TECHNIQUES = ("none", "one_job", "partitioned", "bucket_by")


def pair_result(spark: SparkSession, locations: DataFrame, interests: DataFrame, *,
                method: str = "theta", technique: str = "none", num_buckets: int = 1,
                nominal_entries: int = 4096, lg_config_k: int = 13, log2m: int = DEFAULT_LOG2M,
                regwidth: int = DEFAULT_REGWIDTH, seed: int = DEFAULT_SEED, rsd: float = 0.05,
                strategy: str = "keysets", root: str | None = None,
                mergeable: bool = False) -> DataFrame:
    """The result DataFrame of ``pair_job`` (nothing written except bucketing scratch).

    ``mergeable`` gives the registers themselves (with their parameters) instead of estimates,
    as the HLL method always gives its sketches.
    """
    registers_out = _mergeable if mergeable else _estimated
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if technique not in TECHNIQUES:
        raise ValueError(f"technique must be one of {TECHNIQUES}")
    if technique != "none" and method not in ("exact", "hll", "registers"):
        raise ValueError("bucketing applies to the exact, hll and registers methods")
    if technique == "none" or num_buckets <= 1:
        if method in ("exact", "approx"):
            return pair_counts(locations, interests, exact=method == "exact", rsd=rsd,
                               strategy=strategy)
        if method == "theta":
            return theta_pairs(locations, interests, nominal_entries=nominal_entries)
        if method == "hll":
            return hll_pairs(locations, interests, lg_config_k=lg_config_k, strategy=strategy)
        return registers_out(register_pairs(locations, interests, log2m=log2m,
                                            regwidth=regwidth, seed=seed), log2m, regwidth, seed)
    params = dict(mode=method, lg_config_k=lg_config_k, log2m=log2m, regwidth=regwidth,
                  seed=seed)
    if technique == "one_job":
        out = bucketed_pairs(locations, interests, num_buckets, **params)
    elif technique == "partitioned":
        out = two_phase_pairs(spark, locations, interests, num_buckets, root=root, **params)
    else:
        out = bucket_by_pairs(spark, locations, interests, num_buckets, root=root, **params)
    if method == "registers":
        out = registers_out(out, log2m, regwidth, seed)
    return out


def _mergeable(regs: DataFrame, log2m: int, regwidth: int, seed: int) -> DataFrame:
    return with_spec(regs, log2m=log2m, regwidth=regwidth, seed=seed)


def _estimated(regs: DataFrame, log2m: int, regwidth: int, seed: int) -> DataFrame:
    return estimate_registers(regs, ["location", "interest"], log2m=log2m)


def pair_job(spark: SparkSession, locations_path: str, interests_path: str, output_path: str,
             **params) -> DataFrame:
    """Read both inputs, compute ``pair_result(**params)``, overwrite ``output_path``."""
    locs = spark.read.parquet(locations_path)
    ints = spark.read.parquet(interests_path)
    write_parquet(pair_result(spark, locs, ints, **params), output_path)
    return spark.read.parquet(output_path)


def accuracy_job(spark: SparkSession, approx_path: str, exact_path: str,
                 report_path: str | None = None, *, count_a: str | None = None,
                 count_b: str | None = None, how: str = "inner",
                 sketch_col: str = "hll_bytes", log2m: int = DEFAULT_LOG2M) -> DataFrame:
    """Q6 from files: one-row ``(min_, max_, avg_percent_difference, pairs)``.

    HLL sketches and register rows are estimated first.
    """
    a = spark.read.parquet(approx_path)
    b = spark.read.parquet(exact_path)
    if sketch_col in a.columns:
        a = sketch_counts(a, sketch_col, out="count")
    elif {"reg", "rho"} <= set(a.columns):
        a = estimate_registers(a, ["location", "interest"], log2m=log2m, out="count")
    cmp = compare_counts(a, b, count_a=count_a, count_b=count_b, how=how)
    if report_path:
        write_report(cmp, report_path)
    return error_stats(cmp)


def generate_job(spark: SparkSession, sf_dir: str, out_root: str, *, source: str = "customer",
                 seed: int = synth.DEFAULT_SEED, num_partitions: int = 8) -> DataFrame:
    """Q7: write people, locations and interests (``num_partitions`` files each, S11) and
    return the written row counts ``(table, n_rows)`` (S12)."""
    ppl = synth.people(spark, sf_dir, source=source, seed=seed, num_partitions=num_partitions)
    write_parquet(ppl, f"{out_root}/people", num_partitions=num_partitions)
    ppl = spark.read.parquet(f"{out_root}/people")  # made once, read by the other two
    tables = {"people": None, "locations": synth.person_locations(ppl, seed=seed),
              "interests": synth.person_interests(ppl, seed=seed)}
    counts = None
    for name, df in tables.items():
        if df is not None:
            write_parquet(df, f"{out_root}/{name}", num_partitions=num_partitions)
        c = spark.read.parquet(f"{out_root}/{name}").agg(F.count(F.lit(1)).alias("n_rows")) \
            .select(F.lit(name).alias("table"), "n_rows")
        counts = c if counts is None else counts.unionByName(c)
    return counts
