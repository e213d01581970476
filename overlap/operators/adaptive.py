"""Adaptive register sketches: key hashes while they are few, registers beyond.

A group of at most ``limit`` distinct keys is *explicit*: a row ``(groups..., hash)`` for each of its
64-bit key hashes, so its count is exact. A larger one is *promoted*: the rows ``(groups..., reg,
rho)`` of ``registers``. A hash names its register and rank, so explicit rows can be promoted later;
building at once and merging partial tables give the same rows. By default the limit is the number
of hashes that fill the bits of the dense form (768 at log2m 13 and register width 6).

No group is gathered to decide its form. Registers are made first (at most 2^log2m rows a group). A
group with more registers than ``limit`` has more keys too; only the hashes of the others are kept,
and those are few: they fill at most ``limit`` registers.

Null values are groups of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlap.operators.registers import (DEFAULT_LOG2M, DEFAULT_REGWIDTH, DEFAULT_SEED,
                                          estimate_columns, hash_halves, registers_of)
from overlap.schema import key_column, key_predicate


def default_limit(log2m: int = DEFAULT_LOG2M, regwidth: int = DEFAULT_REGWIDTH) -> int:
    """Hashes of 64 bits that take as much room as the registers."""
    return (regwidth << log2m) // 64


def key_hash(key: Column, seed: int = DEFAULT_SEED) -> Column:
    hi, lo = hash_halves(key, seed)
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def _registers(hash_: Column, log2m: int, regwidth: int) -> dict:
    return registers_of(F.shiftrightunsigned(hash_, 32), hash_.bitwiseAND(F.lit(0xFFFFFFFF)),
                        log2m, regwidth)


def _rows(df: DataFrame, groups: list[str], **cols: Column) -> DataFrame:
    """(groups..., hash, reg, rho) with null for what is not given."""
    types = {"hash": "bigint", "reg": "int", "rho": "int"}
    return df.select(*groups, *[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def adaptive_hll(df: DataFrame, groups: list[str], key: str = "pid", *, log2m: int = DEFAULT_LOG2M,
                 regwidth: int = DEFAULT_REGWIDTH, seed: int = DEFAULT_SEED,
                 limit: int | None = None, blank: str = "drop") -> DataFrame:
    """``(groups..., hash, reg, rho)`` of the distinct keys of each group, in the form it needs.

    The input is read twice: for the registers, and for the hashes of groups that may stay explicit.
    """
    limit = default_limit(log2m, regwidth) if limit is None else limit
    k = key_column(df, key, blank)
    # a struct's null fields are equal in a join
    hashed = df.where(key_predicate(key, blank)).select(
        *groups, F.struct(*groups).alias("_g"), key_hash(k, seed).alias("hash"))
    dense = (hashed.withColumns(_registers(F.col("hash"), log2m, regwidth))
             .groupBy(*groups, "_g", "reg").agg(F.max("rho").alias("rho")))
    few = dense.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit).select("_g")
    hashes = hashed.join(few, "_g", "left_semi").distinct()
    small = hashes.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit).select("_g")
    stay = _rows(hashes.join(small, "_g", "left_semi"), groups, hash=F.col("hash"))
    return stay.unionByName(_rows(dense.join(small, "_g", "left_anti"), groups,
                                  reg=F.col("reg"), rho=F.col("rho")))


def merge_adaptive(df: DataFrame, groups: list[str], *, log2m: int = DEFAULT_LOG2M,
                   regwidth: int = DEFAULT_REGWIDTH, limit: int | None = None) -> DataFrame:
    """Union of adaptive tables (same parameters): as one build over all their keys."""
    limit = default_limit(log2m, regwidth) if limit is None else limit
    once = (df.withColumn("_g", F.struct(*groups)).groupBy(*groups, "_g", "hash", "reg")
            .agg(F.max("rho").alias("rho")))
    form = once.groupBy("_g").agg((F.max(F.col("reg").isNotNull()) | (F.count("hash") > limit)).alias("_up"))
    marked = once.join(form, "_g")
    made = _registers(F.col("hash"), log2m, regwidth)
    up = (marked.where("_up").select(*groups, F.coalesce("reg", made["reg"]).alias("reg"),
                                     F.coalesce("rho", made["rho"]).alias("rho"))
          .groupBy(*groups, "reg").agg(F.max("rho").alias("rho")))
    return _rows(marked.where("not _up"), groups, hash=F.col("hash")).unionByName(
        _rows(up, groups, reg=F.col("reg"), rho=F.col("rho")))


def adaptive_singleton(df: DataFrame, key: str = "pid", *, seed: int = DEFAULT_SEED) -> DataFrame:
    """the one-key sketch of each row, explicit."""
    return _rows(df, [key], hash=key_hash(F.col(key), seed))


def estimate_adaptive(df: DataFrame, groups: list[str], *, log2m: int = DEFAULT_LOG2M,
                      out: str = "estimate") -> DataFrame:
    """exact for explicit groups, the register estimate for promoted ones."""
    zsum = F.sum(F.pow(F.lit(2.0), -F.col("rho")))
    g = df.groupBy(*groups).agg(F.count("hash").alias("_n"), F.count("reg").alias("_present"),
                                F.coalesce(zsum, F.lit(0.0)).alias("_zsum"))
    est = F.when(F.col("_present") == 0, F.col("_n")).otherwise(
        estimate_columns(F.col("_present"), F.col("_zsum"), log2m))
    return g.select(*groups, est.alias(out))
