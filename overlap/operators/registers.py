"""Register-table HyperLogLog in plain relational algebra.

A sketch is a set of rows ``(group..., reg, rho)``: ``reg`` is the register index taken from
the key hash, ``rho`` the rank (position of the first 1-bit) of the remaining hash bits, and a
group's register keeps ``max(rho)``. Building, merging and estimating are ordinary
``groupBy``/``max``/``sum`` aggregates -- codegen'd, partially aggregated map-side, mergeable
in any order with bit-identical results, and reproducible in any SQL engine with ``md5``.

Parameters carried from the hash-based sketch it replaces: ``log2m`` (registers = 2^log2m),
``regwidth`` (bits per register: ranks are capped at 2^regwidth - 1) and the hash ``seed``
(sketches merge only if built with the same seed; it is mixed in as a key prefix).
The state is at most groups x 2^log2m rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlap.schema import key_column, key_predicate

# Fixed defaults of the sketch being replaced: log2m 13, register width 4, hash seed 2131319.
# Width 4 caps ranks at 15, which biases estimates above some ten million keys a group; the
# default here is 6, which holds every rank (33 at most).
DEFAULT_LOG2M = 13
DEFAULT_REGWIDTH = 6
NARROW_REGWIDTH = 4
DEFAULT_SEED = 2131319


def _check(log2m: int, regwidth: int) -> None:
    if not 7 <= log2m <= 20:
        raise ValueError("log2m must be in [7, 20]")
    if not 1 <= regwidth <= 6:
        raise ValueError("regwidth must be in [1, 6]")


def register_columns(key: Column, *, log2m: int = DEFAULT_LOG2M,
                     regwidth: int = DEFAULT_REGWIDTH, seed: int = DEFAULT_SEED) -> dict:
    """``{"reg": index, "rho": rank}`` for one key (hash = md5 of ``seed:key``)."""
    hi, lo = hash_halves(key, seed)
    return registers_of(hi, lo, log2m, regwidth)


def hash_halves(key: Column, seed: int = DEFAULT_SEED) -> tuple[Column, Column]:
    """The first two 32-bit numbers of md5(``seed:key``)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"),
            F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint"))


def registers_of(hi: Column, lo: Column, log2m: int, regwidth: int) -> dict:
    """Register index (low bits of ``hi``) and rank (of ``lo``) of a hash."""
    _check(log2m, regwidth)
    rank = F.when(lo == F.lit(0), F.lit(33)).otherwise(F.lit(33) - F.length(F.bin(lo)))
    cap = (1 << regwidth) - 1
    return {"reg": F.pmod(hi, F.lit(1 << log2m)).cast("int"),
            "rho": F.least(rank, F.lit(cap)).cast("int")}


def register_hll(df: DataFrame, groups: list[str], key: str = "pid", *,
                 log2m: int = DEFAULT_LOG2M, regwidth: int = DEFAULT_REGWIDTH,
                 seed: int = DEFAULT_SEED, blank: str = "drop") -> DataFrame:
    """``(groups..., reg, rho)`` register rows of the distinct ``key`` per group."""
    k = key_column(df, key, blank)
    cols = register_columns(F.col("_k"), log2m=log2m, regwidth=regwidth, seed=seed)
    rows = df.where(key_predicate(key, blank)).select(*groups, k.alias("_k")).withColumns(cols)
    return merge_registers(rows, groups)


def sketch_spec(log2m: int, regwidth: int, seed: int) -> str:
    """Names what two register tables must share to be merged."""
    return f"log2m={log2m} regwidth={regwidth} seed={seed}"


def with_spec(regs: DataFrame, *, log2m: int = DEFAULT_LOG2M, regwidth: int = DEFAULT_REGWIDTH,
              seed: int = DEFAULT_SEED) -> DataFrame:
    """Register rows with the parameters they were built with, for storing (column ``spec``)."""
    return regs.withColumn("spec", F.lit(sketch_spec(log2m, regwidth, seed)))


def _one_spec(value: Column) -> Column:
    """``value``, or an error where the rows of a group have different specs."""
    mixed = F.concat(F.lit("register tables cannot be merged: "), F.min("spec"), F.lit(" and "),
                     F.max("spec"))
    return F.when(F.min("spec").eqNullSafe(F.max("spec")), value).otherwise(
        F.raise_error(mixed).cast("bigint"))


def merge_registers(df: DataFrame, groups: list[str]) -> DataFrame:
    """Union of register tables (any partition of the input, any order, same result).

    Tables with a ``spec`` column keep it, and rows of different specs raise.
    """
    if "spec" not in df.columns:
        return df.groupBy(*groups, "reg").agg(F.max("rho").alias("rho"))
    return df.groupBy(*groups, "reg").agg(_one_spec(F.max("rho")).cast("int").alias("rho"),
                                          F.max("spec").alias("spec"))


def fold_registers(df: DataFrame, groups: list[str], *, log2m: int, to_log2m: int) -> DataFrame:
    """Registers of precision ``log2m`` folded to the lower ``to_log2m``.

    The index is the low bits of one hash and the rank comes from another, so register r folds
    into r mod 2^to_log2m with the larger rank: the result is that of a build at ``to_log2m``.
    Tables with a ``spec`` column are folded by :func:`merge_folded`, which checks it.
    """
    _check(log2m, 1)
    _check(to_log2m, 1)
    if to_log2m > log2m:
        raise ValueError(f"registers of log2m={log2m} cannot be folded to {to_log2m}")
    if "spec" in df.columns:
        raise ValueError("a table with a spec is folded by merge_folded")
    return merge_registers(df.withColumn("reg", F.pmod("reg", F.lit(1 << to_log2m))), groups)


def merge_folded(df: DataFrame, groups: list[str], *, log2m: int, regwidth: int,
                 seed: int = DEFAULT_SEED) -> DataFrame:
    """Union of stored tables of several precisions, at the precision asked for.

    Rows of a lower precision or width than that, or of another seed, raise: nothing is merged
    at a precision that was not asked for.
    """
    _check(log2m, regwidth)
    part = lambda name: F.regexp_extract("spec", rf"{name}=(-?\d+)", 1).cast("bigint")
    fits = (part("log2m") >= log2m) & (part("regwidth") >= regwidth) & (part("seed") == seed)
    spec = sketch_spec(log2m, regwidth, seed)
    wrong = F.raise_error(F.concat(F.lit(f"registers cannot be folded to {spec}: "), F.col("spec")))
    folded = df.select(
        *groups, F.when(F.coalesce(fits, F.lit(False)), F.pmod("reg", F.lit(1 << log2m)))
        .otherwise(wrong.cast("int")).alias("reg"),
        F.least("rho", F.lit((1 << regwidth) - 1)).alias("rho"))
    return merge_registers(folded, groups).withColumn("spec", F.lit(spec))


def estimate_columns(present: Column, zsum: Column, log2m: int) -> Column:
    """The estimate from the number of non-empty registers and the sum of their 2^-rho."""
    m = float(1 << log2m)
    alpha = 0.7213 / (1.0 + 1.079 / m)
    empty = F.lit(m) - present
    raw = F.lit(alpha * m * m) / (zsum + empty)
    est = F.when((raw <= F.lit(2.5 * m)) & (empty > F.lit(0.0)),
                 F.lit(m) * F.log(F.lit(m) / empty)).otherwise(raw)
    return F.round(est).cast("bigint")


def estimate_registers(df: DataFrame, groups: list[str], *, log2m: int = DEFAULT_LOG2M,
                       out: str = "estimate") -> DataFrame:
    """``(groups..., estimate bigint)`` -- HLL harmonic mean with small-range correction.

    m = 2^log2m, V = empty registers, Z = sum 2^-rho + V, E = alpha m^2 / Z with
    alpha = 0.7213 / (1 + 1.079/m); when E <= 2.5 m and V > 0 use linear counting m ln(m/V).
    Tables with a ``spec`` column must have one spec in a group, with this ``log2m``.
    """
    present = F.count(F.lit(1))
    if "spec" in df.columns:
        wrong = ~F.max("spec").startswith(f"log2m={log2m} ")
        present = F.when(wrong, F.raise_error(F.concat(
            F.lit(f"registers cannot be estimated with log2m={log2m}: "), F.max("spec")))
            .cast("bigint")).otherwise(_one_spec(present))
    g = df.groupBy(*groups).agg(present.alias("_present"),
                                F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_zsum"))
    return g.select(*groups, estimate_columns(F.col("_present"), F.col("_zsum"), log2m).alias(out))


def singleton(df: DataFrame, key: str = "pid", *, log2m: int = DEFAULT_LOG2M,
              regwidth: int = DEFAULT_REGWIDTH, seed: int = DEFAULT_SEED) -> DataFrame:
    """a one-key sketch per row: ``(key, reg, rho)`` (union-compatible under the same seed)."""
    cols = register_columns(F.col(key), log2m=log2m, regwidth=regwidth, seed=seed)
    return df.select(key).withColumns(cols)


def register_pairs(left: DataFrame, right: DataFrame, *, key: str = "pid",
                   left_dim: str = "locations", right_dim: str = "interest",
                   left_is_array: bool = True, right_is_array: bool = False,
                   left_name: str = "location", right_name: str = "interest",
                   log2m: int = DEFAULT_LOG2M, regwidth: int = DEFAULT_REGWIDTH,
                   seed: int = DEFAULT_SEED, blank: str = "drop",
                   strategy: str = "keysets") -> DataFrame:
    """``(left_name, right_name, reg, rho)`` register sketch per co-occurring pair.

    The register of a key is computed once per key, before the pair explode, and the
    one-row-per-key join output is hash-partitioned on the register index: every
    (pair, register) group is then complete inside one task, so the ``max(rho)`` runs
    without shuffling the exploded pair rows (only the per-key rows move; the register
    index is a uniform hash, so no partition is hot).
    """
    from overlap.operators.pairs import pair_rows

    cols = register_columns(F.col(key), log2m=log2m, regwidth=regwidth, seed=seed)
    rows = pair_rows(left, right, key=key, left_dim=left_dim, right_dim=right_dim,
                     left_is_array=left_is_array, right_is_array=right_is_array,
                     left_name=left_name, right_name=right_name, strategy=strategy,
                     blank=blank, per_key=cols,
                     partition_by="reg" if strategy == "keysets" else None)
    return merge_registers(rows, [left_name, right_name])
