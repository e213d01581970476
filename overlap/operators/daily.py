"""Trailing-N-day unique keys from daily mergeable sketches.

Build one sketch per (day, dimension values) once; any trailing window is then a union of
at most N small sketches per output row instead of a re-scan of N days of raw rows. The
daily table is the incremental state: a new day appends one sketch per value. The values may
be one column or several, e.g. (location, interest) pairs of the joined inputs.

The sketch window runs over the *daily sketch table* (one row per day and value), framed by
``RANGE BETWEEN N-1 PRECEDING AND CURRENT ROW`` on the day number, so a missing day is simply
absent from the frame. Exact and register forms copy no row to the days it counts for: they
emit where a key (or a register's rank) enters and leaves the window, and sum up by day.
Null values are groups of their own in every form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlap.operators.registers import (DEFAULT_LOG2M, DEFAULT_REGWIDTH, DEFAULT_SEED,
                                          estimate_columns, merge_registers,
                                          register_columns)
from overlap.operators.sketch_tree import FANIN, sketch_aggregate
from overlap.operators.theta import check_parameter
from overlap.schema import key_column, key_predicate, sketch_input

KINDS = ("theta", "hll")


def _dims(dim: str | list[str]) -> list[str]:
    return [dim] if isinstance(dim, str) else list(dim)


def _daily_rows(df: DataFrame, key: str, dims: list[str], ts: str, blank: str) -> DataFrame:
    return (df.where(key_predicate(key, blank) & F.col(ts).isNotNull())
              .select(*dims, F.to_date(F.col(ts)).alias("day"),
                      key_column(df, key, blank).alias("_k")))


def daily_sketches(df: DataFrame, *, key: str = "user_id", dim: str | list[str] = "event_type",
                   ts: str = "ts", kind: str = "theta", lg_nom: int = 12,
                   lg_config_k: int = 13, blank: str = "drop",
                   fanin: int = FANIN) -> DataFrame:
    """``(dims..., day, sketch, lg)``: one sketch of the keys per (values, day).

    The sketch parameter is stored with the cell and checked when cells are merged.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    dims = _dims(dim)
    rows = _daily_rows(df, key, dims, ts, blank)
    v = sketch_input(F.col("_k"), blank)
    if kind == "theta":
        build, lg = F.theta_sketch_agg(v, lg_nom), lg_nom
        merge = lambda c: F.theta_union_agg(c, lg_nom)
    else:
        build, lg = F.hll_sketch_agg(v, lg_config_k), lg_config_k
        merge = lambda c: F.hll_union_agg(c, False)
    return (sketch_aggregate(rows, [*dims, "day"], build, merge, "sketch", fanin)
            .withColumn("lg", F.lit(lg)))


def trailing_uniques(daily: DataFrame, *, dim: str | list[str] = "event_type", days: int = 7,
                     kind: str = "theta", lg_nom: int = 12, lg_config_k: int = 13,
                     out: str = "uniques") -> DataFrame:
    """``(dims..., day, uniques)``: distinct keys in the ``days`` days ending at ``day``.

    A table whose cells were stored with another parameter raises.
    """
    if days < 1:
        raise ValueError("days must be >= 1")
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    dims = _dims(dim)
    if "lg" in daily.columns:
        daily = check_parameter(daily, "sketch", "lg", lg_nom if kind == "theta" else lg_config_k)
    w = (Window.partitionBy(*dims).orderBy(F.unix_date("day"))
         .rangeBetween(-(days - 1), Window.currentRow))
    if kind == "theta":
        est = F.theta_sketch_estimate(F.theta_union_agg("sketch", lg_nom).over(w))
    else:
        est = F.hll_sketch_estimate(F.hll_union_agg("sketch", False).over(w))
    return daily.select(*dims, "day", est.cast("bigint").alias(out))


def _edges(rows: DataFrame, unit: list[str], days: int, *amounts: Column) -> DataFrame:
    """Rows (.., day, amounts, present) where a unit's days enter and leave the window.

    ``rows`` has one row per unit and day. Between two of its days that are less than the
    window apart the unit stays in; so it enters on the first day after a gap and leaves
    ``days`` days after the last one before a gap.
    """
    w = Window.partitionBy(*unit).orderBy("day")
    last, after = F.lag("day").over(w), F.lead("day").over(w)
    near = rows.withColumns({"_enter": last.isNull() | (F.datediff("day", last) > days - 1),
                             "_leave": after.isNull() | (F.datediff(after, "day") > days - 1)})
    signs = F.array_compact(F.array(
        F.struct(F.col("day"), F.when(F.col("_enter"), 1).otherwise(0).alias("sign"),
                 F.lit(True).alias("present")),
        F.when(F.col("_leave"), F.struct(F.date_add("day", days).alias("day"), F.lit(-1).alias("sign"),
                                         F.lit(False).alias("present")))))
    return near.withColumn("_e", F.explode(signs))


def _running(steps: DataFrame, dims: list[str], values: list[str]) -> DataFrame:
    """Running sums by day, on the days that have data."""
    by_day = steps.groupBy(*dims, "day").agg(*[F.sum(v).alias(v) for v in values],
                                            F.max("present").alias("present"))
    w = Window.partitionBy(*dims).orderBy("day")  # one row a day
    return (by_day.select(*dims, "day", "present", *[F.sum(v).over(w).alias(v) for v in values])
            .where("present").drop("present"))


def trailing_exact(df: DataFrame, *, key: str = "user_id", dim: str | list[str] = "event_type",
                   ts: str = "ts", days: int = 7, blank: str = "drop",
                   out: str = "uniques") -> DataFrame:
    """Exact companion: per (values, key) +1 and -1 at the window's edges, summed by day."""
    dims = _dims(dim)
    daily = _daily_rows(df, key, dims, ts, blank).distinct()
    edges = _edges(daily, [*dims, "_k"], days)
    steps = edges.select(*dims, "_e.day", F.col("_e.sign").alias(out), "_e.present")
    return _running(steps, dims, [out]).select(*dims, "day", F.col(out).cast("bigint").alias(out))


def trailing_registers(df: DataFrame, *, key: str = "user_id", dim: str | list[str] = "event_type",
                       ts: str = "ts", days: int = 7, log2m: int = DEFAULT_LOG2M,
                       regwidth: int = DEFAULT_REGWIDTH, seed: int = DEFAULT_SEED,
                       blank: str = "drop", out: str = "uniques") -> DataFrame:
    """Register-table form, without copies of rows to the days they count for.

    A register's window maximum is at least r while any of its days has rank r or more. So
    each (values, register, threshold) unit is in the window or not; its edges change the
    count of non-empty registers and the sum of 2^-max by exact binary fractions.
    """
    dims = _dims(dim)
    rows = _daily_rows(df, key, dims, ts, blank)
    cols = register_columns(F.col("_k"), log2m=log2m, regwidth=regwidth, seed=seed)
    daily = merge_registers(rows.withColumns(cols), [*dims, "day"])
    units = daily.select(*dims, "day", "reg", F.explode(F.sequence(F.lit(1), F.col("rho")))
                         .alias("_at"))
    edges = _edges(units, [*dims, "reg", "_at"], days)
    # 2^-max = 1 - sum of 2^-r over the thresholds r reached; the first one fills a register
    steps = edges.select(*dims, "_e.day", "_e.present",
                         (F.col("_e.sign") * F.when(F.col("_at") == 1, 1).otherwise(0))
                         .alias("_present"),
                         (F.col("_e.sign") * F.pow(F.lit(2.0), -F.col("_at"))).alias("_gone"))
    sums = _running(steps, dims, ["_present", "_gone"])
    return sums.select(*dims, "day", estimate_columns(
        F.col("_present"), F.col("_present") - F.col("_gone"), log2m).alias(out))
