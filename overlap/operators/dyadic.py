"""Trailing windows of any length from dyadic cells (A12, long windows).

Stored daily cells are united into blocks of 2, 4, 8, ... days whose bounds are multiples of
their length. Any window of N days is then a disjoint union of at most 2 log2 N cells, in place of
N daily ones. Cells of any mergeable kind take part: theta and HLL sketches, bitmaps (grouped by
block besides), register rows (grouped by register besides).

A level is made from the one below and written, so all levels together cost about twice the daily
table. Null values are groups; days without rows of a value are not reported (as in ``daily``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlap.operators.bitmaps import value_bitmaps
from overlap.operators.blocks import written
from overlap.operators.daily import daily_sketches
from overlap.operators.registers import (DEFAULT_LOG2M, DEFAULT_REGWIDTH, DEFAULT_SEED,
                                          estimate_registers, register_hll)
from overlap.schema import key_predicate


def levels_for(days: int) -> int:
    """Levels above the daily one that windows of ``days`` days can use."""
    if days < 1:
        raise ValueError("days must be >= 1")
    return days.bit_length() - 1


def dyadic_cells(daily: DataFrame, groups: list[str], merge, col: str, levels: int) -> DataFrame:
    """``(groups..., level, at, col)``: cell ``at`` of a level covers days [at, at + 1) x 2^level.

    ``merge`` is a function column -> union aggregate; days count from 1970-01-01.
    """
    cells = out = written(daily.select(*groups, F.lit(0).alias("level"), F.unix_date("day").cast("bigint")
                                       .alias("at"), col), "dyadic-0")
    for level in range(1, levels + 1):
        cells = written(cells.groupBy(*groups, F.shiftright("at", 1).alias("at"))
                        .agg(merge(F.col(col)).alias(col))
                        .select(*groups, F.lit(level).alias("level"), "at", col), f"dyadic-{level}")
        out = out.unionByName(cells)
    return out


def window_pieces(day: Column, days: int) -> Column:
    """Array of (level, at): the cells whose disjoint union is the ``days`` days ending at ``day``.

    At level j the window [low, high) shrinks to whole cells l = ceil(low / 2^j), r = floor(high / 2^j);
    an odd l is a cell that no larger one covers, and so is r - 1 for an odd r.
    """
    high = F.unix_date(day).cast("bigint") + 1
    low = high - days
    pieces = []
    for j in range(levels_for(days) + 1):
        size = 1 << j
        left, right = F.floor((low + (size - 1)) / size), F.floor(high / size)
        odd_left, odd_right = F.pmod(left, F.lit(2)) == 1, F.pmod(right, F.lit(2)) == 1
        first = odd_left & (left < right)
        rest = left + F.when(first, 1).otherwise(0)

        def cell(at: Column, level: int = j) -> Column:
            return F.struct(F.lit(level).alias("level"), at.cast("bigint").alias("at"))

        pieces += [F.when(first, cell(left)), F.when(odd_right & (rest < right), cell(right - 1))]
    return F.array_compact(F.array(*pieces))


def trailing_union(cells: DataFrame, targets: DataFrame, dims: list[str], days: int, merge, col: str,
                   within: list[str] | None = None) -> DataFrame:
    """``(dims..., day, within..., col)``: cells of the ``days`` days up to each day of ``targets``."""
    asked = targets.select(*[F.col(d).alias(f"_{d}") for d in dims], "day",
                           F.explode(window_pieces(F.col("day"), days)).alias("_p"))
    on = (asked["_p.level"] == cells["level"]) & (asked["_p.at"] == cells["at"])
    for d in dims:
        on = on & asked[f"_{d}"].eqNullSafe(cells[d])
    return (asked.join(cells, on).groupBy(*[F.col(f"_{d}").alias(d) for d in dims], "day", *(within or []))
            .agg(merge(F.col(col)).alias(col)))


def trailing_theta(events: DataFrame, *, key: str = "user_id", dim: str = "event_type", ts: str = "ts",
                   days: int = 7, lg_nom: int = 12, blank: str = "drop", out: str = "uniques") -> DataFrame:
    """Trailing uniques by theta sketches in dyadic cells."""
    daily = written(daily_sketches(events, key=key, dim=dim, ts=ts, kind="theta", lg_nom=lg_nom,
                                   blank=blank), "daily")
    merge = lambda c: F.theta_union_agg(c, lg_nom)
    cells = dyadic_cells(daily, [dim], merge, "sketch", levels_for(days))
    union = trailing_union(cells, daily.select(dim, "day"), [dim], days, merge, "sketch")
    return union.select(dim, "day", F.theta_sketch_estimate("sketch").cast("bigint").alias(out))


def trailing_bitmaps(events: DataFrame, numbers: DataFrame, *, key: str = "user_id", dim: str = "event_type",
                     ts: str = "ts", days: int = 7, blank: str = "drop", out: str = "uniques") -> DataFrame:
    """Exact trailing uniques: bitmaps of (value, day, block), united by OR in dyadic cells."""
    dated = events.where(F.col(ts).isNotNull()).withColumn("day", F.to_date(ts))
    daily = written(value_bitmaps(dated, numbers, key=key, dim=dim, blank=blank, extra=["day"]), "daily-bits")
    cells = dyadic_cells(daily, [dim, "block"], F.bitmap_or_agg, "bits", levels_for(days))
    union = trailing_union(cells, daily.select(dim, "day").distinct(), [dim], days, F.bitmap_or_agg,
                           "bits", within=["block"])
    return union.groupBy(dim, "day").agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(out))


def trailing_register_cells(events: DataFrame, *, key: str = "user_id", dim: str = "event_type",
                            ts: str = "ts", days: int = 7, log2m: int = DEFAULT_LOG2M,
                            regwidth: int = DEFAULT_REGWIDTH, seed: int = DEFAULT_SEED,
                            blank: str = "drop", out: str = "uniques") -> DataFrame:
    """Trailing uniques by register rows: a window's register is the greatest of its cells'."""
    dated = events.where(F.col(ts).isNotNull() & key_predicate(key, blank)).withColumn("day", F.to_date(ts))
    daily = written(register_hll(dated, [dim, "day"], key, log2m=log2m, regwidth=regwidth, seed=seed,
                                 blank=blank), "daily-registers")
    cells = dyadic_cells(daily, [dim, "reg"], F.max, "rho", levels_for(days))
    union = trailing_union(cells, daily.select(dim, "day").distinct(), [dim], days, F.max, "rho",
                           within=["reg"])
    return estimate_registers(union, [dim, "day"], log2m=log2m, out=out)
