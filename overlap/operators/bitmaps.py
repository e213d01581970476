"""Exact, mergeable key sets: bitmaps over dense key numbers (A1, A12, and A5-like unions).

Keys are numbered 1, 2, 3, ... without gaps; a set is one bitmap of 4,096 bytes for each block of
32,768 numbers in which it has a key. Union and intersection are bitwise, so stored sets merge
exactly, in any order and with any overlap, and a pair's exact count is the number of common bits.
The two inputs' rows never meet: only bitmaps do, block by block.

Numbers come from a hash partition of the distinct keys, counted within each part, plus the parts'
prefix sums (``parts`` rows, a fixed number). The table is written before use, so a retried task
sees the same numbers. New keys of a later batch are numbered behind the old ones
(``extend_numbers``), so stored bitmaps stay valid.

This form suits dimensions whose values hold many keys a block. Where most values hold a few keys
only, the pairs of a block's values outnumber the pairs of its keys, and ``pair_counts`` is the
better plan. Null values are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlap.operators.blocks import written
from overlap.operators.pairs import _values
from overlap.schema import key_column, key_predicate

PARTS = 4096


def _numbered(keys: DataFrame, key: str, parts: int, start: int) -> DataFrame:
    by_part = Window.partitionBy("_part").orderBy(key)
    rows = written(keys.select(key).distinct()
                   .withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
                   .withColumn("_at", F.row_number().over(by_part)), "key-parts")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # at most ``parts`` rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return written(rows.join(F.broadcast(offsets), "_part").select(
        key, (F.lit(start) + F.col("_before") + F.col("_at")).alias("num")), "key-numbers")


def key_numbers(*inputs: DataFrame, key: str = "pid", blank: str = "drop", parts: int = PARTS) -> DataFrame:
    """``(key string, num bigint)``: the distinct keys of all inputs, numbered from 1 without gaps."""
    keys = None
    for df in inputs:
        one = df.where(key_predicate(key, blank)).select(key_column(df, key, blank).alias(key))
        keys = one if keys is None else keys.unionByName(one)
    return _numbered(keys, key, parts, 0)


def extend_numbers(numbers: DataFrame, *inputs: DataFrame, key: str = "pid", blank: str = "drop",
                   parts: int = PARTS) -> DataFrame:
    """``numbers`` and, behind them, the keys of ``inputs`` that are new."""
    keys = None
    for df in inputs:
        one = df.where(key_predicate(key, blank)).select(key_column(df, key, blank).alias(key))
        keys = one if keys is None else keys.unionByName(one)
    last = numbers.agg(F.max("num")).first()[0] or 0
    return numbers.unionByName(_numbered(keys.join(numbers, key, "left_anti"), key, parts, last))


def value_bitmaps(df: DataFrame, numbers: DataFrame, *, key: str = "pid", dim: str = "interest",
                  name: str | None = None, is_array: bool = False, blank: str = "drop",
                  extra: list[str] | None = None) -> DataFrame:
    """``(name, *extra, block, bits)``: the keys of each value (and of the ``extra`` columns)."""
    name, extra = name or dim, list(extra or [])
    # distinct first: a hot key is then at most one row a value, and the join is by that
    rows = _values(df, key, dim, is_array, name, blank, extra).distinct()
    num = F.col("num")
    return (rows.join(numbers, key)
            .groupBy(name, *extra, F.bitmap_bucket_number(num).alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(num)).alias("bits")))


def merge_bitmaps(cells: DataFrame, groups: list[str]) -> DataFrame:
    """Union of stored bitmaps a group and block."""
    return cells.groupBy(*groups, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_uniques(cells: DataFrame, groups: list[str], out: str = "uniques") -> DataFrame:
    """``(groups..., out bigint)``: distinct keys of each group; its bitmaps must be merged."""
    return cells.groupBy(*groups).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(out))


def bitmap_pair_counts(left_bits: DataFrame, right_bits: DataFrame, *, left_name: str = "location",
                       right_name: str = "interest", count_col: str = "distinct_count") -> DataFrame:
    """Exact ``(left_name, right_name, distinct_count)`` of the pairs with a common key.

    Bitmaps meet by block; the grouping by (block, pair) needs no further exchange, as it contains
    the block. Only counts leave a task.
    """
    ls = left_bits.select("block", F.col(left_name).alias("_a"), F.col("bits").alias("_l"))
    rs = right_bits.select("block", F.col(right_name).alias("_b"), F.col("bits").alias("_r"))
    met = ls.join(rs, "block").select("block", "_a", "_b", F.explode(F.array("_l", "_r")).alias("_x"))
    common = (met.groupBy("block", "_a", "_b").agg(F.bitmap_count(F.bitmap_and_agg("_x")).alias("_n"))
              .where("_n > 0"))
    return common.groupBy(F.col("_a").alias(left_name), F.col("_b").alias(right_name)).agg(
        F.sum("_n").cast("bigint").alias(count_col))


def bitmap_pairs(left: DataFrame, right: DataFrame, *, key: str = "pid", left_dim: str = "locations",
                 right_dim: str = "interest", left_is_array: bool = True, right_is_array: bool = False,
                 left_name: str = "location", right_name: str = "interest", blank: str = "drop",
                 count_col: str = "distinct_count") -> DataFrame:
    """Q1 end to end by bitmaps. Keys that one side alone has are not numbered: they are in no pair."""
    one = left.where(key_predicate(key, blank)).select(key_column(left, key, blank).alias(key))
    two = right.where(key_predicate(key, blank)).select(key_column(right, key, blank).alias(key))
    numbers = _numbered(one.distinct().join(two.distinct(), key, "left_semi"), key, PARTS, 0)
    return bitmap_pair_counts(
        value_bitmaps(left, numbers, key=key, dim=left_dim, name=left_name, is_array=left_is_array,
                      blank=blank),
        value_bitmaps(right, numbers, key=key, dim=right_dim, name=right_name, is_array=right_is_array,
                      blank=blank), left_name=left_name, right_name=right_name, count_col=count_col)
