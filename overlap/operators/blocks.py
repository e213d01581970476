"""Pair rows of a key join whose hot keys are cut into blocks.

A key with n values on one side and m on the other yields n x m pairs. With one row a key that
product is made in one task. Here a key with more than ``chunk`` values on a side is *hot*: its
two sets are cut into chunks of about ``chunk`` values by a hash of the value, every chunk of one
side meets every chunk of the other in a block of its own, and the blocks are dealt to tasks by
hash. All other keys take the usual form (one row a key and side).

Hot keys are found by a count of rows a key (map-side combined); their chunks follow the count
of *distinct* values, so a key with many repeated rows and few values is one block again. The
table of hot keys is written before it is used. Up to ``FEW`` of them Spark may broadcast it and the
tables made from it; beyond that the joins with them are shuffled: files of a few MB can hold millions
of keys, which the driver would have to unpack and hold for every such join.

A pair row occurs once, and the rows are the same whatever keys are cut. Null values are values;
null keys take no part (as in a join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlap.session import scratch_path

CHUNK = 1024
FEW = 10_000  # hot keys whose tables may be broadcast


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared scratch folder and read back (size known, lineage cut)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sets(rows: DataFrame, on: list[str], value: str, out: str) -> DataFrame:
    """One row for each ``on`` with its distinct values; a null value stays, inside its struct."""
    return rows.groupBy(*on).agg(F.collect_set(F.struct(F.col(value).alias("v"))).alias(out))


def _exploded(joined: DataFrame, keep: list[str], left_name: str, right_name: str) -> DataFrame:
    one = joined.select(*keep, F.explode("_l").alias("_a"), "_r")
    two = one.select(*keep, "_a", F.explode("_r").alias("_b"))
    return two.select(*keep, F.col("_a.v").alias(left_name), F.col("_b.v").alias(right_name))


def heavy_keys(left: DataFrame, right: DataFrame, on: str, chunk: int = CHUNK,
               left_weight: Column | None = None, right_weight: Column | None = None) -> DataFrame | None:
    """The values of ``on`` that have more than ``chunk`` rows on a side; None if there are none.

    A weight says how many rows an input row stands for (the size of an array, say).
    """
    nl = left.groupBy(on).agg(F.sum(left_weight if left_weight is not None else F.lit(1)).alias("n"))
    nr = right.groupBy(on).agg(F.sum(right_weight if right_weight is not None else F.lit(1)).alias("n"))
    both = nl.where(f"n > {chunk}").select(on).union(nr.where(f"n > {chunk}").select(on))
    found = both.distinct().persist()
    hot = written(found, "hot-keys") if found.count() else None
    found.unpersist()
    return hot


def block_pairs(left: DataFrame, right: DataFrame, on: str, left_name: str, right_name: str, *,
                hot: DataFrame | None, chunk: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """``(on, left_name, right_name)``: every pair of values of a key, once.

    ``left`` has rows (on, left_name), ``right`` rows (on, right_name); repeats are allowed.
    ``hot`` is the table of :func:`heavy_keys` (or any other choice of keys: it says where
    products are cut, not what they hold); without any, no product is cut.
    """
    if hot is None:
        # a row a key on either side: never broadcast, whatever few bytes their files have
        return _exploded(_sets(left, [on], left_name, "_l").hint("merge").join(
            _sets(right, [on], right_name, "_r"), on), [on], left_name, right_name)
    spark = left.sparkSession
    many = hot.limit(FEW + 1).count() > FEW
    if many:  # most rows may be hot: made distinct once, not for the ordinary and the hot keys each
        left = written(left.select(on, left_name).distinct(), "block-rows")
        right = written(right.select(on, right_name).distinct(), "block-rows")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def beside(rows: DataFrame) -> DataFrame:
        return rows.hint("merge") if many else rows  # a row a hot key

    hot = beside(hot)
    ordinary = _sets(left.join(hot, on, "left_anti"), [on], left_name, "_l").hint("merge").join(
        _sets(right.join(hot, on, "left_anti"), [on], right_name, "_r"), on)

    def chunked(rows: DataFrame, value: str) -> DataFrame:
        found = rows.join(hot, on, "left_semi").select(on, value)
        distinct = written(found if many else found.distinct(), "hot-rows")
        parts = distinct.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_n"))
        return distinct.join(beside(parts), on).withColumn(
            "_c", F.pmod(F.xxhash64(F.struct(F.col(value))), F.col("_n")).cast("int"))

    lc, rc = chunked(left, left_name), chunked(right, right_name)
    sizes = (lc.select(on, F.col("_n").alias("_nl")).distinct()
             .join(beside(rc.select(on, F.col("_n").alias("_nr")).distinct()), on))
    sizes = beside(written(sizes, "hot-sizes"))

    def blocks(rows: DataFrame, value: str, out: str, own: str, other: str, copies: str) -> DataFrame:
        sets = _sets(rows.withColumnRenamed("_c", own), [on, own], value, out)
        return (sets.join(sizes, on)
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
                .select(on, "_i", "_j", out).repartition(tasks, on, "_i", "_j"))

    cut = beside(blocks(lc, left_name, "_l", "_i", "_j", "_nr")).join(
        blocks(rc, right_name, "_r", "_j", "_i", "_nl"), [on, "_i", "_j"])
    return _exploded(ordinary, [on], left_name, right_name).unionByName(
        _exploded(cut, [on], left_name, right_name))
