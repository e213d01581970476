"""Bucket plan from sizes (S6, A11): buckets of about equal bytes, hot ranges cut.

Key hashes fall into ``CELLS`` cells; one aggregate weighs the distinct (key, value) rows of both
sides in each. Consecutive cells are packed into buckets of about ``total / buckets`` bytes. A cell
above that (a hot key) is cut: left rows into ``l`` parts and right rows into ``r``, by a hash of the
value, and its ``l x r`` buckets hold one part of each side. A (key, a, b) triple still meets in
exactly one bucket, so counts of buckets add up.

The driver holds the plan: two sums a cell, whatever the tables' size. Rows without a key take no
part; null values are values; empty tables give a plan of no bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.operators.pairs import _values
from overlap.sources.sinks import write_partitioned

CELLS = 4096
BUCKET = "bucket"
ROW_BYTES = 8


def pack(weights: dict[int, tuple[int, int]], buckets: int) -> dict[int, tuple[int, int, int]]:
    """cell -> (first bucket, left parts, right parts) from cell -> (left bytes, right bytes)."""
    if buckets < 1:
        raise ValueError("buckets must be >= 1")
    target = sum(l + r for l, r in weights.values()) / buckets
    plan, bucket, held = {}, 0, 0
    for cell in range(CELLS):
        left, right = weights.get(cell, (0, 0))
        if left + right <= target:
            if held and held + left + right > 1.25 * target:
                bucket, held = bucket + 1, 0
            plan[cell] = (bucket, 1, 1)
            held += left + right
            continue
        if held:
            bucket, held = bucket + 1, 0
        l = r = 1
        while left / l + right / r > target:  # cut the side whose parts are larger
            l, r = (l + 1, r) if left / l >= right / r else (l, r + 1)
        plan[cell] = (bucket, l, r)
        bucket += l * r
    return plan


@dataclass(frozen=True)
class BucketPlan:
    cells: dict[int, tuple[int, int, int]]

    def assign(self, rows: DataFrame, key: str, value: str, side: str) -> DataFrame:
        """``rows`` with their bucket; rows of a cut cell meet every part of the other side."""
        table = rows.sparkSession.createDataFrame(
            [(c, *p) for c, p in self.cells.items()], "_cell int, _first int, _l int, _r int")
        part = lambda n: F.pmod(F.xxhash64(F.lit(17), value), n).cast("int")
        other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        met = rows.withColumn("_cell", _cell(key)).join(F.broadcast(table), "_cell")  # CELLS rows
        met = (met.withColumn("_i", part("_l")).withColumn("_j", other("_r")) if side == "left"
               else met.withColumn("_j", part("_r")).withColumn("_i", other("_l")))
        return met.withColumn(BUCKET, F.col("_first") + F.col("_i") * F.col("_r") + F.col("_j")).select(
            *rows.columns, BUCKET)


def _cell(key: str):
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def plan_buckets(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str,
                 buckets: int) -> BucketPlan:
    """The plan for two tables of distinct (key, value) rows."""
    def sizes(df, value, side):
        size = F.octet_length(key) + F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0))
        return df.select(_cell(key).alias("cell"), F.lit(side).alias("side"),
                         (size + ROW_BYTES).cast("long").alias("bytes"))

    sums = (sizes(left, left_value, 0).unionByName(sizes(right, right_value, 1))
            .groupBy("cell", "side").agg(F.sum("bytes").alias("bytes")).collect())  # 2 x CELLS rows
    weights: dict[int, list[int]] = {}
    for r in sums:
        weights.setdefault(r["cell"], [0, 0])[r["side"]] = r["bytes"]
    return BucketPlan(pack({c: (l, r) for c, (l, r) in weights.items()}, buckets))


def write_planned(spark: SparkSession, left: DataFrame, right: DataFrame, buckets: int, root: str, *,
                  key: str = "pid", left_dim: str = "locations", right_dim: str = "interest",
                  left_is_array: bool = True, right_is_array: bool = False,
                  left_name: str = "location", right_name: str = "interest",
                  blank: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Both inputs as distinct ``(bucket, key, value)`` rows, written under ``root`` partitioned by the
    planned bucket, and read back."""
    sides = ((left, left_dim, left_is_array, left_name, "left"),
             (right, right_dim, right_is_array, right_name, "right"))
    staged = []
    for df, dim, is_array, name, tag in sides:
        path = f"{root}/{tag}-rows"  # deduplicated once; the plan and the buckets read it
        rows = _values(df, key, dim, is_array, name, blank).distinct()
        rows.write.mode("overwrite").parquet(path)
        staged.append(spark.read.schema(rows.schema).parquet(path))
    plan = plan_buckets(*staged, key, left_name, right_name, buckets)
    out = []
    for rows, (_, _, _, name, tag) in zip(staged, sides):
        planned = plan.assign(rows, key, name, tag)
        write_partitioned(planned, f"{root}/{tag}", BUCKET)
        # the schema is given: an empty table has no files to tell it
        out.append(spark.read.schema(planned.schema).parquet(f"{root}/{tag}"))
    return out[0], out[1]


def planned_pairs(spark: SparkSession, left: DataFrame, right: DataFrame, buckets: int, root: str, *,
                  key: str = "pid", left_name: str = "location", right_name: str = "interest",
                  **inputs) -> DataFrame:
    """``(left_name, right_name, distinct_count)``: exact, by way of planned buckets under ``root``."""
    one, two = write_planned(spark, left, right, buckets, root, key=key, left_name=left_name,
                             right_name=right_name, **inputs)
    return (one.join(two, [BUCKET, key]).groupBy(left_name, right_name)
            .agg(F.count(F.lit(1)).alias("distinct_count")))
