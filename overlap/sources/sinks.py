"""Sinks and re-reads: Parquet (overwrite/append), partitioned and bucketed layouts, CSV report.

Writers go through AQE's ``rebalance`` exchange rather than a plain ``repartition``: AQE
splits a partition that a hot key makes too large and coalesces small ones, so a bucket
holding a third of the rows is written by several tasks instead of one straggler.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  num_partitions: int | None = None) -> None:
    """Parquet sink; ``num_partitions`` > 0 rebalances into about that many files."""
    if mode not in ("overwrite", "append", "error", "errorifexists", "ignore"):
        raise ValueError(f"unsupported save mode {mode!r}")
    if num_partitions and num_partitions > 0:
        df = df.hint("rebalance", num_partitions)
    df.write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_col: str,
                      num_partitions: int | None = None, mode: str = "overwrite",
                      dynamic: bool = False) -> None:
    """Hive-style ``partition_col=v`` directories.

    Rows are hash-rebalanced on the partition column first, so each task writes few
    directories (no tasks x partitions small files) and a hot value is split by AQE.
    ``dynamic=True`` replaces only the partitions present in ``df`` (re-run of some buckets).
    """
    if num_partitions:
        df = df.hint("rebalance", num_partitions, partition_col)
    else:
        df = df.hint("rebalance", partition_col)
    writer = df.write.mode(mode).partitionBy(partition_col)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """S3: all partitions of a partitioned dataset (partition column restored by discovery)."""
    return spark.read.parquet(path)


def read_bucket(spark: SparkSession, path: str, bucket: int,
                partition_col: str = "bucket_by_pid") -> DataFrame:
    """One partition directory via partition pruning; a missing bucket is empty, not an error."""
    return spark.read.parquet(path).where(F.col(partition_col) == F.lit(bucket))


def write_bucketed_table(df: DataFrame, table: str, num_buckets: int, key: str, path: str,
                         sort: bool = True) -> None:
    """S7 (+L1): external Parquet table bucketed (and sorted) by ``key``.

    ``rebalance(num_buckets, key)`` uses the same murmur3 partitioning as the bucket spec, so
    every bucket is written by one task (one file) unless AQE splits a skewed bucket.
    """
    if num_buckets < 1:
        raise ValueError("num_buckets must be >= 1")
    writer = (df.hint("rebalance", num_buckets, key).write.mode("overwrite").format("parquet")
                .bucketBy(num_buckets, key).option("path", path))
    if sort:
        writer = writer.sortBy(key)
    writer.saveAsTable(table)


def drop_table(spark: SparkSession, table: str) -> None:
    """S8."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def write_report_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, overwrite. ``single_file`` is for small reports only."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """Row count of a written dataset, as a one-row DataFrame ``(n_rows)``."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
