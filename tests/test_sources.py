"""Sources and sinks: Parquet overwrite/append, partitioned write + bucket slice reads,
bucketed tables + drop, CSV report, row counts of what was written."""

import csv
import glob

from pyspark.sql import functions as F

from overlap.functions.keys import bucket_of
from overlap.operators.accuracy import compare_counts, error_stats, write_report
from overlap.operators.buckets import BUCKET_COL, with_bucket
from overlap.sources import (count_rows, drop_table, read_bucket, read_partitioned,
                             write_bucketed_table, write_parquet, write_partitioned)


def test_parquet_overwrite_append_and_count(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("pid"))
    p = str(tmp_path / "people")
    write_parquet(df, p, num_partitions=4)
    write_parquet(df, p, mode="append")
    assert count_rows(spark, p).first().n_rows == 200
    write_parquet(df, p)  # overwrite
    assert count_rows(spark, p).first().n_rows == 100


def test_partitioned_write_and_bucket_slices(spark, tmp_path):
    df = with_bucket(spark.range(1000).select(F.col("id").cast("string").alias("pid")), "pid", 10)
    p = str(tmp_path / "buckets")
    write_partitioned(df, p, BUCKET_COL)
    back = read_partitioned(spark, p)
    assert back.count() == 1000
    slices = [read_bucket(spark, p, b).count() for b in range(10)]
    assert sum(slices) == 1000
    assert read_bucket(spark, p, 99).count() == 0  # missing bucket: empty, not an error
    plan = read_bucket(spark, p, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_by_pid" in plan
    # every row sits in the bucket its key hashes to
    bad = back.where(bucket_of("pid", 10) != F.col(BUCKET_COL)).count()
    assert bad == 0


def test_partitioned_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    p = str(tmp_path / "staging")
    df = spark.createDataFrame([(0, "a"), (1, "b")], f"{BUCKET_COL} int, v string")
    write_partitioned(df, p, BUCKET_COL)
    write_partitioned(spark.createDataFrame([(1, "c")], f"{BUCKET_COL} int, v string"), p,
                      BUCKET_COL, dynamic=True)
    got = sorted((r[BUCKET_COL], r.v) for r in spark.read.parquet(p).collect())
    assert got == [(0, "a"), (1, "c")]


def test_bucketed_table_roundtrip_and_drop(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("pid"))
    write_bucketed_table(df, "t_bucketed_test", 4, "pid", str(tmp_path / "tb"))
    t = spark.table("t_bucketed_test")
    assert t.count() == 50
    desc = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED t_bucketed_test").collect()}
    assert desc.get("Num Buckets") == "4"
    drop_table(spark, "t_bucketed_test")
    drop_table(spark, "t_bucketed_test")  # idempotent
    assert "t_bucketed_test" not in [x.name for x in spark.catalog.listTables()]


def test_csv_report(spark, tmp_path):
    a = spark.createDataFrame([("P", "I", 9)], "location string, interest string, approx_count long")
    b = spark.createDataFrame([("P", "I", 10)], "location string, interest string, distinct_count long")
    cmp = compare_counts(a, b)
    p = str(tmp_path / "report")
    write_report(cmp, p, single_file=True)
    files = glob.glob(f"{p}/part-*.csv")
    assert len(files) == 1
    rows = list(csv.DictReader(open(files[0])))
    assert rows[0]["location1"] == "P" and rows[0]["count_2"] == "10"
    s = error_stats(cmp).first()
    assert round(s.max_percent_difference, 6) == round(1 / 9.5 * 100, 6)
