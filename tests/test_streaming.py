"""Streaming daily sketches: closed days equal the batch daily sketches."""

from conftest import SF001
from pyspark.sql import functions as F

from overlap.operators.daily import daily_sketches
from overlap.streaming.daily import start_daily_sketch_stream


def test_stream_emits_closed_days_equal_to_batch(spark, tmp_path):
    src = f"{SF001}/events.parquet"
    schema = spark.read.parquet(src).schema
    sink = str(tmp_path / "sink")
    q = start_daily_sketch_stream(spark, f"{SF001}/events*.parquet", schema, sink,
                                  checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = {(r.event_type, r.day): r.n for r in spark.read.parquet(sink).select(
        "event_type", "day", F.theta_sketch_estimate("theta").alias("n")).collect()}
    batch = {(r.event_type, r.day): r.n for r in daily_sketches(
        spark.read.parquet(src)).select("event_type", "day",
                                        F.theta_sketch_estimate("sketch").alias("n")).collect()}
    assert got and set(got) < set(batch)            # the last (open) days are held back
    assert all(batch[k] == v for k, v in got.items())
    last_closed = max(d for _, d in got)
    assert all(d > last_closed for (_, d) in set(batch) - set(got))


def test_stream_resumes_from_checkpoint_without_duplicates(spark, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = tmp_path / "src"
    first = ev.where(F.dayofmonth("ts") <= 15)
    second = ev.where(F.dayofmonth("ts") > 15)
    first.write.parquet(str(src / "part1"))
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    glob_path = str(src / "*")
    start_daily_sketch_stream(spark, glob_path, ev.schema, sink, checkpoint=ckpt).awaitTermination()
    n1 = spark.read.parquet(sink).count()
    second.write.parquet(str(src / "part2"))   # new data arrives; the driver restarts
    start_daily_sketch_stream(spark, glob_path, ev.schema, sink, checkpoint=ckpt).awaitTermination()
    out = spark.read.parquet(sink)
    keys = [(r.event_type, r.day) for r in out.select("event_type", "day").collect()]
    assert len(keys) == len(set(keys)) > n1           # each closed day emitted exactly once
    batch = {(r.event_type, r.day): r.n for r in daily_sketches(ev).select(
        "event_type", "day", F.theta_sketch_estimate("sketch").alias("n")).collect()}
    got = {(r.event_type, r.day): r.n for r in out.select(
        "event_type", "day", F.theta_sketch_estimate("theta").alias("n")).collect()}
    assert all(batch[k] == v for k, v in got.items())
