"""Incremental daily sketches with Structured Streaming (optional extension of Q5).

New event files are folded into one theta and one HLL sketch per (day, value) with an
event-time watermark; a day is emitted (append mode) once the watermark passes its end,
so the sink only ever receives final, mergeable daily sketches -- the input of
``overlap.operators.daily.trailing_uniques``. The state is one sketch pair per open
(day, value); the checkpoint lives in the shared checkpoint folder so a restarted
driver resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from overlap.schema import key_column, key_predicate, sketch_input
from overlap.session import scratch_path


def daily_sketch_stream(spark: SparkSession, source: str, schema: T.StructType, *,
                        key: str = "user_id", dim: str = "event_type", ts: str = "ts",
                        watermark: str = "1 day", lg_nom: int = 12, lg_config_k: int = 13,
                        blank: str = "drop", max_files_per_trigger: int | None = None):
    """Streaming DataFrame ``(dim, day, theta, hll, lg_nom, lg_k)`` of closed days."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source)
    # The watermark needs a TIMESTAMP; day windows align to UTC midnight. Shift the
    # wall-clock event time so that it reads as UTC, whatever the session time zone, so
    # windows are wall-clock days (as ``to_date`` gives in the batch path).
    tz = spark.conf.get("spark.sql.session.timeZone")
    event_time = F.col(ts).cast("timestamp")
    if src.schema[ts].dataType == T.TimestampNTZType():
        event_time = F.from_utc_timestamp(event_time, tz)
    ev = (src.where(key_predicate(key, blank))
             .select(F.col(dim), event_time.alias("_ts"),
                     key_column(src, key, blank).alias("_k"))
             .withWatermark("_ts", watermark))
    v = sketch_input(F.col("_k"), blank)
    agg = ev.groupBy(F.window("_ts", "1 day").alias("w"), F.col(dim)).agg(
        F.theta_sketch_agg(v, lg_nom).alias("theta"),
        F.hll_sketch_agg(v, lg_config_k).alias("hll"))
    day = F.to_date(F.to_utc_timestamp(F.col("w.start"), tz))  # the UTC calendar day
    return agg.select(F.col(dim), day.alias("day"), "theta", "hll",
                      F.lit(lg_nom).alias("lg_nom"), F.lit(lg_config_k).alias("lg_k"))


def start_daily_sketch_stream(spark: SparkSession, source: str, schema: T.StructType,
                              sink: str, *, checkpoint: str | None = None,
                              available_now: bool = True, **kwargs) -> StreamingQuery:
    """Run ``daily_sketch_stream`` into a Parquet sink (append; exactly-once via checkpoint)."""
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    out = daily_sketch_stream(spark, source, schema, **kwargs)
    writer = (out.writeStream.outputMode("append").format("parquet")
              .option("path", sink).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
