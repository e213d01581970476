"""Daily sketches that take late rows (Q5): every micro-batch is committed once, no watermark.

A micro-batch's rows become one sketch per (values, day) under the batch's number; a reading unites the
sketches of all committed batches. So a row that comes after its day was read is united with that
day, however late, and nothing is dropped or held as state. A batch that failed on its way is written again
under its number when the stream resumes; one that is committed is left as it is. ``compact``
unites what is committed in one folder, so that readings stay short.

``kind`` is "theta", "hll" or "registers"; the values may be one column or several. Rows without
a key or a time take no part; null values are groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from overlap.operators.daily import _daily_rows, daily_sketches
from overlap.operators.registers import estimate_registers, merge_registers, register_columns, sketch_spec
from overlap.operators.registers import DEFAULT_LOG2M, DEFAULT_REGWIDTH, DEFAULT_SEED
from overlap.operators.sketch_tree import sketch_merge
from overlap.session import scratch_path
from overlap.sources.commits import CommitLog

KINDS = ("theta", "hll", "registers")


class DailyStore:
    """Daily sketches of one folder, filled batch by batch."""

    def __init__(self, spark: SparkSession, root: str, *, key: str = "user_id",
                 dim: str | list[str] = "event_type", ts: str = "ts", kind: str = "theta",
                 lg_nom: int = 12, lg_config_k: int = 13, blank: str = "drop") -> None:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        self.spark, self.root, self.key, self.ts, self.kind = spark, root.rstrip("/"), key, ts, kind
        self.dims = [dim] if isinstance(dim, str) else list(dim)
        self.lg_nom, self.lg_config_k, self.blank = lg_nom, lg_config_k, blank
        spec = {"theta": f"theta lg={lg_nom}", "hll": f"hll lg={lg_config_k}",
                "registers": sketch_spec(DEFAULT_LOG2M, DEFAULT_REGWIDTH, DEFAULT_SEED)}[kind]
        self.log = CommitLog(spark, f"{self.root}/commits", spec)
        self.merges = CommitLog(spark, f"{self.root}/merges", spec)

    def _sketched(self, rows: DataFrame) -> DataFrame:
        if self.kind == "registers":
            k = _daily_rows(rows, self.key, self.dims, self.ts, self.blank)
            return merge_registers(k.withColumns(register_columns(F.col("_k"))), [*self.dims, "day"])
        return daily_sketches(rows, key=self.key, dim=self.dims, ts=self.ts, kind=self.kind,
                              lg_nom=self.lg_nom, lg_config_k=self.lg_config_k, blank=self.blank)

    def apply(self, batch: int, rows: DataFrame) -> bool:
        """Add the rows of a batch; False where it was committed before."""
        if batch in self.log.numbers():
            return False
        self._sketched(rows).write.mode("overwrite").parquet(f"{self.root}/cells/{batch}")
        self.log.add(batch)
        return True

    def _parts(self) -> list[str]:
        """The last compaction, and the batches after it."""
        last = max(self.merges.numbers(), default=-1)
        parts = [f"{self.root}/merged/{last}"] if last >= 0 else []
        return parts + [f"{self.root}/cells/{n}" for n in self.log.numbers() if n > last]

    def cells(self) -> DataFrame:
        """One row for each (values, day) (for registers: and register), over all committed batches."""
        parts = self._parts()
        if not parts:
            raise ValueError(f"no committed batch under {self.root}")
        stored, groups = self.spark.read.parquet(*parts), [*self.dims, "day"]
        if self.kind == "registers":
            return merge_registers(stored, groups)
        theta = self.kind == "theta"
        merge = (lambda c: F.theta_union_agg(c, self.lg_nom)) if theta else (lambda c: F.hll_union_agg(c, False))
        return sketch_merge(stored, groups, merge, "sketch", "sketch").withColumn(
            "lg", F.lit(self.lg_nom if theta else self.lg_config_k))

    def compact(self) -> None:
        """Unite all committed batches in one folder. Batches are numbered in the order they come."""
        done = self.log.numbers()
        if done and done[-1] not in self.merges.numbers():
            self.cells().write.mode("overwrite").parquet(f"{self.root}/merged/{done[-1]}")
            self.merges.add(done[-1])

    def estimates(self, out: str = "uniques") -> DataFrame:
        """``(values..., day, out bigint)``: distinct keys of each day."""
        if self.kind == "registers":
            return estimate_registers(self.cells(), [*self.dims, "day"], out=out)
        est = F.theta_sketch_estimate if self.kind == "theta" else F.hll_sketch_estimate
        return self.cells().select(*self.dims, "day", est("sketch").cast("bigint").alias(out))


def start_daily_store_stream(store: DailyStore, source: str, schema: T.StructType, *,
                             checkpoint: str | None = None, available_now: bool = True,
                             max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Stream Parquet files of events into ``store``. A store belongs to one checkpoint, whose
    batch numbers it commits."""
    reader = store.spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = (reader.parquet(source).writeStream
              .foreachBatch(lambda rows, batch: store.apply(batch, rows) and None)
              .option("checkpointLocation", checkpoint or scratch_path(store.spark, "late-ckpt")))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
