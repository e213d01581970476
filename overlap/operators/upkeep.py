"""Daily pair sketches kept up to date from new rows of either input (A12, delta join).

``left`` rows are (key, a), ``right`` rows (key, b, day). A batch brings new rows of one or both. The
pairs it adds are ``new left x all right`` and ``old left x new right``; only they are joined, and
their sketches per (a, b, day) are stored beside those of earlier batches. Sketches are idempotent
under repeated rows, so a row that comes again changes nothing.

Layout under ``root``: ``left``, ``right``, ``cells`` and ``commits``, one folder a batch in each. A batch is
written in that order and counts once its commit is there: reading takes committed batches alone.
A batch that failed on its way is applied again under its number and replaces what it left; one that is
committed is left as it is. Batches are applied one after the other, in the order of their numbers.

``kind`` is "theta" or "registers"; its parameters are stored with the commit, and others raise.
Null values are groups; rows without a key or a day take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.operators.registers import (DEFAULT_LOG2M, DEFAULT_REGWIDTH, DEFAULT_SEED,
                                          estimate_registers, merge_registers, register_columns,
                                          sketch_spec)
from overlap.operators.sketch_tree import sketch_aggregate, sketch_merge
from overlap.schema import key_column, key_predicate, sketch_input
from overlap.sources.commits import CommitLog

KINDS = ("theta", "registers")


class PairSketches:
    """Stored daily pair sketches of one folder."""

    def __init__(self, spark: SparkSession, root: str, *, key: str = "pid", left_name: str = "location",
                 right_name: str = "interest", kind: str = "theta", lg_nom: int = 12,
                 log2m: int = DEFAULT_LOG2M, regwidth: int = DEFAULT_REGWIDTH, seed: int = DEFAULT_SEED,
                 blank: str = "drop") -> None:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        self.spark, self.root, self.key, self.blank = spark, root.rstrip("/"), key, blank
        self.left_name, self.right_name, self.kind, self.lg_nom = left_name, right_name, kind, lg_nom
        self.registers = {"log2m": log2m, "regwidth": regwidth, "seed": seed}
        self.groups = [left_name, right_name, "day"]
        self.spec = f"theta lg={lg_nom}" if kind == "theta" else sketch_spec(**self.registers)
        self.log = CommitLog(spark, f"{self.root}/commits", self.spec)

    def _read(self, part: str, batches: list[int], schema) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{part}/{n}" for n in batches])

    def _rows(self, df: DataFrame, *cols: str) -> DataFrame:
        k = key_column(df, self.key, self.blank).alias(self.key)
        return df.where(key_predicate(self.key, self.blank)).select(k, *cols).distinct()

    def apply(self, batch: int, new_left: DataFrame, new_right: DataFrame) -> bool:
        """Add a batch; False where it was committed before."""
        done = self.log.numbers()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        left = self._rows(new_left, self.left_name)
        right = self._rows(new_right.where(F.col("day").isNotNull()), self.right_name, "day")
        left.write.mode("overwrite").parquet(f"{self.root}/left/{batch}")
        right.write.mode("overwrite").parquet(f"{self.root}/right/{batch}")
        one, two = (self._read(p, [batch], df.schema) for p, df in (("left", left), ("right", right)))
        old_left = self._read("left", done, left.schema)
        all_right = self._read("right", [*done, batch], right.schema)
        delta = one.join(all_right, self.key).unionByName(old_left.join(two, self.key))
        self._sketched(delta).write.mode("overwrite").parquet(f"{self.root}/cells/{batch}")
        self.log.add(batch)
        return True

    def _sketched(self, pairs: DataFrame) -> DataFrame:
        if self.kind == "theta":
            return sketch_aggregate(pairs, self.groups, F.theta_sketch_agg(
                sketch_input(F.col(self.key), self.blank), self.lg_nom),
                lambda c: F.theta_union_agg(c, self.lg_nom), "sketch")
        cols = register_columns(F.col(self.key), **self.registers)
        return merge_registers(pairs.withColumns(cols), self.groups)

    def cells(self) -> DataFrame:
        """The daily pair sketches of all committed batches, merged."""
        done = self.log.numbers()
        if not done:
            raise ValueError(f"no committed batch under {self.root}")
        stored = self.spark.read.parquet(*[f"{self.root}/cells/{n}" for n in done])
        if self.kind == "theta":
            return sketch_merge(stored, self.groups, lambda c: F.theta_union_agg(c, self.lg_nom),
                                "sketch", "sketch").withColumn("lg", F.lit(self.lg_nom))
        return merge_registers(stored, self.groups)

    def estimates(self, out: str = "uniques") -> DataFrame:
        """``(a, b, day, out bigint)``: distinct keys of each pair and day."""
        if self.kind == "theta":
            return self.cells().select(*self.groups, F.theta_sketch_estimate("sketch").cast("bigint").alias(out))
        return estimate_registers(self.cells(), self.groups, log2m=self.registers["log2m"], out=out)
