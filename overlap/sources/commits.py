"""A log of committed batches: a folder with one small file a batch, written after its data.

Writing a batch's data and then its commit makes a batch count as a whole or not at all: readers take
committed batches alone, and a batch that failed on its way is written again under its number. The
parameters of what is stored (``spec``) are kept with each commit; others raise.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class CommitLog:
    def __init__(self, spark: SparkSession, path: str, spec: str) -> None:
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec

    def numbers(self) -> list[int]:
        """Committed batches in order; one small row each."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        rows = self.spark.read.schema("n long, spec string").json(f"{self.path}/*").collect()
        for r in rows:
            if r["spec"] != self.spec:
                raise ValueError(f"stored with {r['spec']}, not {self.spec}")
        return sorted(r["n"] for r in rows)

    def add(self, n: int) -> None:
        """Commit batch ``n``, in one file: it counts from here on."""
        (self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(self.spec).alias("spec"))
         .coalesce(1).write.mode("overwrite").json(f"{self.path}/{n}"))
