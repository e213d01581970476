"""Accuracy of an approximate pair result against the exact one (Q6: J2, P5-P8, A10, S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlap.functions.metrics import percent_difference, relative_error
from overlap.sources.sinks import write_report_csv

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def pick_count_column(df: DataFrame, explicit: str | None = None) -> str:
    """The count column -- ``explicit`` if given, else the first *numeric* column whose
    lower-cased name contains "count" (a string dimension such as ``country`` is skipped)."""
    if explicit:
        if explicit not in df.columns:
            raise ValueError(f"no column {explicit!r}")
        return explicit
    for f in df.schema.fields:
        if "count" in f.name.lower() and isinstance(f.dataType, _NUMERIC):
            return f.name
    raise ValueError(f"no numeric count column among {df.columns}")


def sketch_counts(df: DataFrame, sketch_col: str = "hll_bytes", out: str = "count") -> DataFrame:
    """HLL sketch column -> its estimate (bigint), sketch dropped."""
    return df.withColumn(out, F.hll_sketch_estimate(F.col(sketch_col))).drop(sketch_col)


def compare_counts(a: DataFrame, b: DataFrame, *, dims: tuple[str, ...] = ("location", "interest"),
                   count_a: str | None = None, count_b: str | None = None,
                   how: str = "inner") -> DataFrame:
    """Side-by-side ``(<dim>1..., count_1, <dim>2..., count_2, percent_difference,
    relative_error)``. ``how="full"`` also shows pairs present on one side only (the inner
    join would hide them); their missing count is 0.
    """
    if how not in ("inner", "full", "left", "right"):
        raise ValueError("how must be inner, full, left or right")
    ca, cb = pick_count_column(a, count_a), pick_count_column(b, count_b)
    left = a.select(*[F.col(d).alias(f"{d}1") for d in dims], F.col(ca).alias("count_1"))
    right = b.select(*[F.col(d).alias(f"{d}2") for d in dims], F.col(cb).alias("count_2"))
    cond = [left[f"{d}1"].eqNullSafe(right[f"{d}2"]) for d in dims]
    j = left.join(right, cond, how)
    if how != "inner":
        j = j.withColumns({"count_1": F.coalesce("count_1", F.lit(0)),
                           "count_2": F.coalesce("count_2", F.lit(0))})
    return j.withColumns({"percent_difference": percent_difference("count_1", "count_2"),
                          "relative_error": relative_error("count_1", "count_2")})


def error_stats(cmp: DataFrame, col: str = "percent_difference") -> DataFrame:
    """A10: one row ``(min_, max_, avg_percent_difference, pairs)`` -- stays a DataFrame."""
    return cmp.agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"),
                   F.avg(col).alias(f"avg_{col}"), F.count(F.lit(1)).alias("pairs"))


def write_report(cmp: DataFrame, path: str, single_file: bool = False) -> None:
    """The comparison as CSV with a header."""
    write_report_csv(cmp, path, single_file=single_file)
