"""Sketch column functions over Spark's built-in theta and HLL sketches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def theta_estimate(sketch) -> Column:
    """theta estimate as double (Spark returns it rounded to bigint)."""
    return F.theta_sketch_estimate(_c(sketch)).cast("double")


def theta_intersect(a, b) -> Column:
    """Intersection of two theta sketches (null in -> null out)."""
    return F.theta_intersection(_c(a), _c(b))


def theta_merge(a, b, lg_nom: int = 12) -> Column:
    """Union of two theta sketches."""
    return F.theta_union(_c(a), _c(b), lg_nom)


def hll_estimate(sketch) -> Column:
    """HLL estimate, bigint (Spark rounds the library's double)."""
    return F.hll_sketch_estimate(_c(sketch))


def hll_merge(a, b, allow_different_lg_k: bool = False) -> Column:
    """Union of two HLL sketches; different lgK raises unless allowed."""
    return F.hll_union(_c(a), _c(b), allow_different_lg_k)


def empty_hll_bytes(spark, lg_config_k: int = 13) -> bytes:
    """The serialized HLL sketch of zero keys (a fixed, 40-byte constant for any data).

    Built by Spark itself (``hll_sketch_agg`` over an empty input), so it always matches
    the sketch format of the running version; estimate 0.
    """
    return (spark.range(0).select(F.col("id").cast("string").alias("k"))
            .agg(F.hll_sketch_agg("k", lg_config_k).alias("h")).first().h)


def empty_hll(sketch, empty: Column | None = None) -> Column:
    """``coalesce(sketch, empty)``; ``empty`` is a literal sketch of zero keys.

    ``hll_union_agg`` over only-null input already estimates 0, so missing cells can also
    stay null and be merged as they are.
    """
    return F.coalesce(_c(sketch), empty) if empty is not None else _c(sketch)
