"""Pair HLL sketches with Spark's built-in HLL (Q4: A6, A7, E3, F2, P7, A13).

The result is mergeable bytes per pair rather than a number, so later jobs can union
buckets or days without touching the raw rows again. Estimates of the built-in sketch
depend on merge order (aggregation layout), so they are compared with the exact count
within a tolerance, never for equality between plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.operators.pairs import pair_rows
from overlap.operators.sketch_tree import FANIN, sketch_aggregate, sketch_merge
from overlap.schema import sketch_input

DEFAULT_LG_K = 13


def _check_lg_k(lg_k: int) -> None:
    if not 4 <= lg_k <= 21:
        raise ValueError("lg_config_k must be in [4, 21]")


def hll_sets(df: DataFrame, groups: list[str], key: str = "pid", *,
             lg_config_k: int = DEFAULT_LG_K, blank: str = "drop",
             out: str = "hll_bytes", fanin: int = FANIN) -> DataFrame:
    """``(groups..., hll_bytes)`` -- one HLL sketch of ``key`` per group."""
    from overlap.schema import key_column, key_predicate

    _check_lg_k(lg_config_k)
    k = key_column(df, key, blank)
    return sketch_aggregate(df.where(key_predicate(key, blank)), groups,
                            F.hll_sketch_agg(sketch_input(k, blank), lg_config_k),
                            lambda c: F.hll_union_agg(c, False), out, fanin)


def hll_pairs(left: DataFrame, right: DataFrame, *, key: str = "pid",
              left_dim: str = "locations", right_dim: str = "interest",
              left_is_array: bool = True, right_is_array: bool = False,
              left_name: str = "location", right_name: str = "interest",
              lg_config_k: int = DEFAULT_LG_K, blank: str = "drop",
              strategy: str = "keysets", explode: str = "late",
              extra_groups: list[str] | None = None, fanin: int = FANIN) -> DataFrame:
    """Q4: ``(left_name, right_name, hll_bytes)`` for every co-occurring pair.

    ``extra_groups`` are columns of ``right`` (e.g. the day an interest was seen): one
    sketch per pair and value of them.
    """
    _check_lg_k(lg_config_k)
    extra = list(extra_groups or [])
    rows = pair_rows(left, right, key=key, left_dim=left_dim, right_dim=right_dim,
                     left_is_array=left_is_array, right_is_array=right_is_array,
                     left_name=left_name, right_name=right_name, strategy=strategy,
                     explode=explode, blank=blank, extra=extra, deal=strategy == "keysets")
    return sketch_aggregate(rows, [*extra, left_name, right_name],
                            F.hll_sketch_agg(sketch_input(F.col(key), blank), lg_config_k),
                            lambda c: F.hll_union_agg(c, False), "hll_bytes", fanin)


def merge_hll(df: DataFrame, groups: list[str], col: str = "hll_bytes", *,
              allow_different_lg_k: bool = False, out: str = "hll_bytes") -> DataFrame:
    """Union of stored HLL sketches per group (null cells are empty sketches)."""
    return sketch_merge(df, groups, lambda c: F.hll_union_agg(c, allow_different_lg_k), col, out)


def estimate_hll(df: DataFrame, col: str = "hll_bytes", out: str = "count",
                 as_double: bool = False) -> DataFrame:
    """Replace the sketch column by its estimate (bigint, or double if asked)."""
    est = F.hll_sketch_estimate(F.col(col))
    if as_double:
        est = est.cast("double")
    return df.withColumn(out, est).drop(col)
