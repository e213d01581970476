"""Join-free pair counts by theta-sketch intersection (Q3: A3, A4, A5, J3, E1, F1).

One theta sketch per dimension value is built straight from each input with the built-in
``theta_sketch_agg`` (partial aggregate map-side, then only small sketches are shuffled;
the raw rows never meet each other). Pairs are then answered by intersecting the sketch of
``a`` with the sketch of ``b``.

The pair grid |A| x |B| is the requested output (the reference's set-intersection path
reports every pair, 0 included), so it is formed from the two *sketch tables* -- one row per
dimension value, never per key or per input row. No broadcast hint is given: AQE re-plans
the grid join once the two sketch tables are materialised and broadcasts one only when its
measured size is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``; above that the
grid is a partitioned nested-loop product. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.functions.sketches import theta_estimate
from overlap.operators.pairs import _values
from overlap.operators.sketch_tree import FANIN, sketch_aggregate, sketch_merge
from overlap.schema import lg_nominal, sketch_input


GRID_TASKS = 64


def theta_sets(df: DataFrame, *, key: str = "pid", dim: str = "interest",
               name: str | None = None, is_array: bool = False, lg_nom: int = 12,
               blank: str = "drop", sketch_col: str = "sketch",
               fanin: int = FANIN) -> DataFrame:
    """A3/A4: ``(name, sketch)`` -- one theta sketch of the keys per value of ``dim``.

    The per-task partial sketches are merged in two levels (see sketch_tree).
    """
    name = name or dim
    rows = _values(df, key, dim, is_array, name, blank)
    return sketch_aggregate(rows, [name],
                            F.theta_sketch_agg(sketch_input(F.col(key), blank), lg_nom),
                            lambda c: F.theta_union_agg(c, lg_nom), sketch_col, fanin)


def merge_theta_sets(df: DataFrame, *, dim: str, sketch_col: str = "sketch",
                     lg_nom: int = 12, out_col: str = "sketch") -> DataFrame:
    """A5: union of stored partial sketches per dimension value (incremental re-merge).

    Sketches stored with their parameter (a column ``lg``) must all have ``lg_nom``.
    """
    if "lg" in df.columns:
        df = check_parameter(df, sketch_col, "lg", lg_nom)
    return sketch_merge(df, [dim], lambda c: F.theta_union_agg(c, lg_nom), sketch_col, out_col)


def check_parameter(df: DataFrame, sketch_col: str, param_col: str, expected: int) -> DataFrame:
    """``df`` whose rows raise where the stored sketch parameter is not the expected one."""
    ok = F.col(param_col).isNull() | (F.col(param_col) == F.lit(expected))
    message = F.concat(F.lit(f"sketches built with {param_col} = "), F.col(param_col).cast("string"),
                       F.lit(f" cannot be merged with {param_col} = {expected}"))
    return df.withColumn(sketch_col, F.when(ok, F.col(sketch_col)).otherwise(
        F.raise_error(message).cast("binary")))


def theta_pair_counts(left_sets: DataFrame, right_sets: DataFrame, *,
                      left_name: str = "location", right_name: str = "interest",
                      sketch_col: str = "sketch", include_zero_pairs: bool = True,
                      count_col: str = "set_intersection_count") -> DataFrame:
    """``(left_name, right_name, set_intersection_count double)`` for the pair grid."""
    # one side is spread by value: else the tasks of the grid would follow the sketches' bytes
    # and not the number of intersections
    ls = left_sets.select(F.col(left_name), F.col(sketch_col).alias("_ls")).repartition(
        GRID_TASKS, left_name)
    rs = right_sets.select(F.col(right_name), F.col(sketch_col).alias("_rs"))
    grid = ls.crossJoin(rs)
    out = grid.select(left_name, right_name,
                      theta_estimate(F.theta_intersection("_ls", "_rs")).alias(count_col))
    if not include_zero_pairs:
        out = out.where(F.col(count_col) > F.lit(0.0))
    return out


def theta_pairs(left: DataFrame, right: DataFrame, *, key: str = "pid",
                left_dim: str = "locations", right_dim: str = "interest",
                left_is_array: bool = True, right_is_array: bool = False,
                left_name: str = "location", right_name: str = "interest",
                nominal_entries: int = 4096, include_zero_pairs: bool = True,
                blank: str = "drop", fanin: int = FANIN) -> DataFrame:
    """Q3 end to end from the two inputs."""
    lg = lg_nominal(nominal_entries)
    ls = theta_sets(left, key=key, dim=left_dim, name=left_name, is_array=left_is_array,
                    lg_nom=lg, blank=blank, fanin=fanin)
    rs = theta_sets(right, key=key, dim=right_dim, name=right_name, is_array=right_is_array,
                    lg_nom=lg, blank=blank, fanin=fanin)
    return theta_pair_counts(ls, rs, left_name=left_name, right_name=right_name,
                             include_zero_pairs=include_zero_pairs)
