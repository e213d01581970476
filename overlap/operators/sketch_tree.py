"""Sketch aggregation in two fixed levels, for groups that every task contributes to.

A sketch aggregate ``groupBy(g).agg(sketch(x))`` is partially aggregated map-side, but with
one level the reducer of a group merges one partial sketch from *every* task: at 800,000
scan tasks that is 800,000 merges in one place. Every aggregate and every merge of stored
sketches therefore runs in the same two levels at any size and under any session: the first
groups by ``(g, partition id mod FANIN)``, so its reducers merge ``tasks / FANIN`` partials
each, and the second merges at most ``FANIN`` sketches per group. With few tasks the first
level passes its few partials on, which costs one small shuffle.

The partition id is stable across task retries, so the result does not depend on failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANIN = 1024


def sketch_aggregate(df: DataFrame, groups: list[str], build: Column, merge, out: str,
                     fanin: int = FANIN) -> DataFrame:
    """``groupBy(groups).agg(build)`` in two levels.

    ``build`` is the sketch-building aggregate (e.g. ``theta_sketch_agg(x, lg)``) and
    ``merge`` a function column -> union aggregate (e.g. ``theta_union_agg(c, lg)``).
    """
    if fanin < 1:
        raise ValueError("fanin must be >= 1")
    level1 = (df.withColumn("_fanin", F.pmod(F.spark_partition_id(), F.lit(fanin)))
                .groupBy(*groups, "_fanin").agg(build.alias(out)))
    return level1.groupBy(*groups).agg(merge(F.col(out)).alias(out))


def sketch_merge(df: DataFrame, groups: list[str], merge, col: str, out: str,
                 fanin: int = FANIN) -> DataFrame:
    """Union of stored sketches per group, in the same two levels."""
    return sketch_aggregate(df, groups, merge(F.col(col)), merge, out, fanin)
