"""Pair counts through the join: exact (A1) and approximate (A2) distinct keys per (A, B).

Two physical strategies, same answer:

``keysets`` (default)
    Each side is reduced to one row per key holding the key's *distinct* dimension values
    (``collect_set``, partially aggregated map-side, so a hot key with a third of the rows
    collapses before the shuffle; the set is bounded by the dimension's cardinality, not by
    the row count). Both sides come out hash-partitioned on the key, so the join adds no
    Exchange and is one-to-one per key (no join skew). Exploding the two sets yields each
    (key, a, b) exactly once, so the exact distinct count is a plain ``count`` whose partial
    aggregate leaves at most |A|x|B| rows per task for the final shuffle.

``join``
    The textbook plan: join the rows on the key, explode the array late (after the join, so
    the array side ships one row per key) or early, then count distinct keys. The rows of each
    side are made distinct *before* the join (two small shuffles), so the join yields each
    (key, a, b) exactly once and no set of triples is held, shuffled or spilled after it.

``blocks``
    Key sets whose hot keys (more than ``chunk`` values on a side) are cut into chunks, and every
    chunk pair is dealt to a task of its own (see ``blocks``). One more pass counts rows a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlap.operators.blocks import CHUNK, block_pairs, heavy_keys, written
from overlap.schema import key_column, key_predicate

STRATEGIES = ("keysets", "join", "blocks")
EXPLODE = ("late", "early")
PAIRS_PER_TASK = 1 << 20


def _values(df: DataFrame, key: str, dim: str, is_array: bool, name: str,
            blank: str, extra: list[str] | None = None) -> DataFrame:
    """(key, dim value) rows, blank keys dropped; arrays exploded (null/empty -> no rows)."""
    v = F.explode(F.col(dim)) if is_array else F.col(dim)
    return df.where(key_predicate(key, blank)).select(key_column(df, key, blank).alias(key),
                                                      *(extra or []), v.alias(name))


def distinct_set(value: str) -> tuple[Column, Column]:
    """Aggregates giving the distinct values of ``value`` *including* null, which
    ``collect_set`` alone drops: ``(collect_set, saw_null)``; combine with ``with_null``."""
    return F.collect_set(value).alias("_set"), F.max(F.col(value).isNull()).alias("_null")


def with_null(out: str) -> Column:
    """``_set`` plus one null element when ``_null`` -- a null value is its own group."""
    return F.when(F.col("_null"), F.concat(F.col("_set"), F.array(F.lit(None))))\
            .otherwise(F.col("_set")).alias(out)


def key_sets(df: DataFrame, key: str, dim: str, name: str, is_array: bool = False,
             blank: str = "drop", extra: list[str] | None = None) -> DataFrame:
    """``(key, *extra, <name>_set)``: one row per key with its distinct values of ``dim``.

    A null value is kept as its own group, like GROUP BY does.
    """
    extra = extra or []
    rows = _values(df, key, dim, is_array, name, blank, extra)
    return rows.groupBy(key, *extra).agg(*distinct_set(name)).select(key, *extra,
                                                                     with_null(name + "_set"))


def dealt_sets(sets: DataFrame, key: str, left_set: str, right_set: str,
               pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """``sets`` (one row a key, with both its sets), dealt to tasks by the pairs they explode to.

    Spark sizes a stage by the bytes of its sets, which says little about the pairs. A sketch
    aggregate falls back to sorting its input beyond a few groups, so a task with very many
    pairs spills them all. The sets are written once; one aggregate counts their pairs.
    """
    spark = sets.sparkSession
    sets = written(sets, "key-sets")
    pairs = sets.agg(F.sum(F.size(left_set).cast("bigint") * F.size(right_set))).first()[0] or 0
    return sets.repartition(max(spark.sparkContext.defaultParallelism, -(-pairs // pairs_per_task)), key)


def pair_rows(left: DataFrame, right: DataFrame, *, key: str = "pid",
              left_dim: str = "locations", right_dim: str = "interest",
              left_is_array: bool = True, right_is_array: bool = False,
              left_name: str = "location", right_name: str = "interest",
              strategy: str = "keysets", explode: str = "late", blank: str = "drop",
              per_key: dict[str, Column] | None = None,
              partition_by: str | None = None,
              extra: list[str] | None = None, chunk: int = CHUNK, deal: bool = False) -> DataFrame:
    """``(key, left_name, right_name, *per_key)`` rows of the key join.

    Every (key, a, b) occurs exactly once, whatever the strategy. ``per_key`` columns are
    computed once per key (before the explode) from the normalised key column.
    ``partition_by`` (a per-key column) re-partitions the one-row-per-key join output on it
    *before* the explode, so an aggregate grouped by (..., that column) is complete within
    each task and needs no shuffle of the exploded rows (keysets strategy only). ``extra``
    columns of ``right`` are carried along; a key then has one set for each value of them.
    ``deal`` deals the keys to tasks by their pairs (``dealt_sets``; keysets strategy only).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if explode not in EXPLODE:
        raise ValueError(f"explode must be one of {EXPLODE}")
    per_key, carried = per_key or {}, list(extra or [])
    if strategy == "keysets":
        ls = key_sets(left, key, left_dim, left_name, left_is_array, blank)
        rs = key_sets(right, key, right_dim, right_name, right_is_array, blank, carried)
        # a row a key on either side: never broadcast, whatever few bytes their files have
        j = ls.hint("merge").join(rs, key)
        if per_key:
            j = j.withColumns(per_key)
        if partition_by:
            j = j.repartition(partition_by)
        if deal:
            j = dealt_sets(j, key, left_name + "_set", right_name + "_set")
        extra = [*carried, *per_key]
        return (j.select(key, *extra, F.explode(left_name + "_set").alias(left_name),
                         right_name + "_set")
                 .select(key, left_name, F.explode(right_name + "_set").alias(right_name),
                         *extra))
    if strategy == "blocks":
        if partition_by or carried:
            raise ValueError("blocks takes neither partition_by nor extra columns")
        lv, rv = (_values(df, key, dim, is_array, name, blank) for df, dim, is_array, name in (
            (left, left_dim, left_is_array, left_name), (right, right_dim, right_is_array, right_name)))

        def keyed(df, dim, is_array):
            weight = F.greatest(F.size(dim), F.lit(0)) if is_array else F.lit(1)
            return df.where(key_predicate(key, blank)).select(
                key_column(df, key, blank).alias(key), weight.alias("_w"))

        hot = heavy_keys(keyed(left, left_dim, left_is_array), keyed(right, right_dim, right_is_array),
                         key, chunk, F.col("_w"), F.col("_w"))
        rows = block_pairs(lv, rv, key, left_name, right_name, hot=hot, chunk=chunk)
        return rows.withColumns(per_key) if per_key else rows
    # strategy == "join"
    if explode == "early" or not left_is_array:
        lv = _values(left, key, left_dim, left_is_array, left_name, blank).distinct()
        rv = _values(right, key, right_dim, right_is_array, right_name, blank, carried).distinct()
        j = rv.join(lv, key)
        if per_key:
            j = j.withColumns(per_key)
        return j.select(key, left_name, right_name, *carried, *per_key)
    rv = _values(right, key, right_dim, right_is_array, right_name, blank, carried).distinct()
    lrows = left.where(key_predicate(key, blank)).select(
        key_column(left, key, blank).alias(key), F.col(left_dim).alias("_arr"))
    lrows = lrows.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("_arr"))).alias("_arr"))
    j = rv.join(lrows, key)
    if per_key:
        j = j.withColumns(per_key)
    return j.select(key, F.explode("_arr").alias(left_name), right_name, *carried, *per_key)


def pair_counts(left: DataFrame, right: DataFrame, *, key: str = "pid",
                left_dim: str = "locations", right_dim: str = "interest",
                left_is_array: bool = True, right_is_array: bool = False,
                left_name: str = "location", right_name: str = "interest",
                exact: bool = True, rsd: float = 0.05, strategy: str = "keysets",
                explode: str = "late", blank: str = "drop",
                count_col: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Q1/Q2: ``(left_name, right_name, distinct_count | approx_pid_count)`` for co-occurring pairs.

    ``exact=True`` -> exact distinct keys (bigint); ``exact=False`` -> ``approx_count_distinct``
    with relative standard deviation ``rsd``.
    """
    # approx: hash each key once, before the pair explode, instead of once per pair row
    # (the count is a number, not a stored sketch, so the value hashed is free to choose;
    # 64-bit hash collisions are negligible next to the estimator's error)
    per_key = {} if exact else {"_h": F.xxhash64(F.col(key))}
    rows = pair_rows(left, right, key=key, left_dim=left_dim, right_dim=right_dim,
                     left_is_array=left_is_array, right_is_array=right_is_array,
                     left_name=left_name, right_name=right_name, strategy=strategy,
                     explode=explode, blank=blank, per_key=per_key, chunk=chunk)
    if exact:
        name = count_col or "distinct_count"
        agg = F.count(F.lit(1)).alias(name)  # a row is a distinct key of its pair
    else:
        name = count_col or "approx_pid_count"
        agg = F.approx_count_distinct("_h", rsd).alias(name)
    return rows.groupBy(left_name, right_name).agg(agg)
