"""Bucketed pair counting.

Buckets split the key space (``pmod(hash(key), n)``), so every key's rows sit in exactly
one bucket and per-bucket results combine without overlap: exact counts add up, sketches
union. Three forms:

* ``bucketed_pairs`` -- one job; the bucket id is just an extra grouping column of the
  per-pair aggregate, merged afterwards. Spark's shuffle already does the partitioning the
  reference did by hand, and any failure fails the query (no silent lost bucket).
* ``two_phase_pairs`` -- the physical layout: both inputs written partitioned by bucket
  (S6), per-bucket partial results written to a staging folder, then merged (A11). Each run
  stages under its own id; a manifest says which run holds which bucket and with which
  parameters. ``buckets=`` re-runs selected buckets only (partition pruning, S2): they count
  as replaced even where they came out empty, and other parameters raise.
* ``bucket_by_pairs`` -- catalog tables bucketed and sorted by the key (S7); the key
  sets and the join read them with no Exchange (J4). The tables are dropped from the catalog
  once the plan is made (S8); their files stay for it.

Scratch data lives under the shared checkpoint folder, in fresh per-run folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.functions.keys import bucket_of
from overlap.operators.sketch_tree import sketch_aggregate, sketch_merge
from overlap.operators.pairs import dealt_sets, distinct_set, key_sets, with_null
from overlap.operators.registers import (DEFAULT_LOG2M, DEFAULT_REGWIDTH, DEFAULT_SEED,
                                          merge_registers, register_columns, sketch_spec)
from overlap.schema import key_column, key_predicate, sketch_input
from overlap.session import scratch_path
from overlap.sources.sinks import drop_table, write_bucketed_table, write_partitioned

BUCKET_COL = "bucket_by_pid"
MODES = ("exact", "hll", "registers")


def with_bucket(df: DataFrame, key: str, num_buckets: int, col: str = BUCKET_COL) -> DataFrame:
    """Add the bucket id column."""
    return df.withColumn(col, bucket_of(key, num_buckets))


def _hll_union(c):
    return F.hll_union_agg(c, False)


def _per_key(mode: str, key: str, log2m: int, regwidth: int, seed: int) -> dict:
    """What a partial needs of a key; computed once per key, before the pairs are exploded."""
    if mode != "registers":
        return {}
    return register_columns(F.col(key), log2m=log2m, regwidth=regwidth, seed=seed)


def _partial(rows: DataFrame, groups: list[str], key: str, mode: str, lg_config_k: int,
             blank: str) -> DataFrame:
    """Per-group partial result of already deduplicated (key, a, b) rows."""
    if mode == "exact":
        return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("distinct_count"))
    if mode == "hll":
        return sketch_aggregate(rows, groups, F.hll_sketch_agg(
            sketch_input(F.col(key), blank), lg_config_k), _hll_union, "hll_bytes")
    return merge_registers(rows, groups)


def _merge(partials: DataFrame, groups: list[str], mode: str) -> DataFrame:
    """Combine per-bucket partials: counts add, sketches union, registers take the max."""
    if mode == "exact":
        return partials.groupBy(*groups).agg(F.sum("distinct_count").cast("bigint")
                                             .alias("distinct_count"))
    if mode == "hll":
        return sketch_merge(partials, groups, _hll_union, "hll_bytes", "hll_bytes")
    return merge_registers(partials, groups)


def _explode_sets(ls: DataFrame, rs: DataFrame, key: str, left_name: str, right_name: str,
                  on: list[str], per_key: dict, mode: str) -> DataFrame:
    """(on..., key, a, b, per_key...) rows; ``per_key`` columns are made before the explode.

    Keys are dealt to tasks before it too: for registers by the register, so a task holds its
    share of the (bucket, a, b, reg) groups and no other has any of them; for HLL by pairs.
    """
    j = ls.hint("merge").join(rs, [*on, key]).withColumns(per_key)  # a row a key: never broadcast
    if mode == "registers":
        # a set number: by the bytes of the sets, few tasks would do and hold all the groups
        j = j.repartition(int(j.sparkSession.conf.get("spark.sql.shuffle.partitions")), "reg")
    elif mode == "hll":
        j = dealt_sets(j, key, left_name + "_set", right_name + "_set")
    carry = [*on, *per_key]
    return (j.select(*carry, key, F.explode(left_name + "_set").alias(left_name),
                     right_name + "_set")
             .select(*carry, key, left_name, F.explode(right_name + "_set").alias(right_name)))


def _check(mode: str, num_buckets: int) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if num_buckets < 1:
        raise ValueError("num_buckets must be >= 1")


def bucketed_pairs(left: DataFrame, right: DataFrame, num_buckets: int, *, key: str = "pid",
                   left_dim: str = "locations", right_dim: str = "interest",
                   left_is_array: bool = True, right_is_array: bool = False,
                   left_name: str = "location", right_name: str = "interest",
                   mode: str = "exact", lg_config_k: int = 13, log2m: int = DEFAULT_LOG2M,
                   regwidth: int = DEFAULT_REGWIDTH, seed: int = DEFAULT_SEED,
                   blank: str = "drop", keep_buckets: bool = False) -> DataFrame:
    """J5/A11 as one job: per-(bucket, a, b) partials, merged over buckets.

    ``keep_buckets=True`` returns the per-bucket partials (with the bucket column) instead.
    """
    _check(mode, num_buckets)
    ls = key_sets(left, key, left_dim, left_name, left_is_array, blank)
    rs = key_sets(right, key, right_dim, right_name, right_is_array, blank)
    rows = _explode_sets(ls, rs, key, left_name, right_name, [], {
        BUCKET_COL: bucket_of(key, num_buckets), **_per_key(mode, key, log2m, regwidth, seed)}, mode)
    groups = [left_name, right_name]
    partials = _partial(rows, [BUCKET_COL, *groups], key, mode, lg_config_k, blank)
    return partials if keep_buckets else _merge(partials, groups, mode)


def write_bucketed_inputs(spark: SparkSession, left: DataFrame, right: DataFrame,
                          num_buckets: int, root: str, *, key: str = "pid",
                          left_dim: str = "locations", right_dim: str = "interest",
                          left_is_array: bool = True, right_is_array: bool = False,
                          left_name: str = "location", right_name: str = "interest",
                          blank: str = "drop") -> tuple[str, str]:
    """Both inputs as ``(bucket, key, value)`` rows, partitioned by bucket.

    Rows are deduplicated per (key, value) first (map-side partial aggregate), so a key
    repeated a million times is one row before it is shuffled and written.
    """
    paths = []
    for df, dim, is_arr, name, tag in ((left, left_dim, left_is_array, left_name, "left"),
                                       (right, right_dim, right_is_array, right_name, "right")):
        v = F.explode(F.col(dim)) if is_arr else F.col(dim)
        rows = (df.where(key_predicate(key, blank))
                  .select(key_column(df, key, blank).alias(key), v.alias(name)).distinct())
        path = f"{root}/{tag}"
        write_partitioned(with_bucket(rows, key, num_buckets), path, BUCKET_COL)
        paths.append(path)
    return paths[0], paths[1]


def two_phase_pairs(spark: SparkSession, left: DataFrame, right: DataFrame, num_buckets: int,
                    *, key: str = "pid", left_dim: str = "locations",
                    right_dim: str = "interest", left_is_array: bool = True,
                    right_is_array: bool = False, left_name: str = "location",
                    right_name: str = "interest", mode: str = "hll", lg_config_k: int = 13,
                    log2m: int = DEFAULT_LOG2M, regwidth: int = DEFAULT_REGWIDTH,
                    seed: int = DEFAULT_SEED, blank: str = "drop", root: str | None = None,
                    buckets: list[int] | None = None, write_inputs: bool = True) -> DataFrame:
    """Bucket to disk, per-bucket partials to staging, merge across buckets.

    ``buckets`` limits phase 2 to those bucket ids (re-run of selected buckets): their
    staged partials are replaced, those of other buckets under the same ``root`` are kept
    and merged too. ``write_inputs=False`` reuses the bucketed inputs already under ``root``.
    """
    _check(mode, num_buckets)
    if not write_inputs and root is None:
        raise ValueError("write_inputs=False needs the root of an earlier run")
    root = root or scratch_path(spark, "two-phase")
    if write_inputs:
        lpath, rpath = write_bucketed_inputs(
            spark, left, right, num_buckets, root, key=key, left_dim=left_dim,
            right_dim=right_dim, left_is_array=left_is_array, right_is_array=right_is_array,
            left_name=left_name, right_name=right_name, blank=blank)
    else:
        lpath, rpath = f"{root}/left", f"{root}/right"
    lrows = spark.read.parquet(lpath)
    rrows = spark.read.parquet(rpath)
    if buckets is not None:
        wanted = [int(b) for b in buckets]
        lrows = lrows.where(F.col(BUCKET_COL).isin(wanted))
        rrows = rrows.where(F.col(BUCKET_COL).isin(wanted))
    ls = lrows.groupBy(BUCKET_COL, key).agg(*distinct_set(left_name)).select(
        BUCKET_COL, key, with_null(left_name + "_set"))
    rs = rrows.groupBy(BUCKET_COL, key).agg(*distinct_set(right_name)).select(
        BUCKET_COL, key, with_null(right_name + "_set"))
    rows = _explode_sets(ls, rs, key, left_name, right_name, [BUCKET_COL],
                         _per_key(mode, key, log2m, regwidth, seed), mode)
    groups = [left_name, right_name]
    partials = _partial(rows, [BUCKET_COL, *groups], key, mode, lg_config_k, blank)
    params = {"exact": mode, "hll": f"{mode} lg_config_k={lg_config_k}",
              "registers": f"{mode} {sketch_spec(log2m, regwidth, seed)}"}[mode]
    params += f" num_buckets={num_buckets} {key}:{left_name}x{right_name} blank={blank}"
    return _merge(_staged(spark, partials, root, params, num_buckets, buckets), groups, mode)


_MANIFEST = "run string, seq int, bucket int, params string"


def _staged(spark: SparkSession, partials: DataFrame, root: str, params: str, num_buckets: int,
            buckets: list[int] | None) -> DataFrame:
    """Writes the partials as a run of their own; the latest partials of every bucket.

    The manifest has one row for each run and bucket, so it is read on the driver.
    """
    path = f"{root}/manifest"
    known = []
    if buckets is not None:
        known = [tuple(r) for r in spark.read.schema(_MANIFEST).parquet(path).collect()]
        others = {p for *_, p in known if p != params}
        if others:
            raise ValueError(f"buckets staged with {sorted(others)} cannot be merged with {params}")
    run, seq = uuid.uuid4().hex[:12], 1 + max((s for _, s, _, _ in known), default=0)
    write_partitioned(partials, f"{root}/staging/{run}", BUCKET_COL)
    mine = range(num_buckets) if buckets is None else sorted({int(b) for b in buckets})
    rows = [(run, seq, b, params) for b in mine]
    # written last: a run that failed before is not in the manifest
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode(
        "overwrite" if buckets is None else "append").parquet(path)
    latest: dict[int, tuple[int, str]] = {}
    for r, s, b, _ in [*known, *rows]:
        latest[b] = max(latest.get(b, (0, "")), (s, r))
    schema, out = partials.schema, None
    for r in sorted({r for _, r in latest.values()}):
        its = [b for b, (_, of) in latest.items() if of == r]
        part = (spark.read.schema(schema).parquet(f"{root}/staging/{r}")
                .where(F.col(BUCKET_COL).isin(its)))
        out = part if out is None else out.unionByName(part)
    return out


def bucket_by_pairs(spark: SparkSession, left: DataFrame, right: DataFrame, num_buckets: int,
                    *, key: str = "pid", left_dim: str = "locations",
                    right_dim: str = "interest", left_is_array: bool = True,
                    right_is_array: bool = False, left_name: str = "location",
                    right_name: str = "interest", mode: str = "exact", lg_config_k: int = 13,
                    log2m: int = DEFAULT_LOG2M, regwidth: int = DEFAULT_REGWIDTH,
                    seed: int = DEFAULT_SEED, blank: str = "drop",
                    root: str | None = None, sort: bool = True) -> DataFrame:
    """Co-bucketed tables; key sets and join run without any Exchange.

    Rows are deduplicated per (key, value) before they are written, so a repeated key does
    not fill one bucket's task with copies.

    Table names are unique per run (the tables live in the session catalog, their files
    under ``root``), so concurrent runs never overwrite each other.
    """
    _check(mode, num_buckets)
    root = root or scratch_path(spark, "bucket-by")
    suffix = uuid.uuid4().hex[:10]
    tables = []
    for df, dim, is_arr, name, tag in ((left, left_dim, left_is_array, left_name, "left"),
                                       (right, right_dim, right_is_array, right_name, "right")):
        v = F.explode(F.col(dim)) if is_arr else F.col(dim)
        rows = (df.where(key_predicate(key, blank))
                  .select(key_column(df, key, blank).alias(key), v.alias(name)).distinct())
        table = f"overlap_bucketed_{tag}_{suffix}"
        write_bucketed_table(rows, table, num_buckets, key, f"{root}/{tag}", sort=sort)
        tables.append(table)
    lt, rt = spark.table(tables[0]), spark.table(tables[1])
    ls = lt.groupBy(key).agg(*distinct_set(left_name)).select(key, with_null(left_name + "_set"))
    rs = rt.groupBy(key).agg(*distinct_set(right_name)).select(key,
                                                               with_null(right_name + "_set"))
    rows = _explode_sets(ls, rs, key, left_name, right_name, [],
                         _per_key(mode, key, log2m, regwidth, seed), mode)
    out = _partial(rows, [left_name, right_name], key, mode, lg_config_k, blank)
    for table in tables:  # the plan holds the tables' files and layout, not their names
        drop_table(spark, table)
    return out
