"""Theta sets as rows, screened by a threshold a value (A3, A4, E1, F1, J3 without the grid).

A set is the table ``(value, hash, limit)``: the distinct key hashes of a value that do not
exceed the value's limit. ``theta = (limit + 1) / 2^63`` is the share of all hashes kept, so a
set of n keys is estimated by ``rows / theta``, and the limit of a value with few keys is the
greatest hash there is: its set is complete and its estimate exact. All values hash keys alike, so
a hash kept on both sides of a pair lies below both limits, and the pair's overlap is estimated by
``shared rows / least theta``.

Two passes build it. The first counts rows a value (a count reads the value column alone and is
combined map-side). The second hashes each key *once a row, before the array is exploded*, drops
what exceeds the widest limit at once, and keeps what lies within the value's own limit. Rows that
repeat a key make the first count too large and the set too small: values with fewer than the
nominal entries get a wider limit, from the number found, and only they are read again.

So one input row costs a hash and a comparison; rows kept are about ``SLACK`` x nominal entries a
value. Pairs come from a join on the hash: the cost follows the overlap and not |A| x |B|, and
hot hashes (keys with very many values) are cut into blocks (see ``blocks``).

The limits are kept (persisted, so their size is known) before they are joined: Spark broadcasts
them only below its threshold. Null values are groups; blank keys follow ``blank`` as everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlap.operators.blocks import CHUNK, block_pairs, heavy_keys, written
from overlap.schema import key_column, key_predicate

WIDEST = (1 << 63) - 1
SLACK = 1.5
_SPAN = float(1 << 63)


def key_hash(key: Column) -> Column:
    """A 63-bit hash of a key; equal keys on either side have equal hashes."""
    return F.shiftrightunsigned(F.xxhash64(key), 1)


def theta_of(limit) -> Column:
    """The share of all hashes that a limit keeps; exactly 1 for the widest."""
    c = F.col(limit) if isinstance(limit, str) else limit
    return (c.cast("double") + 1.0) / _SPAN


def _limit(rows: Column, nominal: int) -> Column:
    wanted = F.lit(float(nominal) * SLACK)
    return F.when(rows <= wanted, F.lit(WIDEST)).otherwise((wanted / rows * _SPAN).cast("bigint"))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for name in names:
        on = on & a[name].eqNullSafe(b[name])
    return on


def _kept_once(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` persisted, and its number of rows; with it Spark knows the size when it plans a join."""
    df = df.persist()
    return df, df.count()


def _screened(names: list[str], counted: DataFrame, hashed, nominal: int) -> tuple[DataFrame, int]:
    """Sets ``(names..., hash, limit)`` and the number of values.

    ``counted`` has the values of every row, ``hashed`` maps a widest limit to rows (names..., hash).
    """
    if nominal < 1:
        raise ValueError("nominal_entries must be >= 1")
    sizes = counted.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    limits, n_values = _kept_once(sizes.select(*names, _limit(F.col("n"), nominal).alias("limit")))
    held = [limits]

    def kept(limits: DataFrame) -> DataFrame:
        rows = hashed(limits.agg(F.max("limit")).scalar())
        return (rows.join(limits, _same(rows, limits, names)).where(F.col("hash") <= F.col("limit"))
                .select(*[rows[n] for n in names], "hash", "limit").distinct())

    sets = written(kept(limits), "screened")
    while True:
        found = sets.groupBy(*names).agg(F.count(F.lit(1)).alias("found"))
        wider = F.least(F.lit(1024.0), F.greatest(
            F.lit(2.0), F.lit(SLACK * nominal) / F.greatest("found", F.lit(1))))
        narrow = limits.where(F.col("limit") < WIDEST)
        short = (
            narrow.join(found, _same(narrow, found, names), "left")
            .select(*[narrow[n] for n in names], "limit", F.coalesce("found", F.lit(0)).alias("found"))
            .where(F.col("found") < nominal)
            .select(*names, F.when(F.col("limit") * wider >= _SPAN, F.lit(WIDEST))
                    .otherwise((F.col("limit") * wider).cast("bigint")).alias("limit")))
        if short.isEmpty():
            break
        short, _ = _kept_once(short)
        # every round at least doubles a limit, so few are needed; the others' rows stay
        rest = sets.join(short, _same(sets, short, names), "left_anti")
        others = limits.join(short, _same(limits, short, names), "left_anti")
        sets = written(rest.unionByName(kept(short)), "screened")
        limits, _ = _kept_once(others.unionByName(short))
        held += [short, limits]
    for df in held:
        df.unpersist()
    return sets, n_values


def _side(df: DataFrame, key: str, dim: str, is_array: bool, blank: str):
    """Values of every row, and a map from a widest limit to (hash, value) rows, as ``_v``.

    The count may hold blank keys: it only sets a limit, and a set that comes out short is widened.
    The other rows are cut by hash first; the key is looked at only in what is left.
    """
    v = F.explode("_d") if is_array else F.col("_d")

    def hashed(widest: Column) -> DataFrame:
        rows = df.select(F.col(key), key_hash(key_column(df, key, blank)).alias("_h"), F.col(dim).alias("_d"))
        return (rows.where(F.col("_h") <= widest).where(key_predicate(key, blank))
                .select(F.col("_h").alias("hash"), v.alias("_v")))

    return df.where(F.col(key).isNotNull()).select(F.col(dim).alias("_d")).select(v.alias("_v")), hashed


def screened_sets(df: DataFrame, *, key: str = "pid", dim: str = "interest", name: str | None = None,
                  is_array: bool = False, nominal_entries: int = 4096, blank: str = "drop") -> DataFrame:
    """``(name, hash, limit)`` of each value of ``dim``; at least ``nominal_entries`` rows a value
    that has so many keys."""
    name = name or dim
    counted, hashed = _side(df, key, dim, is_array, blank)
    sets, _ = _screened(["_v"], counted, hashed, nominal_entries)
    return sets.select(F.col("_v").alias(name), "hash", "limit")


def merge_screened(sets: DataFrame, name: str) -> DataFrame:
    """Union of stored sets of a value: the least limit of its parts holds for all of them."""
    least = sets.groupBy(F.col(name).alias("_v")).agg(F.min("limit").alias("_least"))
    return (sets.join(least, F.col(name).eqNullSafe(F.col("_v"))).where(F.col("hash") <= F.col("_least"))
            .select(name, "hash", F.col("_least").alias("limit")).distinct())


def screened_estimates(sets: DataFrame, name: str, out: str = "estimate") -> DataFrame:
    """``(name, estimate double)``; exact where the limit is the widest."""
    return sets.groupBy(name).agg((F.count(F.lit(1)) / theta_of(F.max("limit"))).alias(out))


def screened_pair_counts(left_sets: DataFrame, right_sets: DataFrame, *, left_name: str = "location",
                         right_name: str = "interest", include_zero_pairs: bool = False,
                         chunk: int = CHUNK, most_values: int | None = None, count_col: str = "set_intersection_count") -> DataFrame:
    """``(left_name, right_name, count double)`` of the pairs that share a kept hash.

    Sets that are complete give every pair with an overlap, and its exact count. With
    ``include_zero_pairs`` the pairs without a shared hash are added with 0: that output is the
    whole grid of values, as asked for. ``most_values`` is a known bound on the values of a side: up to
    ``chunk`` of them, no hash can be hot and none is looked for.
    """
    lrows = left_sets.select("hash", F.col(left_name).alias("_ln"))
    rrows = right_sets.select("hash", F.col(right_name).alias("_rn"))
    cool = most_values is not None and most_values <= chunk
    hot = None if cool else heavy_keys(lrows, rrows, "hash", chunk)
    # rows are distinct: without a hot hash they are joined as they are
    rows = lrows.join(rrows, "hash") if hot is None else block_pairs(
        lrows, rrows, "hash", "_ln", "_rn", hot=hot, chunk=chunk)
    shared = (rows.groupBy("_ln", "_rn").agg(F.count(F.lit(1)).alias("_n")))
    ll = left_sets.groupBy(F.col(left_name).alias("_lv")).agg(F.max("limit").alias("_ll"))
    rl = right_sets.groupBy(F.col(right_name).alias("_rv")).agg(F.max("limit").alias("_rl"))
    if include_zero_pairs:
        grid = ll.crossJoin(rl)  # one row a value on either side: the requested output
        on = F.col("_ln").eqNullSafe(F.col("_lv")) & F.col("_rn").eqNullSafe(F.col("_rv"))
        both = grid.join(shared, on, "left")
    else:
        both = (shared.join(ll, F.col("_ln").eqNullSafe(F.col("_lv")))
                .join(rl, F.col("_rn").eqNullSafe(F.col("_rv"))))
    n = F.coalesce("_n", F.lit(0)) / theta_of(F.least("_ll", "_rl"))
    return both.select(F.col("_lv").alias(left_name), F.col("_rv").alias(right_name), n.alias(count_col))


def screened_pairs(left: DataFrame, right: DataFrame, *, key: str = "pid", left_dim: str = "locations",
                   right_dim: str = "interest", left_is_array: bool = True, right_is_array: bool = False,
                   left_name: str = "location", right_name: str = "interest",
                   nominal_entries: int = 4096, include_zero_pairs: bool = False, blank: str = "drop",
                   chunk: int = CHUNK) -> DataFrame:
    """Q3 end to end from the two inputs, by screened sets; both sides are screened in one go."""
    lcount, lhash = _side(left, key, left_dim, left_is_array, blank)
    rcount, rhash = _side(right, key, right_dim, right_is_array, blank)

    def both(one: DataFrame, two: DataFrame) -> DataFrame:
        return (one.withColumn("_left", F.lit(True)).withColumnRenamed("_v", "_a")
                .unionByName(two.withColumn("_left", F.lit(False)).withColumnRenamed("_v", "_b"),
                             allowMissingColumns=True))

    sets, values = _screened(["_left", "_a", "_b"], both(lcount, rcount),
                             lambda widest: both(lhash(widest), rhash(widest)), nominal_entries)
    ls = sets.where("_left").select(F.col("_a").alias(left_name), "hash", "limit")
    rs = sets.where("NOT _left").select(F.col("_b").alias(right_name), "hash", "limit")
    return screened_pair_counts(ls, rs, left_name=left_name, right_name=right_name,
                                include_zero_pairs=include_zero_pairs, chunk=chunk, most_values=values)
