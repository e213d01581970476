"""Key hashing and bucket ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_of(key, num_buckets: int) -> Column:
    """Bucket id in [0, num_buckets): ``pmod(hash(key), n)``.

    ``abs(hash) % n`` overflows for hash = Int.MIN (an ANSI error, or a negative bucket
    that a per-bucket loop never visits); ``pmod`` is always in range.
    """
    c = F.col(key) if isinstance(key, str) else key
    return bucket_from_hash(F.hash(c), num_buckets)


def bucket_from_hash(h: Column, num_buckets: int) -> Column:
    """``pmod(h, n)``: in range for every 32-bit hash, Int.MIN included."""
    if num_buckets < 1:
        raise ValueError("num_buckets must be >= 1")
    return F.pmod(h, F.lit(num_buckets)).cast("int")


def hash_key(key, kind: str = "murmur3") -> Column:
    """Key hash: ``murmur3`` (Spark ``hash``, what bucketing uses), ``xxhash64`` or ``md5``."""
    c = F.col(key) if isinstance(key, str) else key
    if kind == "murmur3":
        return F.hash(c)
    if kind == "xxhash64":
        return F.xxhash64(c)
    if kind == "md5":
        return F.md5(c.cast("string"))
    raise ValueError(f"unknown hash kind {kind!r}")
