"""Binary sketch functions (E1-E3, F1, F2) and bucket/hash helpers."""

from pyspark.sql import functions as F

from overlap.functions.keys import bucket_of, hash_key
from overlap.functions.sketches import (hll_estimate, hll_merge, theta_estimate,
                                        theta_intersect, theta_merge)


def _sketches(spark):
    df = spark.createDataFrame([(g, str(k)) for g, ks in (("a", range(0, 60)), ("b", range(40, 100)))
                                for k in ks], "g string, k string")
    pivot = df.groupBy().agg(
        F.theta_sketch_agg(F.when(F.col("g") == "a", F.col("k")), 12).alias("ta"),
        F.theta_sketch_agg(F.when(F.col("g") == "b", F.col("k")), 12).alias("tb"),
        F.hll_sketch_agg(F.when(F.col("g") == "a", F.col("k")), 12).alias("ha"),
        F.hll_sketch_agg(F.when(F.col("g") == "b", F.col("k")), 12).alias("hb"))
    return pivot


def test_theta_set_algebra(spark):
    r = _sketches(spark).select(
        theta_estimate(theta_intersect("ta", "tb")).alias("inter"),
        theta_estimate(theta_merge("ta", "tb", 12)).alias("union"),
        theta_estimate("ta").alias("a")).first()
    assert (r.inter, r.union, r.a) == (20.0, 100.0, 60.0)


def test_hll_union_and_estimate(spark):
    r = _sketches(spark).select(hll_estimate(hll_merge("ha", "hb")).alias("u"),
                                hll_estimate("ha").alias("a")).first()
    assert abs(r.u - 100) <= 2 and abs(r.a - 60) <= 1


def test_bucket_and_hash_helpers(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    r = df.agg(F.min(bucket_of("k", 7)).alias("lo"), F.max(bucket_of("k", 7)).alias("hi"),
               F.count_distinct(hash_key("k", "xxhash64")).alias("x"),
               F.count_distinct(hash_key("k", "md5")).alias("m")).first()
    assert (r.lo, r.hi, r.x, r.m) == (0, 6, 1000, 1000)
