"""SQL surface: scalar SQL functions and the pair queries as SQL text."""

from conftest import EXPECTED_PAIRS, as_dict
from pyspark.sql import functions as F

from overlap.functions.sketches import empty_hll, empty_hll_bytes
from overlap.plans.inspect import executed_plan
from overlap.plans.sql import register_sql_functions, run_pair_sql


def test_sql_functions(spark):
    names = register_sql_functions(spark)
    assert "estimate_hll" in names
    r = spark.sql("""SELECT estimate_hll(hll_sketch_agg(CAST(id AS STRING), 12)) AS n,
                            bucket_of('x', 10) AS b, blank_to_null('  ') AS k,
                            percent_difference(0.0, 0.0) AS p0, percent_difference(90.0, 110.0) AS p
                     FROM range(100)""").first()
    assert abs(r.n - 100) <= 2 and 0 <= r.b < 10 and r.k is None and r.p0 == 0.0 and r.p == 20.0
    plan = executed_plan(spark.sql("SELECT estimate_hll(hll_sketch_agg(CAST(id AS STRING), 12)) FROM range(5)"))
    assert "Python" not in plan


def test_pair_sql_methods(spark, example):
    locs, ints = example
    assert as_dict(run_pair_sql(spark, locs, ints, "exact"), "distinct_count") == EXPECTED_PAIRS
    assert as_dict(run_pair_sql(spark, locs, ints, "approx"), "approx_pid_count") == EXPECTED_PAIRS
    theta = as_dict(run_pair_sql(spark, locs, ints, "theta"), "set_intersection_count")
    assert len(theta) == 16 and {k: v for k, v in theta.items() if v} == \
        {k: float(v) for k, v in EXPECTED_PAIRS.items()}
    hll = run_pair_sql(spark, locs, ints, "hll").select(
        "location", "interest", F.hll_sketch_estimate("hll_bytes").alias("n"))
    assert as_dict(hll, "n") == EXPECTED_PAIRS


def test_empty_hll(spark):
    e = empty_hll_bytes(spark, 13)
    assert isinstance(e, (bytes, bytearray)) and len(e) > 0
    df = spark.createDataFrame([("a", None)], "g string, h binary")
    n = df.select(F.hll_sketch_estimate(empty_hll("h", F.lit(e))).alias("n")).first().n
    assert n == 0
