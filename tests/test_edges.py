"""Edge cases: blank keys, null/empty arrays, duplicates, null elements, one-sided keys,
hash = Int.MIN, lgK mismatch, key types, 0 vs 0, count-column heuristic."""

import pytest
from conftest import as_dict
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlap.functions.keys import bucket_from_hash
from overlap.functions.metrics import percent_difference
from overlap.operators.accuracy import compare_counts, pick_count_column
from overlap.operators.hll import estimate_hll, hll_pairs, hll_sets, merge_hll
from overlap.operators.pairs import pair_counts
from overlap.operators.registers import estimate_registers, register_pairs
from overlap.operators.theta import theta_pairs

LOC = T.StructType([T.StructField("pid", T.StringType(), True),
                    T.StructField("locations", T.ArrayType(T.StringType(), True), True)])
INT = T.StructType([T.StructField("pid", T.StringType(), True),
                    T.StructField("interest", T.StringType(), True)])


def all_methods(locs, ints, blank="drop"):
    out = {
        "exact": as_dict(pair_counts(locs, ints, blank=blank), "distinct_count"),
        "join": as_dict(pair_counts(locs, ints, strategy="join", blank=blank), "distinct_count"),
        "approx": as_dict(pair_counts(locs, ints, exact=False, blank=blank), "approx_pid_count"),
        "theta": {k: int(v) for k, v in as_dict(
            theta_pairs(locs, ints, include_zero_pairs=False, blank=blank),
            "set_intersection_count").items()},
        "hll": as_dict(estimate_hll(hll_pairs(locs, ints, blank=blank), out="n"), "n"),
        "registers": as_dict(estimate_registers(register_pairs(locs, ints, blank=blank),
                                                ["location", "interest"]), "estimate"),
    }
    return out


def test_blank_keys_dropped_by_default(spark):
    keys = [None, "", "  ", "a"]
    locs = spark.createDataFrame([(k, ["X"]) for k in keys], LOC)
    ints = spark.createDataFrame([(k, "I") for k in keys], INT)
    for method, got in all_methods(locs, ints).items():
        assert got == {("X", "I"): 1}, method


def test_blank_keys_kept_on_request(spark):
    keys = [None, "", "  ", "a"]
    locs = spark.createDataFrame([(k, ["X"]) for k in keys], LOC)
    ints = spark.createDataFrame([(k, "I") for k in keys], INT)
    for method, got in all_methods(locs, ints, blank="keep").items():
        assert got == {("X", "I"): 3}, method


def test_null_and_empty_arrays_give_no_pairs(spark):
    locs = spark.createDataFrame([("a", None), ("b", []), ("c", ["X"])], LOC)
    ints = spark.createDataFrame([("a", "I"), ("b", "I"), ("c", "I")], INT)
    for method, got in all_methods(locs, ints).items():
        assert got == {("X", "I"): 1}, method


def test_repeated_elements_and_rows_count_once(spark):
    locs = spark.createDataFrame([("a", ["P", "P"]), ("a", ["P"])], LOC)
    ints = spark.createDataFrame([("a", "I"), ("a", "I")], INT)
    for method, got in all_methods(locs, ints).items():
        assert got == {("P", "I"): 1}, method


def test_null_element_is_its_own_group(spark):
    locs = spark.createDataFrame([("a", [None, "P"]), ("b", [None])], LOC)
    ints = spark.createDataFrame([("a", "I"), ("b", "I")], INT)
    want = {(None, "I"): 2, ("P", "I"): 1}
    for method in ("exact", "join", "approx", "theta", "hll", "registers"):
        assert all_methods(locs, ints)[method] == want, method


def test_one_sided_key_in_no_pair(spark):
    locs = spark.createDataFrame([("a", ["P"])], LOC)
    ints = spark.createDataFrame([("a", "I"), ("z", "J")], INT)
    got = as_dict(theta_pairs(locs, ints), "set_intersection_count")
    assert got == {("P", "I"): 1.0, ("P", "J"): 0.0}
    assert as_dict(pair_counts(locs, ints), "distinct_count") == {("P", "I"): 1}


def test_bucket_of_int_min_is_in_range(spark):
    row = spark.range(1).select(
        bucket_from_hash(F.lit(-2147483648), 1000).alias("b"),
        bucket_from_hash(F.lit(2147483647), 1000).alias("c")).first()
    assert row.b == 352 and row.c == 647


def test_hll_merge_rejects_different_lg_k(spark):
    df = spark.createDataFrame([("g", str(i)) for i in range(100)], "g string, pid string")
    a = hll_sets(df, ["g"], lg_config_k=12)
    b = hll_sets(df, ["g"], lg_config_k=13)
    both = a.unionByName(b)
    with pytest.raises(Exception, match="HLL_UNION_DIFFERENT_LG_K"):
        merge_hll(both, ["g"]).collect()
    n = estimate_hll(merge_hll(both, ["g"], allow_different_lg_k=True), out="n").first().n
    assert n == 100


def test_key_types_are_aligned_not_silently_zero(spark):
    locs = spark.createDataFrame([(1, ["P"]), (2, ["P"])], "pid bigint, locations array<string>")
    ints = spark.createDataFrame([("1", "I"), ("2", "I")], INT)
    assert as_dict(theta_pairs(locs, ints), "set_intersection_count") == {("P", "I"): 2.0}
    assert as_dict(pair_counts(locs, ints), "distinct_count") == {("P", "I"): 2}


def test_percent_difference_zero_vs_zero(spark):
    df = spark.createDataFrame([(0, 0), (90, 110), (0, 5)], "a long, b long")
    got = [r.p for r in df.select(percent_difference("a", "b").alias("p")).collect()]
    assert got == [0.0, 20.0, 200.0]


def test_count_column_heuristic_skips_strings(spark):
    df = spark.createDataFrame([("FR", 3)], "country string, n_count long")
    assert pick_count_column(df) == "n_count"
    assert pick_count_column(df, "n_count") == "n_count"
    with pytest.raises(ValueError):
        pick_count_column(df.select("country"))


def test_compare_full_join_shows_one_sided_pairs(spark):
    a = spark.createDataFrame([("P", "I", 3), ("Q", "I", 1)], "location string, interest string, c long")
    b = spark.createDataFrame([("P", "I", 3)], "location string, interest string, distinct_count long")
    inner = compare_counts(a, b, count_a="c")
    assert inner.count() == 1
    full = {(r.location1, r.location2): (r.count_1, r.count_2, r.percent_difference)
            for r in compare_counts(a, b, count_a="c", how="full").collect()}
    assert full[("Q", None)] == (1, 0, 200.0)
    assert full[("P", "P")] == (3, 3, 0.0)


def test_scalar_by_scalar_and_array_by_array(spark):
    a = spark.createDataFrame([("p1", "X"), ("p2", "X"), ("p2", "Y")], "pid string, a string")
    b = spark.createDataFrame([("p1", "I"), ("p2", "I")], "pid string, b string")
    kw = dict(left_dim="a", right_dim="b", left_is_array=False, right_is_array=False,
              left_name="location", right_name="interest")
    want = {("X", "I"): 2, ("Y", "I"): 1}
    assert as_dict(pair_counts(a, b, **kw), "distinct_count") == want
    assert as_dict(pair_counts(a, b, strategy="join", **kw), "distinct_count") == want
    assert {k: int(v) for k, v in as_dict(theta_pairs(a, b, **kw),
                                          "set_intersection_count").items()} == want
    aa = spark.createDataFrame([("p1", ["X"]), ("p2", ["X", "Y"])], "pid string, a array<string>")
    bb = spark.createDataFrame([("p1", ["I", "J"]), ("p2", ["I"])], "pid string, b array<string>")
    kw2 = dict(kw, left_is_array=True, right_is_array=True)
    want2 = {("X", "I"): 2, ("Y", "I"): 1, ("X", "J"): 1}
    assert as_dict(pair_counts(aa, bb, **kw2), "distinct_count") == want2
    assert as_dict(pair_counts(aa, bb, strategy="join", explode="early", **kw2),
                   "distinct_count") == want2


def test_null_element_and_rerun_in_bucketed_paths(spark, tmp_path):
    from overlap.operators.buckets import bucket_by_pairs, bucketed_pairs, two_phase_pairs

    locs = spark.createDataFrame([("a", [None, "P"]), ("b", [None]), ("c", ["P"])], LOC)
    ints = spark.createDataFrame([("a", "I"), ("b", "I"), ("c", None)], INT)
    want = {(None, "I"): 2, ("P", "I"): 1, ("P", None): 1}
    assert as_dict(bucketed_pairs(locs, ints, 3), "distinct_count") == want
    assert as_dict(bucket_by_pairs(spark, locs, ints, 3), "distinct_count") == want
    root = str(tmp_path / "tp")
    assert as_dict(two_phase_pairs(spark, locs, ints, 3, mode="exact", root=root),
                   "distinct_count") == want
    # re-run of selected buckets on the staged inputs: same merged answer
    again = two_phase_pairs(spark, locs, ints, 3, mode="exact", root=root,
                            buckets=[0, 1, 2], write_inputs=False)
    assert as_dict(again, "distinct_count") == want
