"""Hot keys / hot values and random small inputs against a brute-force Python count."""

import math
import random
from collections import defaultdict

from conftest import as_dict
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from overlap.operators.pairs import pair_counts
from overlap.operators.registers import estimate_registers, register_pairs
from overlap.operators.theta import theta_pairs

LOC = T.StructType([T.StructField("pid", T.StringType(), True),
                    T.StructField("locations", T.ArrayType(T.StringType(), True), True)])
INT = T.StructType([T.StructField("pid", T.StringType(), True),
                    T.StructField("interest", T.StringType(), True)])


def brute(locs, ints):
    """Distinct keys per (location, interest), straight from the definition."""
    lsets, isets = defaultdict(set), defaultdict(set)
    for pid, arr in locs:
        if pid is not None and pid.strip() and arr:
            for a in arr:
                lsets[a].add(pid)
    for pid, i in ints:
        if pid is not None and pid.strip():
            isets[i].add(pid)
    return {(a, b): len(lsets[a] & isets[b]) for a in lsets for b in isets
            if lsets[a] & isets[b]}


def brute_registers(pairs_keys, log2m=13, regwidth=6, seed=2131319):
    """Register HLL estimate computed in Python from the same md5 rule."""
    import hashlib
    m = 1 << log2m
    out = {}
    for pair, keys in pairs_keys.items():
        regs = {}
        for k in keys:
            h = hashlib.md5(f"{seed}:{k}".encode()).hexdigest()
            j = int(h[:8], 16) % m
            w = int(h[8:16], 16)
            rho = 33 if w == 0 else 33 - len(bin(w)[2:])
            regs[j] = max(regs.get(j, 0), min(rho, (1 << regwidth) - 1))
        v = m - len(regs)
        z = sum(2.0 ** -r for r in regs.values()) + v
        e = 0.7213 / (1 + 1.079 / m) * m * m / z
        if e <= 2.5 * m and v > 0:
            e = m * math.log(m / v)
        out[pair] = int(math.floor(e + 0.5))
    return out


def test_hot_key_and_hot_value(spark):
    rnd = random.Random(7)
    ints = [("hot", f"i{rnd.randrange(30)}") for _ in range(20000)]          # a third of rows
    ints += [(f"p{rnd.randrange(3000)}", f"i{rnd.randrange(30)}") for _ in range(20000)]
    ints += [(f"p{rnd.randrange(3000)}", "i0") for _ in range(20000)]          # hot value
    locs = [("hot", [f"l{j}" for j in range(40)])] * 500
    locs += [(f"p{k}", [f"l{rnd.randrange(40)}" for _ in range(3)]) for k in range(3000)]
    want = brute(locs, ints)
    L = spark.createDataFrame(locs, LOC).repartition(8)
    I = spark.createDataFrame(ints, INT).repartition(8)
    assert as_dict(pair_counts(L, I), "distinct_count") == want
    assert as_dict(pair_counts(L, I, strategy="join"), "distinct_count") == want
    theta = as_dict(theta_pairs(L, I, include_zero_pairs=False), "set_intersection_count")
    assert theta == {k: float(v) for k, v in want.items()}


names = st.sampled_from(["a", "b", "c", "d", "e", " ", "", None])
dims = st.sampled_from(["X", "Y", "Z", None])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(locs=st.lists(st.tuples(names, st.one_of(st.none(), st.lists(dims, max_size=4))),
                     max_size=12),
       ints=st.lists(st.tuples(names, st.sampled_from(["I", "J", "K"])), max_size=12))
def test_random_inputs_match_brute_force(spark, locs, ints):
    want = brute(locs, ints)
    L = spark.createDataFrame(locs, LOC)
    I = spark.createDataFrame(ints, INT)
    assert as_dict(pair_counts(L, I), "distinct_count") == want
    theta = as_dict(theta_pairs(L, I, include_zero_pairs=False), "set_intersection_count")
    assert theta == {k: float(v) for k, v in want.items()}


def test_registers_match_python_estimator(spark):
    rnd = random.Random(3)
    ints = [(f"u{rnd.randrange(20000)}", f"i{rnd.randrange(3)}") for _ in range(30000)]
    locs = [(f"u{k}", [f"l{k % 2}"]) for k in range(20000)]
    keys = defaultdict(set)
    lmap = {p: a for p, a in locs}
    for p, i in ints:
        for a in lmap[p]:
            keys[(a, i)].add(p)
    want = brute_registers(keys)
    got = as_dict(estimate_registers(register_pairs(spark.createDataFrame(locs, LOC),
                                                    spark.createDataFrame(ints, INT)),
                                     ["location", "interest"]), "estimate")
    assert got == want
