"""Path-to-path jobs: every method/technique, accuracy from files, generation."""

import pytest
from conftest import EXPECTED_PAIRS, SF001, as_dict
from pyspark.sql import functions as F

from overlap.plans.jobs import accuracy_job, generate_job, pair_job


@pytest.fixture(scope="module")
def paths(spark, example, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    locs, ints = example
    locs.write.parquet(str(root / "locations"))
    ints.write.parquet(str(root / "interests"))
    return root


@pytest.mark.parametrize("method,technique,col", [
    ("exact", "none", "distinct_count"), ("approx", "none", "approx_pid_count"),
    ("theta", "none", "set_intersection_count"), ("registers", "none", "estimate"),
    ("exact", "one_job", "distinct_count"), ("exact", "partitioned", "distinct_count"),
    ("exact", "bucket_by", "distinct_count"), ("registers", "partitioned", "estimate")])
def test_pair_job(spark, paths, method, technique, col):
    out = pair_job(spark, str(paths / "locations"), str(paths / "interests"),
                   str(paths / f"out_{method}_{technique}"), method=method,
                   technique=technique, num_buckets=3)
    got = {k: v for k, v in as_dict(out, col).items() if v}
    assert got == {k: type(v)(EXPECTED_PAIRS[k]) for k, v in got.items()}
    assert set(got) == set(EXPECTED_PAIRS)


def test_pair_job_hll_and_accuracy(spark, paths, tmp_path):
    pair_job(spark, str(paths / "locations"), str(paths / "interests"), str(tmp_path / "hll"),
             method="hll", technique="partitioned", num_buckets=4)
    pair_job(spark, str(paths / "locations"), str(paths / "interests"), str(tmp_path / "ex"),
             method="exact")
    stats = accuracy_job(spark, str(tmp_path / "hll"), str(tmp_path / "ex"),
                         str(tmp_path / "report")).first()
    assert stats.pairs == 9 and stats.max_percent_difference == 0.0
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 9


def test_bad_technique_rejected(spark, paths, tmp_path):
    with pytest.raises(ValueError):
        pair_job(spark, str(paths / "locations"), str(paths / "interests"),
                 str(tmp_path / "x"), method="hll", technique="physical")
    with pytest.raises(ValueError):
        pair_job(spark, str(paths / "locations"), str(paths / "interests"),
                 str(tmp_path / "x"), method="theta", technique="partitioned", num_buckets=2)


def test_generate_job(spark, tmp_path):
    counts = {r.table: r.n_rows for r in generate_job(spark, SF001, str(tmp_path), num_partitions=4).collect()}
    n = spark.read.parquet(f"{SF001}/customer.parquet").count()
    assert counts == {"people": n, "locations": n, "interests": 10 * n}
    locs = spark.read.parquet(str(tmp_path / "locations"))
    sizes = {r.s for r in locs.select(F.size(F.array_distinct("locations")).alias("s")).collect()}
    assert sizes == {10}
    assert len(list((tmp_path / "people").glob("part-*.parquet"))) <= 4


def test_people_copies_are_distinct_and_deterministic(spark):
    from overlap.operators import synth

    n = spark.read.parquet(f"{SF001}/customer.parquet").count()
    a = synth.people(spark, SF001, copies=3)
    assert a.count() == 3 * n and a.distinct().count() == 3 * n
    b = synth.people(spark, SF001, copies=3, num_partitions=5)
    assert sorted(r.pid for r in a.collect()) == sorted(r.pid for r in b.collect())


@pytest.mark.parametrize("technique", ["none", "partitioned"])
def test_registers_written_mergeable_and_compared(spark, paths, tmp_path, technique):
    args = (spark, str(paths / "locations"), str(paths / "interests"))
    regs = pair_job(*args, str(tmp_path / "regs"), method="registers", technique=technique,
                    num_buckets=3, mergeable=True)
    assert set(regs.columns) == {"location", "interest", "reg", "rho", "spec"}
    pair_job(*args, str(tmp_path / "ex"), method="exact")
    stats = accuracy_job(spark, str(tmp_path / "regs"), str(tmp_path / "ex")).first()
    assert stats.pairs == 9 and stats.max_percent_difference == 0.0
