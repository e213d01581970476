import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from overlap.session import local_session

    s = local_session("*", shuffle_partitions=8, app="overlap-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def example(spark):
    """The worked example: 3 people, their locations and interests."""
    from overlap.schema import INTERESTS, LOCATIONS

    locs = spark.createDataFrame([("John", ["Paris", "Delhi", "Dubai"]), ("Akash", ["Delhi"]),
                                  ("Ding", ["Shanghai", "Dubai"])], LOCATIONS)
    ints = spark.createDataFrame([("John", "Tea"), ("Akash", "Tea"), ("John", "Lego"),
                                  ("Akash", "Math"), ("Ding", "Gym")], INTERESTS)
    return locs, ints


EXPECTED_PAIRS = {("Paris", "Tea"): 1, ("Delhi", "Tea"): 2, ("Dubai", "Tea"): 1,
                  ("Delhi", "Math"): 1, ("Paris", "Lego"): 1, ("Delhi", "Lego"): 1,
                  ("Dubai", "Lego"): 1, ("Shanghai", "Gym"): 1, ("Dubai", "Gym"): 1}


def as_dict(df, value):
    return {(r["location"], r["interest"]): r[value] for r in df.collect()}
