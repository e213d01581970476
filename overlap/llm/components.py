"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round groups links by one end and hooks neighbours to the smallest node seen, so trees
flatten in a logarithmic number of rounds. A group is reduced by its minimum (map-side) and
joined back, so no neighbourhood is gathered in one task. Rounds are staged in the shared
folder; only a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.llm.common import staged

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) of nodes hooked to the least node of their neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    hooked = both.join(least, "a")
    if large:
        hooked = hooked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hooked = (hooked.select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .union(least.select("a", F.col("m").alias("b"))))
    return hooked.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the links (long columns a, b)."""
    links = staged(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        after = staged(_star(_star(links, large=True), large=False), "links")
        # flat: every node hangs on one root, and no root hangs on another
        knots = (after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
                 and after.select(F.col("b").alias("a")).distinct().join(
                     after.select("a"), "a", "left_semi").isEmpty())
        links = after
        if knots:
            break
    else:
        raise RuntimeError("the components did not converge")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b"), F.col("b")).distinct())
