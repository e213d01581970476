"""The overlap inputs derived from the TPC-H-style tables.

key = customer (``pid``), dimension A = nations of the suppliers a customer bought from
(an array per customer, like the people->locations table), dimension B = brands of the parts
a customer bought (one row per (customer, brand), like the people->interests table).
Everything is derived by Spark from the given tables, so the work grows with them.

The (customer, brand) and (customer, nation) rows repeat once per order line. They are
not deduplicated here: every counting method is insensitive to repeated rows (key sets,
sketches and ``count(distinct)`` all dedupe, map-side where possible), so a separate
DISTINCT would only add a shuffle of order-line volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.sources.tables import read_table


def _order_lines(spark: SparkSession, sf_dir: str, line_col: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey", line_col)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``interests(pid string, interest string)``: (customer, part brand) per order line."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_brand")
    ol = _order_lines(spark, sf_dir, "l_partkey")
    return (ol.join(part, ol.l_partkey == part.p_partkey)
              .select(F.col("o_custkey").cast("string").alias("pid"),
                      F.col("p_brand").alias("interest")))


def exploded_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pid string, location string)``: (customer, supplier nation) per order line."""
    supplier = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    ol = _order_lines(spark, sf_dir, "l_suppkey")
    return (ol.join(supplier, ol.l_suppkey == supplier.s_suppkey)
              .join(nation, F.col("s_nationkey") == nation.n_nationkey)
              .select(F.col("o_custkey").cast("string").alias("pid"),
                      F.col("n_name").alias("location")))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``locations(pid string, locations array<string>)``: one row per customer.

    ``collect_set`` (partially aggregated map-side) dedupes; the per-customer array is
    bounded by the number of nations (a dimension, not the data).
    """
    return (exploded_locations(spark, sf_dir)
            .groupBy("pid")
            .agg(F.array_sort(F.collect_set("location")).alias("locations")))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``people(pid string)``: every customer key."""
    return read_table(spark, sf_dir, "customer", "c_custkey").select(
        F.col("c_custkey").cast("string").alias("pid"))


def interests_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pid, interest, year)``: the interests rows with the order year, for partial sketches
    that are merged later (one sketch per (brand, year) -> per brand)."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_brand")
    ol = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return (ol.join(part, ol.l_partkey == part.p_partkey)
              .select(F.col("o_custkey").cast("string").alias("pid"),
                      F.col("p_brand").alias("interest"),
                      F.year("o_orderdate").alias("year")))
