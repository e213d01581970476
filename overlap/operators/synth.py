"""Synthetic people / locations / interests tables (Q7: G1-G3, S5, S11, S12).

Keys come from a given table (customers, orders or order lines), so the generated tables
grow with the data they are derived from. Every choice is a deterministic function of
(seed, key, value) -- md5 ranks instead of a random shuffle -- so reruns, retried tasks
and a SQL oracle all produce the same rows. No rows are built on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.sources.tables import read_table

# The city and interest word lists of the generated data, in their
# original order (two city groups of 17 and 16, two interest groups of 9 and 9).
CITY_GROUP_1 = ["Anchorage", "Singapore", "Pyongyang", "Amsterdam", "Bucharest", "Marseille",
                "Barcelona", "Stockholm", "Edinburgh", "Lisbon", "Budapest", "Copenhagen",
                "Dublin", "Helsinki", "Oslo", "Prague", "Reykjavik"]
CITY_GROUP_2 = ["London", "Bombay", "Moscow", "Sydney", "Tehran", "Nagpur", "Phuket", "Austin",
                "Warsaw", "Kiev", "Rome", "Paris", "Berlin", "Vienna", "Madrid", "Athens"]
INTEREST_GROUP_1 = ["Pizza", "Paint", "Sushi", "Pasta", "Tacos", "Ramen", "Chips", "Salad",
                    "Tango"]
INTEREST_GROUP_2 = ["Yoga", "Chai", "Cook", "Cars", "Lego", "Bike", "News", "Tech", "Cake"]
PICKS_PER_GROUP = 5
# Fixed value: the symbols of a person id's suffix.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@$%"
PID_SUFFIX_LEN = 35
DEFAULT_SEED = 42

SOURCES = {"customer": ("customer", ["c_custkey"]),
           "orders": ("orders", ["o_orderkey"]),
           "lineitem": ("lineitem", ["l_orderkey", "l_linenumber"])}


def people(spark: SparkSession, sf_dir: str, *, source: str = "customer",
           seed: int = DEFAULT_SEED, num_partitions: int | None = None,
           copies: int = 1) -> DataFrame:
    """G1: ``people(pid)`` -- ``<key>_<35 hex chars of sha256(seed:key)>`` per source row.

    ``copies`` > 1 derives that many people per source row (key ``<key>-<copy>``), for
    load tests larger than the source table. ``num_partitions`` spreads the keys over that
    many tasks before the per-person work (a source file that is one row group is
    otherwise generated by a single task).
    """
    if source not in SOURCES:
        raise ValueError(f"source must be one of {sorted(SOURCES)}")
    if copies < 1:
        raise ValueError("copies must be >= 1")
    table, cols = SOURCES[source]
    df = read_table(spark, sf_dir, table, *cols)
    parts = [F.col(c).cast("string") for c in cols]
    if copies > 1:
        df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        parts.append(F.col("_copy").cast("string"))
    ident = F.concat_ws("-", *parts)
    suffix = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256), 1, PID_SUFFIX_LEN)
    out = df.select(F.concat(ident, F.lit("_"), suffix).alias("pid"))
    return out.repartition(num_partitions) if num_partitions else out


def symbol_suffix(ident: Column, seed: int = DEFAULT_SEED) -> Column:
    """35 of ``SYMBOLS``, each by three hex digits of two sha256 of the identity and the seed."""
    h = F.concat(F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256),
                 F.sha2(F.concat(ident, F.lit(f":{seed}")), 256))
    at = [F.conv(F.substring(h, 3 * i + 1, 3), 16, 10).cast("int") for i in range(PID_SUFFIX_LEN)]
    return F.concat(*[F.substr(F.lit(SYMBOLS), F.pmod(a, F.lit(len(SYMBOLS))) + 1, F.lit(1)) for a in at])


def symbol_people(idents: DataFrame, ident: str, *, seed: int = DEFAULT_SEED) -> DataFrame:
    """G1 in its own alphabet: ``people(pid)``, ``<ident>_<35 symbols>`` for each row of ``idents``."""
    c = F.col(ident).cast("string")
    return idents.select(F.concat(c, F.lit("_"), symbol_suffix(c, seed)).alias("pid"))


def numbered_people(spark: SparkSession, n: int, *, seed: int = DEFAULT_SEED,
                    num_partitions: int | None = None) -> DataFrame:
    """G1 for any number of people: ``n`` of them, numbered from 0, made by the executors."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return symbol_people(spark.range(0, n, 1, num_partitions), "id", seed=seed)


def _pick(pid: Column, words: list[str], k: int, seed: int) -> Column:
    """k of ``words`` per key, ranked by md5(seed:pid:word) -- no repeats.

    Built from ``array``/``sort_array``/``slice`` and a struct-field projection only (no
    lambda functions), so the whole pick stays inside whole-stage code generation.
    """
    ranked = F.sort_array(F.array(*[
        F.struct(F.md5(F.concat(F.lit(f"{seed}:"), pid, F.lit(f":{w}"))).alias("h"),
                 F.lit(w).alias("v")) for w in words]))
    return F.slice(ranked, 1, k).getField("v")


def person_locations(people_df: DataFrame, *, seed: int = DEFAULT_SEED) -> DataFrame:
    """``locations(pid, locations array)`` -- 5 of group 1 + 5 of group 2 per person."""
    pid = F.col("pid")
    return people_df.select(pid, F.concat(_pick(pid, CITY_GROUP_1, PICKS_PER_GROUP, seed),
                                          _pick(pid, CITY_GROUP_2, PICKS_PER_GROUP, seed))
                            .alias("locations"))


def person_interests(people_df: DataFrame, *, seed: int = DEFAULT_SEED) -> DataFrame:
    """``interests(pid, interest)`` -- 5 of group 1 + 5 of group 2, one row each."""
    pid = F.col("pid")
    picks = F.concat(_pick(pid, INTEREST_GROUP_1, PICKS_PER_GROUP, seed),
                     _pick(pid, INTEREST_GROUP_2, PICKS_PER_GROUP, seed))
    return people_df.select(pid, F.explode(picks).alias("interest"))
