"""SQL surface (U1-U3): scalar helpers as SQL functions, and the pair queries as Spark SQL.

The reference registers JVM aggregates (``hll_of``, ``hll_merge``, ``union_of_sets``) and a
scalar ``estimate_hll`` for its SQL. Spark 4 ships the aggregates natively --
``hll_sketch_agg(x, lgK)``, ``hll_union_agg(b)``, ``theta_sketch_agg(x, lgNom)``,
``theta_union_agg(b, lgNom)`` (keys are fed as UTF-8 bytes, ``CAST(k AS BINARY)``, which
gives the same sketches as the string, cheaper) -- and the scalar helpers are declared here as SQL functions
(``CREATE TEMPORARY FUNCTION ... RETURN <expr>``), which the analyzer inlines: no Python and
no JVM UDF is involved at run time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_FUNCTIONS = {
    "estimate_hll": "(b BINARY) RETURNS BIGINT RETURN hll_sketch_estimate(b)",
    "estimate_theta": "(b BINARY) RETURNS DOUBLE RETURN CAST(theta_sketch_estimate(b) AS DOUBLE)",
    "intersection_count": "(a BINARY, b BINARY) RETURNS DOUBLE "
                          "RETURN CAST(theta_sketch_estimate(theta_intersection(a, b)) AS DOUBLE)",
    "bucket_of": "(k STRING, n INT) RETURNS INT RETURN CAST(pmod(hash(k), n) AS INT)",
    "is_blank_key": "(k STRING) RETURNS BOOLEAN RETURN k RLIKE r'^\\p{javaWhitespace}*$'",
    "blank_to_null": "(k STRING) RETURNS STRING "
                     "RETURN CASE WHEN NOT (k RLIKE r'^\\p{javaWhitespace}*$') THEN k END",
    "percent_difference": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN "
                          "coalesce(try_divide(abs(a - b), (a + b) / 2.0) * 100.0, "
                          "CASE WHEN a = b THEN 0.0 END)",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Declare the scalar helpers as session SQL functions; returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)


_KEEP = "{p} IS NOT NULL AND NOT is_blank_key({p})"

# One row per key and side with its distinct values, met once per key: what a pair's keys are
# counted from, whatever the measure.
_PER_KEY = """
WITH ls AS (SELECT pid, flatten(collect_set(array(location))) AS location_set
            FROM (SELECT CAST(pid AS STRING) AS pid, explode(locations) AS location
                  FROM {locations} WHERE {keep}) GROUP BY pid),
     rs AS (SELECT pid, flatten(collect_set(array(interest))) AS interest_set
            FROM (SELECT CAST(pid AS STRING) AS pid, interest FROM {interests} WHERE {keep})
            GROUP BY pid)
SELECT location, interest, {measure}
FROM ls JOIN rs ON ls.pid = rs.pid
LATERAL VIEW explode(location_set) a AS location
LATERAL VIEW explode(interest_set) b AS interest
GROUP BY location, interest"""

MEASURES = {
    "exact": "count(1) AS distinct_count",
    "approx": "approx_count_distinct(xxhash64(ls.pid), {rsd}) AS approx_pid_count",
    "hll": "hll_sketch_agg(CAST(ls.pid AS BINARY), {lg_k}) AS hll_bytes",
}

PAIR_SQL = {name: _PER_KEY.replace("{measure}", measure) for name, measure in MEASURES.items()} | {
    # join-free: one theta sketch per value on each side, intersected per pair
    "theta": """
WITH ls AS (SELECT location, theta_sketch_agg(CAST(pid AS BINARY), {lg_nom}) AS s
            FROM (SELECT CAST(pid AS STRING) AS pid, explode(locations) AS location
                  FROM {locations} WHERE {keep}) GROUP BY location),
     rs AS (SELECT interest, theta_sketch_agg(CAST(CAST(pid AS STRING) AS BINARY), {lg_nom}) AS s
            FROM {interests} WHERE {keep} GROUP BY interest)
SELECT ls.location, rs.interest, intersection_count(ls.s, rs.s) AS set_intersection_count
FROM ls CROSS JOIN rs""",
}

#: Unions of stored sketches (columns ``value`` and ``sketch``), by value.
UNION_SQL = {
    "theta": "SELECT value, estimate_theta(theta_union_agg(sketch, {lg_nom})) AS estimate "
             "FROM {view} GROUP BY value",
    "hll": "SELECT value, estimate_hll(hll_union_agg(sketch, false)) AS estimate "
           "FROM {view} GROUP BY value",
}


def run_union_sql(spark: SparkSession, stored: DataFrame, kind: str, lg_nom: int = 12) -> DataFrame:
    """``(value, estimate)``: stored sketches united per value in SQL."""
    if kind not in UNION_SQL:
        raise ValueError(f"kind must be one of {sorted(UNION_SQL)}")
    register_sql_functions(spark)
    view = f"overlap_stored_{uuid.uuid4().hex[:10]}"
    stored.createOrReplaceTempView(view)
    return spark.sql(UNION_SQL[kind].format(view=view, lg_nom=lg_nom))


def pair_sql(method: str, locations_view: str, interests_view: str, *, rsd: float = 0.05,
             lg_k: int = 13, lg_nom: int = 12) -> str:
    """Spark SQL text of a pair query over two registered views.

    It uses the functions of ``register_sql_functions``.
    """
    if method not in PAIR_SQL:
        raise ValueError(f"method must be one of {sorted(PAIR_SQL)}")
    return PAIR_SQL[method].format(locations=locations_view, interests=interests_view,
                                   keep=_KEEP.format(p="pid"), rsd=rsd, lg_k=lg_k, lg_nom=lg_nom)


def run_pair_sql(spark: SparkSession, locations: DataFrame, interests: DataFrame,
                 method: str, **params) -> DataFrame:
    """Register the two inputs under fresh view names and run ``pair_sql``."""
    register_sql_functions(spark)
    suffix = uuid.uuid4().hex[:10]
    lv, iv = f"overlap_locations_{suffix}", f"overlap_interests_{suffix}"
    locations.createOrReplaceTempView(lv)
    interests.createOrReplaceTempView(iv)
    return spark.sql(pair_sql(method, lv, iv, **params))
