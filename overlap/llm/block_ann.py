"""Nearest neighbours of a stated query set by a block matrix join on int8 tiles.

Vectors are packed into blocks. Every candidate block meets every block of queries once: a join
on the query block's number and the candidate block's shard (``SHARD_BLOCKS`` blocks or so), so
a task holds some tiles and not a whole row of the matrix. A tile multiplies int8 codes; the codes' rounding errors
are known norms, so each product bounds the true distance on both sides, and only pairs whose
lower bound reaches the k-th smallest upper bound of their query survive. Survivors are
recomputed in double precision on the original vectors, in component order, and each task
merges its tiles in one heap per query before the last merge.

Very large components are scaled by a power of two, so that no product overflows.
The bounds are those of exact arithmetic, widened by a relative margin for rounding, so no true
neighbour is lost: recall is 1. Vectors that are null, zero, of another length than the most
common one, or hold null or non-finite components take no part. Ties go to the smaller id; a
vec_id that occurs on several rows is a candidate on each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.llm.common import staged

BLOCK_ROWS = 1024
QUERY_BLOCK_ROWS = 1024
SHARD_BLOCKS = 32
MARGIN = 1e-9
SHIFT = 640

_BLOCK = "block long, n int, ids binary, vecs binary"
_HIT = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()),
                  ("score", pa.float64())])


def _pack(rows: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                vecs = part.column("vec").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict(
                    {"block": [base + k], "n": pa.array([len(ids)], pa.int32()),
                     "ids": [ids.tobytes()], "vecs": [vecs.astype(np.float64).tobytes()]})
                k += 1
    return packed


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, exact in products), scale and error norm of each row."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # a row that is zero beside far larger ones
    codes = np.rint(x / scale[:, None])
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, error


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, summed in component order.

    Where the squares overflow, they are summed at a lower power of two.
    """
    def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        with np.errstate(over="ignore"):
            for j in range(a.shape[1]):
                d = a[:, j] - b[:, j]
                total += d * d
        return np.sqrt(total)

    out = summed(a, b)
    far = np.flatnonzero(np.isinf(out))
    if len(far):
        with np.errstate(over="ignore"):
            out[far] = np.ldexp(summed(np.ldexp(a[far], -SHIFT), np.ldexp(b[far], -SHIFT)), SHIFT)
    return out


def _tame(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides at one lower power of two, where products would overflow."""
    if max(np.abs(q).max(), np.abs(c).max()) < 2.0 ** 400:
        return q, c
    return np.ldexp(q, -SHIFT), np.ldexp(c, -SHIFT)


def _tile(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) of a tile that may be among a query's k nearest."""
    qc, qs, qe = _codes(q)
    cc, cs, ce = _codes(c)
    dot = (qc.astype(np.float32) @ cc.astype(np.float32).T).astype(np.float64)
    qn = (qc.astype(np.float64) ** 2).sum(axis=1) * qs ** 2
    cn = (cc.astype(np.float64) ** 2).sum(axis=1) * cs ** 2
    near = np.sqrt(np.maximum(qn[:, None] + cn[None, :] - 2 * dot * np.outer(qs, cs), 0))
    slack = qe[:, None] + ce[None, :]
    slack += MARGIN * (np.sqrt(qn)[:, None] + np.sqrt(cn)[None, :] + slack)
    # sqrt of a rounded difference of squares: its own error near zero
    slack += np.sqrt(1e-15 * (qn[:, None] + cn[None, :]))
    upper = np.where(own, np.inf, near + slack)
    if upper.shape[1] > k:
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1]
    else:
        limit = np.full(len(q), np.inf)
    return np.nonzero((near - slack <= limit[:, None]) & ~own)


def _search(k: int, dim: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                qi = np.frombuffer(row["q_ids"], dtype=np.int64)
                ci = np.frombuffer(row["ids"], dtype=np.int64)
                q = np.frombuffer(row["q_vecs"]).reshape(-1, dim)
                c = np.frombuffer(row["vecs"]).reshape(-1, dim)
                at, to = _tile(*_tame(q, c), qi[:, None] == ci[None, :], k)
                score = _exact(q[at], c[to])
                order = np.lexsort((ci[to], score, at))
                at, to, score = at[order], to[order], score[order]
                first = np.searchsorted(at, at)
                keep = np.arange(len(at)) - first < k
                for a, t, s in zip(at[keep].tolist(), to[keep].tolist(), score[keep].tolist()):
                    heap = heaps.setdefault((row["q_block"], a), [])
                    item = (-s, -int(ci[t]), int(qi[a]))
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
        rows = [(q, (b << 12) + a, -v, -s) for (b, a), h in heaps.items() for s, v, q in h]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _HIT)], schema=_HIT)
    return search


def block_neighbours(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row with vec_id % every = 0."""
    spark = embeddings.sparkSession
    vec = F.col("embedding").cast("array<double>")
    sound = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0))
    sound = staged(sound.withColumn("dim", F.size("vec")), "ann-vectors")
    dims = sound.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    dim = dims[0]["dim"]
    sound = sound.filter(F.col("dim") == dim).select("vec_id", "vec")
    queries = sound.filter(F.col("vec_id") % every == 0)
    parts = -(-queries.count() // QUERY_BLOCK_ROWS)
    if not parts:
        return empty
    asked = staged(queries.repartition(parts, "vec_id").mapInArrow(_pack(QUERY_BLOCK_ROWS), _BLOCK)
                   .select("block", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")),
                   "ann-queries")
    # query blocks get dense numbers (one number for up to QUERY_BLOCK_ROWS queries)
    shards = -(-sound.count() // (BLOCK_ROWS * SHARD_BLOCKS))
    blocks = sound.mapInArrow(_pack(BLOCK_ROWS), _BLOCK).withColumn(
        "shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    numbers = {r["block"]: i for i, r in enumerate(asked.select("block").sort("block").collect())}
    dense = spark.createDataFrame(list(numbers.items()), "block long, q_block long")
    tiles = (blocks.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(len(numbers) - 1))
                                                    .cast("array<long>")))
             .join(asked.join(dense, "block").drop("block").withColumn("shard", F.explode(F.sequence(
                 F.lit(0), F.lit(shards - 1)).cast("array<long>"))), ["q_block", "shard"])
             .select("q_block", "q_ids", "q_vecs", "ids", "vecs"))
    hits = tiles.mapInArrow(_search(k, dim), "query_id long, query_row long, vec_id long, score double")
    best = (hits.groupBy("query_id", "query_row").agg(F.slice(F.array_sort(F.collect_list(
        F.struct("score", "vec_id"))), 1, k).alias("best")))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op9_block_matrix_ann(spark, sf_dir: str) -> DataFrame:
    return block_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(
                     list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])),
                     lambda a, b: a + b)) AS score
           FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT query_id, vec_id, score,
                  row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
