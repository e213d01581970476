"""Exact deduplication by a distributed content sort.

Texts are normalised (A-Z lower-cased, null is empty), range-partitioned by sampled splitters
over (first bytes, hash, document id), sorted on disk within each partition, and every row is
compared in full with its neighbour. The splitters hold a short prefix and a hash, never a
whole text, and the document id is part of the range key: a group of copies that holds a third
of all rows is spread over many partitions. Runs that touch a partition's edge (two for each
partition) are compared across partitions by their whole text and joined up.

Defined cases: a null text equals an empty one; rows with a null id count in their group but
lose to any id; of rows repeated with the same largest id exactly one is kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.llm.common import documents_of, slices, staged

HEAD_BYTES = 24
EMIT_ROWS = 50_000

_RUN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("head_row", pa.bool_()),
                         ("keep_id", pa.int64()), ("group_size", pa.int64()),
                         ("text_sha256", pa.string()), ("edge", pa.bool_()),
                         ("edge_body", pa.binary())])


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), body], ["doc_id", "body"])


class _Out:
    """Collects finished runs and hands them out in record batches of bounded size."""

    def __init__(self) -> None:
        self.cols: list[list] = [[] for _ in _RUN_SCHEMA]

    def add(self, run: int, body: bytes, ids: list, edge: bool) -> None:
        n = len(ids)
        sha = hashlib.sha256(body).hexdigest()
        for col, values in zip(self.cols, (ids, [run] * n, [True] + [False] * (n - 1),
                                           [ids[0]] * n, [n] * n, [sha] * n, [edge] * n,
                                           [body if edge else None] + [None] * (n - 1))):
            col.extend(values)

    def flush(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.cols, _RUN_SCHEMA)]
        self.cols = [[] for _ in _RUN_SCHEMA]
        return pa.RecordBatch.from_arrays(arrays, schema=_RUN_SCHEMA)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition. Only ids of the open run are held."""
    base, k = TaskContext.get().partitionId() << 32, 0
    out, body, ids = _Out(), None, []
    for big in batches:
        for batch in slices(big, "body"):
            for doc_id, here in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("body").to_pylist()):
                if here == body:
                    ids.append(doc_id)
                    continue
                if body is not None:
                    out.add(base + k, body, ids, edge=k == 0)
                    k += 1
                    if len(out.cols[0]) >= EMIT_ROWS:
                        yield out.flush()
                body, ids = here, [doc_id]
    if body is not None:
        out.add(base + k, body, ids, edge=True)
        yield out.flush()


def content_sort_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    body = documents_of(docs).mapInArrow(_normalise, "doc_id long, body binary")
    keyed = body.select("doc_id", "body", F.substring("body", 1, HEAD_BYTES).alias("head"),
                        F.xxhash64("body").alias("h"))
    ranged = (keyed.repartitionByRange("head", "h", F.col("doc_id").desc())
              .sortWithinPartitions("head", "h", "body", F.col("doc_id").desc())
              .select("doc_id", "body"))
    rows = staged(ranged.mapInArrow(
        _neighbours, "doc_id long, run long, head_row boolean, keep_id long, group_size long, "
        "text_sha256 string, edge boolean, edge_body binary"), "content-sort")
    # two edge runs for each partition at most; whole texts are compared here
    whole = (rows.filter(F.col("edge_body").isNotNull())
             .groupBy("edge_body").agg(F.max("keep_id").alias("keep_id"),
                                       F.sum("group_size").alias("group_size"),
                                       F.min("run").alias("first_run"),
                                       F.collect_list("run").alias("parts"))
             .select("keep_id", "group_size", "first_run", F.explode("parts").alias("run")))
    inner = rows.filter(~F.col("edge")).select(
        "doc_id", "keep_id", "group_size", F.col("head_row").alias("kept"), "text_sha256")
    edges = (rows.filter("edge").select("doc_id", "run", "head_row", "text_sha256")
             .join(whole, "run")
             .select("doc_id", "keep_id", "group_size",
                     (F.col("head_row") & (F.col("run") == F.col("first_run"))).alias("kept"),
                     "text_sha256"))
    return inner.unionByName(edges)


def op5_content_sort_dedup(spark, sf_dir: str) -> DataFrame:
    return content_sort_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d
"""
