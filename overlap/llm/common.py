"""Helpers shared by the corpus operators: staging, input guards, vectorised word hashing.

Every operator reads whole texts (null counts as empty), selects the columns it needs by
name before anything else (so extra columns, also ones with clashing names, never matter),
and cuts its lineage with :func:`staged`, a Parquet table in the shared folder that the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from overlap.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20
SCREEN_BITS = 1 << 25  # of a broadcast bitmap: half a million words of 64
U64 = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared scratch folder, and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark) -> None:
    """Lets Spark delete shuffle files of finished steps now: it does so once the driver's objects
    for them are collected, which on a driver with much free memory can be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents_of(docs: DataFrame, *cols: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (string) of ``docs``, plus the named further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"),
                       *cols)


def text_hash():
    """A hash of the whole text: with the id it names a row of ``documents``."""
    return F.xxhash64(F.col("text").cast("string"))


def keep_rows(docs: DataFrame, kept: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` occur in ``kept`` (null equals null), one for each key.

    ``kept`` may have a column ``copies``: how often its row is given, 0 or null for never.
    """
    # a struct is never null and its null fields are equal: one exchange by it serves the join and
    # the choice of one row
    copies = F.col("copies") if "copies" in kept.columns else F.lit(1)
    # one type on both sides: else the join casts its key, and the choice needs an exchange of its own
    kind = StructType([StructField(k, kept.schema[k].dataType) for k in keys])
    wanted = (kept.select(F.struct(*[F.col(k).alias(k) for k in keys]).cast(kind).alias("__key"),
                          copies.cast("int").alias("__copies"))
              .groupBy("__key").agg((F.sum if "copies" in kept.columns else F.max)("__copies")
                                    .alias("__copies")))
    order = Window.partitionBy("__key").orderBy(*[F.col(c) for c in docs.columns])
    return (docs.withColumn("__key", F.struct(*[c.alias(k) for k, c in keys.items()]).cast(kind))
            .join(wanted, "__key")
            .withColumn("__nth", F.row_number().over(order)).filter("__nth = 1")
            .filter(F.col("__copies") > 0)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
            .select(*docs.columns))


def screened(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted`` (one column), unmoved.

    All rows with a wanted key stay, and about one in 16 of the others: keys are looked up in a
    broadcast bitmap of their hashes, of ``SCREEN_BITS`` at most. For use before a shuffle of wide rows,
    but not of a semi-join, which Spark would carry out first.
    """
    bits = min(SCREEN_BITS, 1 << (16 * wanted.count() + 63).bit_length())
    place = F.pmod(F.xxhash64(F.lit(5), F.col(key).cast("long")), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(__place % 64 AS INT))")
    words = (wanted.select(F.col(wanted.columns[0]).alias(key)).select(place.alias("__place"))
             .groupBy(F.floor(F.col("__place") / 64).alias("__word")).agg(F.bit_or(one).alias("__bits")))
    return (rows.withColumn("__place", place).withColumn("__word", F.floor(F.col("__place") / 64))
            .join(F.broadcast(words), "__word").filter(F.col("__bits").bitwiseAND(one) != 0)
            .select(*rows.columns))


def held_out(mod: int, rest: int):
    """True where crc32 of the document id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse (mod 2^64), kept for reuse."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _inv = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _BASE_INV)]),
                              dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the (unnormalised) polynomial hash of bytes i..j-1."""
    p, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), equal for equal strings anywhere."""
    _, inv = powers(len(prefix) + 1)
    return mix((prefix[ends] - prefix[starts]) * inv[starts])


def lower_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes of ``text`` with A-Z (and nothing else) lower-cased; null is empty."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of the maximal true runs of a boolean array."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~_SPACE[b])


def letter_words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of runs of ASCII letters and non-ASCII bytes."""
    return runs(_LETTER[b])


def slices(batch: pa.RecordBatch, column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into pieces of about ``size`` bytes of ``column`` (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = np.array([0 if n is None else n for n in
                      pa.compute.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    at = np.cumsum(sizes) // size
    cuts = np.flatnonzero(np.diff(at, prepend=at[0] if len(at) else 0)).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
