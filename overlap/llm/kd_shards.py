"""Sharding by a k-d tree over document metadata, with equal bytes in every leaf.

A point is (text bytes + 16, CRC-32 of the text). A node that must hold ``n`` shards is split
at the weighted quantile ``floor(n/2)/n`` of its bytes along its widest dimension, until each
leaf is one shard of the target bytes. All nodes of a level are searched together: each pass
sums bytes in a bounded number of bins per node (a map-side aggregate) and the crossing bin
becomes the next pass's range, so only node x bins sums reach the driver, whatever the table's
size. Ties are ordered below the coordinate: rows of one size by a hash of the CRC-32, then of the id.
So equal texts lie together, and a cut parts only the groups of the one (size, hash) it falls into;
a group as large as a shard can be cut, as the law asks.

Law: ``bytes``. Defined cases: a null text has size 16 and CRC 0; a null id hashes like any
value; repeated rows keep separate slots; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlap.llm.common import documents_of, staged

ROW_BYTES = 16
BIN_BITS = 12
TIE_BITS = 31
ID_BITS = 12  # of them, below the hash of the text
DIMS = ("k_size", "k_crc")


def _points(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents_of(docs).select(
        "doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    tie = F.xxhash64(F.lit(7), "doc_id").bitwiseAND((1 << TIE_BITS) - 1)
    group = F.xxhash64(F.lit(13), "text_crc32").bitwiseAND((1 << (TIE_BITS - ID_BITS)) - 1)
    within = F.shiftleft(group, ID_BITS) + tie.bitwiseAND((1 << ID_BITS) - 1)
    return d.withColumns({"k_size": F.shiftleft("size", TIE_BITS) + within,
                          "k_crc": F.shiftleft("text_crc32", TIE_BITS) + tie})


def _node_column(tree: dict[int, tuple[str, int]], node: int = 1):
    """The node of a row: tree maps an inner node to (dimension, first key of its right side)."""
    if node not in tree:
        return F.when(F.col("size").isNotNull(), F.lit(node))
    dim, key = tree[node]
    return F.when(F.col(dim) < key, _node_column(tree, 2 * node)).otherwise(
        _node_column(tree, 2 * node + 1))


def _split_keys(points: DataFrame, want: dict[int, tuple[str, int, int, float]],
                slack: float) -> dict[int, int]:
    """For node -> (dimension, least key, largest key, bytes wanted on the left): first key of
    the right side, exact to ``slack`` bytes or to one key."""
    open_ = {n: {"dim": d, "lo": lo, "hi": hi, "want": w} for n, (d, lo, hi, w) in want.items()}
    found: dict[int, int] = {}
    while open_:
        shift = {n: max(0, (s["hi"] - s["lo"]).bit_length() - BIN_BITS) for n, s in open_.items()}
        search = points.sparkSession.createDataFrame(
            [(n, DIMS.index(s["dim"]), s["lo"], s["hi"], shift[n]) for n, s in open_.items()],
            "node int, dim int, lo long, hi long, shift int")
        sums: dict[int, dict[int, int]] = {}
        binned = (points.join(F.broadcast(search), "node")  # a row for each open node
                  .withColumn("key", F.when(F.col("dim") == 0, F.col(DIMS[0]))
                              .otherwise(F.col(DIMS[1])))
                  .filter(F.col("key").between(F.col("lo"), F.col("hi")))
                  .withColumn("bin", F.expr("shiftright(key - lo, shift)"))
                  .groupBy("node", "bin").agg(F.sum("size").alias("w")))
        for r in binned.collect():  # nodes x 2^BIN_BITS sums at most
            sums.setdefault(r["node"], {})[r["bin"]] = r["w"]
        for n, s in list(open_.items()):
            left = 0.0
            for b, w in sorted(sums.get(n, {}).items()):
                if left + w >= s["want"]:
                    break
                left += w
            else:  # nothing more to the right
                found[n] = s["hi"] + 1
                del open_[n]
                continue
            start = s["lo"] + (b << shift[n])
            if shift[n] == 0 or w <= slack:
                nearer = s["want"] - left <= left + w - s["want"]
                found[n] = start if nearer else start + (1 << shift[n])
                del open_[n]
            else:
                s.update(lo=start, hi=min(s["hi"], start + (1 << shift[n]) - 1),
                         want=s["want"] - left)
    return found


def _grow(points: DataFrame, shards: int) -> tuple[dict[int, tuple[str, int]], dict[int, int]]:
    """The tree, and the first shard of each leaf."""
    tree: dict[int, tuple[str, int]] = {}
    first, many = {1: 0}, {1: shards}
    spans: dict[str, int] | None = None
    while any(n > 1 for n in many.values()):
        noded = points.withColumn("node", _node_column(tree))
        active = [n for n, k in many.items() if k > 1]
        stats = (noded.filter(F.col("node").isin(active)).groupBy("node")
                 .agg(F.sum("size").alias("w"), *[f(d).alias(f"{d}_{f.__name__}")
                                                  for d in DIMS for f in (F.min, F.max)]).collect())
        if not stats:
            break
        if spans is None:
            spans = {d: max(1, stats[0][f"{d}_max"] - stats[0][f"{d}_min"]) for d in DIMS}
        want = {}
        for r in stats:
            n = r["node"]
            dim = max(DIMS, key=lambda d: (r[f"{d}_max"] - r[f"{d}_min"]) / spans[d])
            want[n] = (dim, r[f"{dim}_min"], r[f"{dim}_max"],
                       r["w"] * (many[n] // 2) / many[n])
        target = sum(r["w"] for r in stats) / sum(many[n] for n in want)
        keys = _split_keys(noded, want, slack=target / 10_000)
        for n in active:
            k, f = many.pop(n), first.pop(n)
            if n in keys:
                tree[n] = (want[n][0], keys[n])
                many[2 * n], first[2 * n] = k // 2, f
                many[2 * n + 1], first[2 * n + 1] = k - k // 2, f + k // 2
            else:  # no rows below
                many[n], first[n] = 1, f
    return tree, first


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    points = staged(_points(docs), "kd-points")
    tree, first = _grow(points, shards)
    leaves = docs.sparkSession.createDataFrame(list(first.items()), "node int, shard int")
    placed = (points.withColumn("node", _node_column(tree)).join(F.broadcast(leaves), "node")
              .select("doc_id", "size", "text_crc32", "shard"))
    # slots: rows are laid out by (shard, id) over ranges; a row's place is its range's offset
    # within the shard plus its place in the range, so no shard is gathered in one task
    laid = staged(placed.repartitionByRange("shard", "doc_id", "text_crc32")
                  .sortWithinPartitions("shard", "doc_id", "text_crc32")
                  .withColumn("at", F.monotonically_increasing_id())
                  .withColumn("part", F.shiftright("at", 33)), "kd-laid")
    offsets = (laid.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("at").alias("base"))
               .withColumn("before", F.coalesce(F.sum("n").over(
                   Window.partitionBy("shard").orderBy("part")
                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # one row for each (range, shard): ranges + shards rows
    return laid.join(offsets.drop("n"), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("at") - F.col("base")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op6_kd_shards(spark, sf_dir: str) -> DataFrame:
    return kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
