"""N-gram Jaccard join with a token-group matrix.

Texts become sets of hashed word shingles; equal sets are one node. The join finds every pair
of nodes with ``100 * |intersection| >= percent * |union|`` that matters for the components:

1. Candidates. Sizes fall into classes whose bounds grow by 100/percent, so linked nodes are in
   the same or neighbouring classes. For a class, the shingle universe is cut by hash into more
   segments than two linked sets can differ in shingles; so they agree in a whole segment.
   A node's signature is a segment with the hash of its shingles there; equal signatures meet.
   (A node whose filled segments are so few that an agreed one could be empty adds signatures
   under further hashes, and at last one shared by all such nodes: no link is lost.)
2. Groups. Each node is checked against the least document of its buckets, first by the low 16 bits
   of its shingles, whose overlap bounds that of the sets, and where that could do by the sets; the
   components of the links found, and what is left around each least document, partition the nodes
   into groups of similar documents.
3. Rare shingles. Only nodes of buckets that hold several components can be linked further. Of linked
   sets, at most (100 - percent) percent of either's shingles are not in the other; so a node with more
   shingles that no other such node has is linked with none, and is settled (half of the universe
   settles most nodes; the whole is counted for the rest). Of the others, in the
   order from the rarest shingle to the most frequent, linked sets share one among the first
   |set| - least overlap + 1 of each: groups meet by those shingles alone, and not by what all copies
   of a frequent text share.
4. Matrix. Groups (of about ``CHUNK`` nodes) store the union of their shingles. Two groups that
   share a rare shingle meet in one row. Each node of one counts its overlap with the union of the
   other; only where that could hold a partner is the group opened, and its nodes are compared.
   Pairs within a component add nothing to it and are skipped; no row is made for a pair of nodes.

A frequent passage alone makes no candidates, as whole segments must agree. Shingles, sets and
signatures are 64-bit hashes.

Defined cases: a null text or one without words is an empty set and linked with nothing; with
fewer words than a shingle has, the sequence is one shingle; documents with equal sets are
linked; rows with a null id link with nothing and have a null component; repeated rows get the same component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlap.llm.common import (documents_of, lower_bytes, mix, prefix_hash, release, screened, slices,
                                span_hash, staged, text_hash, words_of)
from overlap.llm.components import components

CHUNK = 32
SEEDS = 4
_SHIFT = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9F4B, 0xD1342543DE82EF95,
                                 0xA0761D6478BD642F)]


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles."""
    b = lower_bytes(text)
    starts, ends = words_of(b)
    if not len(starts):
        return np.zeros(0, np.uint64)
    w = span_hash(prefix_hash(b), starts, ends)
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        h = mix(h * _SHIFT[0] + w[j:len(w) - n + 1 + j])
    return np.unique(h)


def size_classes(most: int, percent: int) -> list[tuple[int, int, int]]:
    """(least size, differences of a linked pair at most, segments) of each class up to size most.

    A pair belongs to the class of its smaller set.
    """
    out, low = [], 1
    while low <= most:
        high = low * 100 // percent + 1
        a, b = high - 1, (high - 1) * 100 // percent
        differ = (a + b) * (100 - percent) // (100 + percent)
        segments = differ + 1
        for _ in range(3):  # room for segments that are empty by chance
            empty = segments * np.exp(-low / segments)
            segments = differ + 1 + (int(np.ceil(empty + 2.5 * np.sqrt(empty) + 1)) if differ else 0)
        out.append((low, differ, segments))
        low = high
    return out


def _class_signatures(tokens: np.ndarray, k: int, differ: int, segments: int) -> list[np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for seed in range(SEEDS):
            key = mix(np.array([k * SEEDS + seed], dtype=np.uint64) * _SHIFT[1] + _SHIFT[2])[0]
            h = mix(tokens ^ key)
            at = (h % np.uint64(segments)).astype(np.int64)
            total = np.zeros(segments, np.uint64)
            np.add.at(total, at, mix(h + _SHIFT[3]))
            filled = np.flatnonzero(np.bincount(at, minlength=segments))
            out.append(mix(mix(total[filled] + key) ^ (filled.astype(np.uint64) * _SHIFT[1])))
            if len(filled) > differ:  # an agreed segment is filled
                return out
        out.append(mix(np.array([k], dtype=np.uint64) + _SHIFT[3]))
    return out


class _Classes:
    def __init__(self, percent: int) -> None:
        self.percent, self.rows = percent, size_classes(1 << 12, percent)

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if not n:
            return tokens
        if self.rows[-1][0] <= n:
            self.rows = size_classes(2 * n, self.percent)
        k = next(i for i in range(len(self.rows) - 1, -1, -1) if self.rows[i][0] <= n)
        return np.unique(np.concatenate([s for i in (k, k - 1) if i >= 0 for s in _class_signatures(
            tokens, i, *self.rows[i][1:])]))


def _node(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        h = np.array([len(tokens)], np.uint64) * _SHIFT[0] + mix(tokens ^ _SHIFT[2]).sum(dtype=np.uint64)
    return int(mix(h).view(np.int64)[0])


def _rows(width: int, percent: int, signatures: bool):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(percent)
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                nodes = pa.array([_node(s) if len(s) else None for s in sets], pa.int64())
                if not signatures:
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"),
                        "node": nodes,
                        "n": pa.array([len(s) for s in sets], pa.int32())})
                    continue
                sigs = {node: classes.signatures(s) for node, s in zip(nodes.to_pylist(), sets)
                        if node is not None}
                if not sigs:
                    continue
                flat = np.concatenate(list(sigs.values())).view(np.int64)
                owner = np.repeat(np.array(list(sigs), np.int64), [len(s) for s in sigs.values()])
                for lo in range(0, len(flat), 1 << 18):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(flat[lo:lo + (1 << 18)]), pa.array(owner[lo:lo + (1 << 18)])],
                        ["sig", "node"])
    return made


def _sets(width: int):
    """node, n, the set's tokens in order, and the distinct low 16 bits of them."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, width).view(np.int64) for t in part.column("text").to_pylist()]
                low = [np.unique(s.astype(np.int16)) for s in sets]
                nodes = [_node(s.view(np.uint64)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                     _lists(sets, np.int64), _lists(low, np.int16)], ["node", "n", "tokens", "low"])
    return made


def _lists(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *[len(s) for s in rows]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, kind)])))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, by: str = "tokens") -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough; by ``low``, those that could be.

    Of the shared shingles, as many as either set has beyond its distinct low bits may share theirs.
    """
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col(by).alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col(by).alias("tb"))
    spare = F.least(F.col("na") - F.size("ta"), F.col("nb") - F.size("tb"))
    both = (F.size(F.array_intersect("ta", "tb")) + spare).cast("long")
    total = (F.col("na") + F.col("nb")).cast("long")
    least, most = F.least("na", "nb").cast("long"), F.greatest("na", "nb").cast("long")
    return (pairs.join(one, "a").join(two, "b").filter(100 * least >= percent * most)
            .filter(100 * both >= percent * (total - both)).select("a", "b"))


def _members(groups: DataFrame) -> DataFrame:
    """g, component, node: similar nodes (one label) cut into groups of about CHUNK by hash."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    return (groups.join(sizes, "label")
            .withColumn("slot", F.pmod(F.xxhash64(F.lit(3), "node"),
                                       1 + F.floor(F.col("size") / CHUNK)))
            .select("component", "node", F.xxhash64("label", "slot").alias("g")))


def _open(percent: int):
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between the groups of each row: a query's overlap with the other group's union
        bounds that with its members; only queries that reach it are compared with them."""
        for batch in batches:
            a, b = [], []
            for one, two in zip(batch.column("one"), batch.column("two")):
                (nx, cx, tx, ox), (ny, cy, ty, oy) = _unpacked(one), _unpacked(two)
                union, codes = np.unique(ty, return_inverse=True)
                sizes = np.diff(oy)
                for i in range(len(nx)):
                    x = tx[ox[i]:ox[i + 1]]
                    at = np.minimum(np.searchsorted(union, x), len(union) - 1)
                    at = at[union[at] == x]
                    if 100 * len(at) < percent * len(x):
                        continue
                    mark = np.zeros(len(union), dtype=np.int64)
                    mark[at] = 1
                    both = np.add.reduceat(mark[codes], oy[:-1])
                    hit = (cy != cx[i]) & (100 * both >= percent * (len(x) + sizes - both))
                    found = np.flatnonzero(hit)
                    # one link to each component will do
                    found = found[np.unique(cy[found], return_index=True)[1]]
                    a.extend([int(nx[i])] * len(found))
                    b.extend(ny[found].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return opened


def _unpacked(group: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, components, all tokens, and where each node's tokens start."""
    rows = group.values
    tokens = rows.field("tokens")
    lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
    return (rows.field("node").to_numpy(zero_copy_only=False),
            rows.field("component").to_numpy(zero_copy_only=False),
            tokens.flatten().to_numpy(zero_copy_only=False),
            np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))


def _mixed_nodes(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """node: those of buckets with nodes of several components."""
    placed = buckets.select("sig", "node").join(groups.select("node", "component"), "node")
    mixed = placed.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return buckets.select("sig", "node").join(mixed.filter("least < most").select("sig"), "sig").select(
        "node").distinct()


def _undecided(nodes: DataFrame, sets: DataFrame, percent: int, half: bool) -> DataFrame:
    """The nodes that could be linked with another of ``nodes``, by their shingles that occur once.

    ``half`` counts those of one half of the universe: fewer, so it settles fewer nodes and none wrongly.
    """
    # sets stay where they are: a few other nodes among them make shingles only less rare
    near = screened(sets, "node", nodes)
    own = near.select("node", F.size("tokens").cast("long").alias("size")).join(nodes, "node")
    tokens = near.select("node", F.explode("tokens").alias("token"))
    if half:
        tokens = tokens.filter(F.col("token").bitwiseAND(F.lit(1)) == 0)
    lone = (tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node"))
            .filter("times = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone")))
    return (own.select("node", "size").join(lone, "node", "left")
            .filter(100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("size"))
            .select("node").distinct())


def _rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sig, node: the rarest shingles of each node, as many as linked sets share one of."""
    own = screened(sets, "node", nodes).join(nodes, "node").select("node", "tokens").dropDuplicates(["node"])
    tokens = own.select("node", F.explode("tokens").alias("sig"))
    often = tokens.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("n", "sig"))
    size = F.size("tokens").cast("long")
    prefix = own.select("node", (size - F.ceil(size * percent / 100) + 1).alias("prefix"))
    return (tokens.join(often, "sig").withColumn("nth", rank).join(prefix, "node")
            .filter((F.col("nth") <= F.col("prefix")) & (F.col("n") > 1)).select("sig", "node"))


def _matrix_links(buckets: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, by way of the token-group matrix.

    ``groups`` has node, component and label: nodes of a label are similar.
    """
    spark = buckets.sparkSession
    nodes = staged(_mixed_nodes(buckets, groups), "mixed-nodes")
    for half in (True, False):
        nodes = staged(_undecided(nodes, sets, percent, half), "undecided")
        release(spark)
    members = staged(_members(groups.join(nodes, "node")), "group-members")
    placed = (_rare_shingles(nodes, sets, percent).join(members, "node").groupBy("sig", "g")
              .agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    placed = staged(placed, "rare-shingles")
    release(spark)
    mixed = placed.groupBy("sig").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    placed = placed.join(mixed.filter("least < most").select("sig"), "sig")
    one, two = (placed.select("sig", *[F.col(c).alias(f"{c}{k}") for c in ("g", "lo", "hi")])
                for k in (1, 2))
    # pairs of groups that share a rare shingle, not of their nodes
    asked = (one.join(two, "sig").filter("g1 <= g2 AND (lo1 < hi1 OR lo2 < hi2 OR lo1 <> lo2)")
             .select("g1", "g2").distinct())
    asked = staged(asked, "group-pairs")
    met = asked.select(F.explode(F.array("g1", "g2")).alias("g")).distinct()
    members = staged(members.join(met, "g", "left_semi"), "met-members")
    opened = screened(sets, "node", members.select("node")).select("node", "tokens")
    packed = staged(members.join(opened, "node").groupBy("g")  # CHUNK sets
                    .agg(F.collect_list(F.struct("node", "component", "tokens")).alias("rows")), "groups")
    return (asked.join(packed.select(F.col("g").alias("g1"), F.col("rows").alias("one")), "g1")
            .join(packed.select(F.col("g").alias("g2"), F.col("rows").alias("two")), "g2")
            .select("one", "two").mapInArrow(_open(percent), "a long, b long").distinct())


def _buckets(d: DataFrame, width: int, percent: int) -> DataFrame:
    """sig, node: the nodes that share a signature with another node."""
    signed = d.mapInArrow(_rows(width, percent, True), "sig long, node long")
    by_node = Window.partitionBy("sig").orderBy("node")  # neighbours only, no group in memory
    once = (signed.withColumn("prev", F.lag("node").over(by_node))
            .filter(F.col("prev").isNull() | (F.col("prev") != F.col("node"))).select("sig", "node"))
    return (once.withColumns({"prev": F.lag("node").over(by_node), "next": F.lead("node").over(by_node)})
            .filter(F.col("prev").isNotNull() | F.col("next").isNotNull()).select("sig", "node"))


def ngram_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (and the text's hash) for every row of ``docs``."""
    release(docs.sparkSession)  # of whatever ran before, a stage of a pipeline for instance
    d = documents_of(docs)
    named = d.filter(F.col("doc_id").isNotNull())
    rows = staged(d.withColumn("text_hash", text_hash()).mapInArrow(
        _rows(width, percent, False), "doc_id long, text_hash long, node long, n int"), "shingle-rows")
    reps = (rows.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("node").agg(F.min("doc_id").alias("rep")))
    buckets = staged(_buckets(named, width, percent).join(reps, "node"), "buckets")
    release(docs.sparkSession)
    wanted = staged(buckets.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = staged(screened(named, "doc_id", wanted).join(wanted, "doc_id").select(*named.columns).mapInArrow(
        _sets(width), "node long, n int, tokens array<long>, low array<smallint>"), "token-sets")
    # groups: every node against the least document of its buckets
    least = F.first("node").over(Window.partitionBy("sig").orderBy("rep", "node"))
    stars = (buckets.withColumn("b", least).filter(F.col("node") != F.col("b"))
             .select(F.col("node").alias("a"), "b").distinct())
    stars = staged(stars, "stars")
    close = staged(_linked(stars, sets, percent, "low"), "close-stars")
    release(docs.sparkSession)
    met = screened(sets, "node", close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = staged(_linked(close, met, percent), "star-links")
    release(docs.sparkSession)
    # similar: a component of links, or what else is left around one least document
    near = buckets.select("node").distinct().join(components(links), "node", "left").join(
        stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("center")), "node", "left")
    groups = staged(near.select(
        "node", F.coalesce("component", "node").alias("component"),
        F.xxhash64(F.col("component").isNull(), F.coalesce("component", "center", "node")).alias("label")),
        "groups")
    across = _matrix_links(buckets, groups, sets, percent)
    joined = components(links.unionByName(across))
    labels = reps.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_doc = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = labels.join(least_doc, "component").select("node", "component_id")
    return rows.join(labels, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        "text_hash")


def op4_token_groups(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
           WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 2),
                lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])
           END) AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents
      UNION SELECT p.b AS node, r.root FROM r JOIN p ON r.node = p.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""
