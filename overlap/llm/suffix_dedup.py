"""Removal of repeated passages by a sparse suffix sort (deep-shallow).

A byte goes if a ``length``-byte string over it also starts earlier (in a document with a
smaller id, or earlier in the same one). Strings are judged on the input.

1. Anchors. Every window of ``length`` bytes names one of its k-byte strings, the one with the
   least hash (the leftmost of equals). Equal windows name it at the same offset, so only the
   suffixes that start at named places, one in about forty, need sorting; each stands for a run
   of windows. An anchor whose hash occurs once holds no repeated window.
2. Contexts. Anchors that recur send the bytes that their windows cover. Equal contexts of a
   task are settled there and sent once.
3. Sort. Ranges of anchor hashes are sorted on disk; a task orders its suffixes (and, reversed,
   what lies before the anchors) by deep-shallow sorting: multikey quicksort on 8-byte symbols
   down to a shallow depth, then a blind trie for each group that is still tied. Neighbours'
   common prefixes then tell, offset by offset, which windows are equal; the first in document
   order stays. All comparisons are of bytes; hashes only bring candidates together.
4. Removal. Covered ranges return to their documents, where they are joined and cut out.

The text is exchanged once by id, for all three steps that read it. Defined cases: a null text
is empty; a text shorter than the window keeps all bytes; a null id is later than any other;
repeated rows of an id are separate documents in the order of their texts; a range that is cut
may leave a part of a character; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlap.llm.common import mix, powers, prefix_hash, slices

LENGTH = 100
GRAM = 20
SHALLOW = 32
SEGMENT = 4 << 20
CLASS_ROWS = 60_000
_BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (block-wise prefix and suffix minima)."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1:width - 1 + m])


def anchors_of(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(hash, place, first window, last window) of the anchors of a text, place by place."""
    parts = []
    for lo in range(0, max(1, len(text) - length + 1), SEGMENT):
        b = np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - lo), lo)
        if len(b) < length:
            break
        p = prefix_hash(b)
        n = len(b) - gram + 1
        h = mix((p[gram:] - p[:n]) * powers(n + 1)[1][:n])
        keyed = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
        at = (_least(keyed, length - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        parts.append((h[at[first]], at[first] + lo, first + lo, last + lo))
    if not parts:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor hash of a document once, or twice if it recurs there."""
    for batch in batches:
        for part in slices(batch):
            hashes, owners = [], []
            for did, text in zip(part.column("did").to_pylist(), part.column("text").to_pylist()):
                h, n = np.unique(anchors_of(text)[0], return_counts=True)
                h = np.concatenate([h, h[n > 1]])
                hashes.append(h)
                owners.append(np.full(len(h), did, np.int64))
            flat, of = np.concatenate(hashes).view(np.int64), np.concatenate(owners)
            for lo in range(0, len(flat), 1 << 18):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[lo:lo + (1 << 18)]), pa.array(of[lo:lo + (1 << 18)])], ["h", "did"])


#: did, dup: the document. A range of removed bytes has hash null; a context has the anchor's
#: place and how many bytes of it lie before the anchor.
_PIECE = pa.schema([("h", pa.int64()), ("spread", pa.int64()), ("did", pa.int64()), ("dup", pa.int32()),
                    ("start", pa.int64()), ("end", pa.int64()), ("before", pa.int32()), ("context", pa.binary())])
_PIECE_SQL = "h long, spread long, did long, dup int, start long, end long, before int, context binary"


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the recurring anchors; of equal ones in a slice the first, and ranges for the rest."""
    for batch in batches:
        for part in slices(batch):
            first: dict[tuple, tuple] = {}
            gone: list[tuple] = []
            for did, dup, text, again in zip(*(part.column(c).to_pylist() for c in (
                    "did", "dup", "text")), part.column("again")):
                if not again.is_valid:
                    continue
                h, place, lo, hi = anchors_of(text)
                known = np.sort(again.values.to_numpy(zero_copy_only=False))
                signed = h.view(np.int64)
                at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
                hit = np.flatnonzero(known[at] == signed)
                for x, a, s, e in zip(signed[hit].tolist(), place[hit].tolist(), lo[hit].tolist(),
                                      (hi[hit] + LENGTH).tolist()):
                    key = (x, a - s, text[s:e])
                    where = (did, dup, s, e)
                    was = first.get(key)
                    if was is None or where < was:
                        first[key] = where
                        where = was
                    if where is not None:
                        gone.append(where)
            rows = [(x, x, *w, b, c) for (x, b, c), w in first.items()]
            # finished ranges travel along, spread by document
            rows += [(None, (d * 0x9E3779B1 + s) % (1 << 61), d, u, s, e, None, None) for d, u, s, e in _joined(gone)]
            for at in range(0, len(rows), 1 << 15):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + (1 << 15)]), _PIECE)],
                    schema=_PIECE)


def _joined(ranges: list[tuple]) -> Iterator[tuple]:
    """Overlapping or touching ranges (did, dup, start, end) made one."""
    here = None
    for r in sorted(ranges):
        if here is not None and r[:2] == here[:2] and r[2] <= here[3]:
            here = (*here[:3], max(here[3], r[3]))
            continue
        if here is not None:
            yield here
        here = r
    if here is not None:
        yield here


def _common(a: bytes, b: bytes, most: int) -> int:
    """Length of the common prefix of a and b, at most ``most``."""
    n = min(len(a), len(b), most)
    x, y = a[:n], b[:n]
    if x == y:
        return n
    z = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (z.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], most: int) -> tuple[list[int], list[int]]:
    """Sorted order of the strings (equal ones by place) and common prefixes of neighbours.

    A Patricia trie that knows only branching depths and symbols: a string walks down blindly
    to some leaf, one comparison with that leaf tells the depth at which it branches off.
    """
    symbol = lambda s, d: s[d] + 1 if d < len(s) else 0  # noqa: E731  the end sorts first
    root: list | None = None  # inner node: [depth, {symbol: child}]; leaf: [None, places]
    for i, s in enumerate(strings):
        if root is None:
            root = [None, [i]]
            continue
        node = root
        while node[0] is not None:
            below = node[1]
            node = below.get(symbol(s, node[0])) or next(iter(below.values()))
        leaf = strings[node[1][0]]
        depth = _common(s, leaf, most)
        if depth >= most or depth == len(s) == len(leaf):
            node[1].append(i)
            continue
        parent, node = None, root
        while node[0] is not None and node[0] < depth:
            parent, node = node, node[1][symbol(s, node[0])]
        if node[0] == depth:
            node[1][symbol(s, depth)] = [None, [i]]
            continue
        fork = [depth, {symbol(leaf, depth): node, symbol(s, depth): [None, [i]]}]
        if parent is None:
            root = fork
        else:
            parent[1][symbol(s, parent[0])] = fork
    order, common = [], []
    todo = [(root, 0)]
    while todo:  # in order; with a child the depth at which it leaves its left neighbour
        node, depth = todo.pop()
        if node[0] is None:
            order.extend(node[1])
            common.extend([depth] + [min(most, len(strings[node[1][0]]))] * (len(node[1]) - 1))
            continue
        kids = [node[1][k] for k in sorted(node[1])]
        todo.extend((k, node[0]) for k in reversed(kids[1:]))
        todo.append((kids[0], depth))
    return order, common


def deep_shallow(group: np.ndarray, strings: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string, and for each rank the common prefix with the one before it.

    ``group`` comes first in the order; neighbours of different groups have common prefix -1.
    """
    n = len(strings)
    flat = np.zeros((n, SHALLOW), np.uint8)
    sizes = np.array([min(len(s), SHALLOW) for s in strings])
    joined = np.frombuffer(b"".join(s[:SHALLOW] for s in strings), np.uint8)
    rows = np.repeat(np.arange(n), sizes)
    flat[rows, np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = joined
    words = flat.view(">u8").astype(np.uint64)
    # multikey quicksort, one symbol of 8 bytes at a time; only ties go deeper
    order = np.argsort(group, kind="stable")
    tie = np.diff(group[order], prepend=group[order][0] - 1 if n else 0) == 0
    start = np.flatnonzero(~tie)
    edge = np.full(n, -1, np.int64)  # depth known to be shared with the one before
    edge[tie] = SHALLOW
    for w in range(words.shape[1]):
        run = np.cumsum(~tie)
        open_ = np.flatnonzero(tie | np.append(tie[1:], False))
        if not len(open_):
            break
        sub = order[open_]
        by = np.lexsort((words[sub, w], run[open_]))
        order[open_] = sub[by]
        here = words[order, w]
        differs = tie & (here != np.append(here[:1], here[:-1]))
        x = here[differs] ^ here[np.flatnonzero(differs) - 1]
        edge[differs] = 8 * w + 7 - np.searchsorted(_BYTES, x, side="right")
        tie &= ~differs
    bounds = np.flatnonzero(~tie)
    stops = np.append(bounds[1:], n)
    for lo, hi in zip(bounds.tolist(), stops.tolist()):
        if hi - lo < 2:
            continue
        members = order[lo:hi]
        inner, common = blind_trie_order([strings[i] for i in members.tolist()], most)
        order[lo:hi] = members[inner]
        edge[lo + 1:hi] = common[1:]
    # a string that ended within the shallow depth was padded: its own length bounds what it shares
    length = np.array([len(s) for s in strings], dtype=np.int64)
    if n:
        shared = np.minimum(length[order], np.append(length[order[:1]], length[order[:-1]]))
        edge = np.where(edge < 0, -1, np.minimum(edge, shared))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, edge


def repeated_ranges(rows: list[tuple]) -> list[tuple]:
    """Ranges (did, dup, start, end) covered by windows that also start earlier.

    rows: (hash, did, dup, start, end, before, context) in document order, no equal contexts
    (hash, before, context) among them.
    """
    group = np.unique([r[0] for r in rows], return_inverse=True)[1]
    before = np.array([r[5] for r in rows], dtype=np.int64)
    right = [r[6][r[5]:] for r in rows]
    left = [r[6][:r[5]][::-1] for r in rows]
    last = before - np.array([len(r[6]) for r in rows], dtype=np.int64) + LENGTH  # least offset
    rr, er = deep_shallow(group, right, LENGTH)
    rl, el = deep_shallow(group, left, LENGTH)
    low, high = np.full(len(rows), LENGTH), np.full(len(rows), -1)
    for o in range(int(last.min(initial=LENGTH)), int(before.max(initial=-1)) + 1):
        on = np.flatnonzero((last <= o) & (o <= before))
        if len(on) < 2:
            continue
        a = np.cumsum(er < LENGTH - o)[rr[on]]
        b = np.cumsum(el < o)[rl[on]]
        _, first = np.unique(a * (len(rows) + 1) + b, return_index=True)
        later = np.ones(len(on), dtype=bool)
        later[first] = False  # the first of equal windows in document order
        hit = on[later]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
    out = []
    for i in np.flatnonzero(high >= 0).tolist():
        _, did, dup, start, _, b, _ = rows[i]
        out.append((did, dup, start + b - int(high[i]), start + b - int(low[i]) + LENGTH))
    return out


_RANGE = pa.schema([("did", pa.int64()), ("dup", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _sorted_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges from pieces sorted by (hash, document, start): whole classes are settled together."""
    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, _RANGE)], schema=_RANGE)

    gone: list[tuple] = []
    rows: list[tuple] = []  # distinct contexts of whole classes, then those of the open class
    whole, seen, now = 0, set(), None
    for batch in batches:
        for piece in zip(*(batch.column(c).to_pylist() for c in (
                "h", "did", "dup", "start", "end", "before", "context"))):
            h, did, dup, start, end, before, context = piece
            if h is None:
                gone.append((did, dup, start, end))
                continue
            if h != now:
                if len(rows) - whole == 1:
                    rows.pop()
                whole, seen, now = len(rows), set(), h
                if whole >= CLASS_ROWS:
                    gone.extend(repeated_ranges(rows))
                    rows, whole = [], 0
            key = (before, context)
            if key in seen:
                gone.append((did, dup, start, end))
                continue
            seen.add(key)
            rows.append(piece)
        if len(gone) >= 1 << 16:
            yield ranges(list(_joined(gone)))
            gone = []
    if rows:
        gone.extend(repeated_ranges(rows))
    if gone:
        yield ranges(list(_joined(gone)))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                   ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(keep_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, dup, text, ranges in zip(*(part.column(c).to_pylist() for c in (
                        "doc_id", "dup", "text")), part.column("ranges")):
                    spans = [] if not ranges.is_valid else list(_joined(
                        [(0, 0, r["start"], r["end"]) for r in ranges.as_py() if r["dup"] == dup]))
                    at, kept = 0, []
                    for *_, s, e in spans:
                        kept.append(text[at:s])
                        at = e
                    kept.append(text[at:])
                    body = b"".join(kept)
                    rows.append((doc_id, len(text), len(text) - len(body), len(spans),
                                 hashlib.sha256(body).hexdigest(), body if keep_text else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _KEPT)], schema=_KEPT)
    return cut


def suffix_dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked for)."""
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("did"),
                       text.alias("text"))
    base = base.withColumn("dup", F.row_number().over(Window.partitionBy("did").orderBy("text")))
    anchors = base.select("did", "text").mapInArrow(_anchor_rows, "h long, did long")
    by_hash = Window.partitionBy("h").orderBy("did")  # looks at neighbours only
    again = (anchors.withColumns({"prev": F.lag("did").over(by_hash), "next": F.lead("did").over(by_hash)})
             .filter(F.col("prev").isNotNull() | F.col("next").isNotNull())
             .groupBy("did").agg(F.collect_set("h").alias("again")))  # at most a document's anchors
    # with doc_id, so that both readers want the same columns and share one exchange of the text
    pieces = (base.select("doc_id", "did", "dup", "text").join(again, "did", "left")
              .mapInArrow(_context_rows, _PIECE_SQL))
    ranges = (pieces.repartition("spread").sortWithinPartitions("h", "did", "dup", "start")
              .mapInArrow(_sorted_classes, "did long, dup int, start long, end long")
              .groupBy("did").agg(F.collect_list(F.struct("dup", "start", "end")).alias("ranges")))
    out = base.join(ranges, "did", "left").select("doc_id", "dup", "text", "ranges").mapInArrow(
        _cut(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
