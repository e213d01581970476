"""Cross-tokenizer alignment with an identity map for the tokens both vocabularies share.

Each text is encoded by a byte-level BPE (A, which gets a space and the text) and by a piece BPE
with byte fallback (B, which adds that space itself). Token ends that both share cut the bytes into
groups; an A and a B token are linked where their byte ranges overlap. As neither side has an end
inside a link, the links are the intervals between neighbouring ends of either side.

Most groups hold one token of each side with the same bytes. ``identity`` maps an A id to the B id with
those bytes; links along it are counted in a vector of the length of the vocabulary, of which
each task makes one. Only the other links become pairs: their counts are summed by pair, in how
many documents each occurs, already added up a slice of documents.

1. A slice of documents (about ``SLICE_BYTES`` of text) is cut into words at blanks between
   characters that are no white space; no token of either side crosses such a blank. Distinct
   words are encoded and aligned together, in arrays, and kept for the next slices (up to
   ``KEPT_WORDS``). Documents' links are written, with the slice's distinct pairs.
2. Pair counts: one sum by pair. Best counts of an A id: one maximum, of the vocabulary's length.
3. Each slice gets the counts of the pairs it holds back (a frequent pair is asked for once a slice, not once
   a document) and adds up its documents' columns.

Defined cases: null and empty texts have no tokens, nor have texts whose tokens on either side do not
spell the space and the text (a marker U+2581 in the text, for instance): zeros and an empty column. Every
row is a document of its own, repeated rows and null ids too. An empty table gives an empty result.
Whole texts are read; a word without such a blank is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.llm.common import slices, staged

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 4 << 20
KEPT_WORDS = 400_000
KEPT_BYTES = 32 << 20
B_BITS = 20  # of a pair's code, for the B id
# a blank with a character on either side that is surely no white space
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
OTHER_BLANK = re.compile(r"(?:^|[^!-~\w]) | (?:$|[^!-~\w])")
_LINKS = ("slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
          "groups_sha256 string, same array<int>, same_n array<int>, other array<long>, other_n array<int>, kind int")
_OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string")
DOC, PAIRS, VECTOR = 0, 1, 2


def byte_symbols() -> dict[str, int]:
    """The byte of each symbol of a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenizer_files(model_a: str = MODEL_A, model_b: str = MODEL_B) -> tuple[str, bytes]:
    """Contents of the two files, for the workers (a vocabulary each)."""
    with open(model_a, encoding="utf-8") as a, open(model_b, "rb") as b:
        return a.read(), b.read()


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Aligner:
    """The two tokenizers, their tokens' bytes, and the words aligned so far; one a worker process."""

    def __init__(self, file_a: str, file_b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        symbol = byte_symbols()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab(with_added_tokens=True).values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(symbol[c] for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.b_bytes) >> B_BITS:
            raise ValueError(f"more than 2^{B_BITS} pieces")
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        # byte pieces last, so that a normal piece with the same bytes wins
        order = sorted((i for i, t in enumerate(self.b_bytes) if t), key=lambda i: self.b.is_byte(i), reverse=True)
        of_bytes = {self.b_bytes[i]: i for i in order}
        self.identity = np.array([of_bytes.get(t, -1) if t else -1 for t in self.a_bytes])
        self.a_text, self.b_text = (np.array([str(i) for i in range(len(x))], dtype=object)
                                    for x in (self.a_bytes, self.b_bytes))
        self.clear()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return b""
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def clear(self) -> None:
        self.numbers, self.done, self.kept = _Numbers(), 0, 0
        self.text: list[str] = []
        self.table = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of each word; -1: no tokens
        self.at, self.codes = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[int]:
        parts = CUT.split(text) if OTHER_BLANK.search(text) else text.split(" ")
        return list(map(self.numbers.__getitem__, parts))

    def align_new(self) -> None:
        """Encodes and aligns the words that came since the last call."""
        new = list(self.numbers)[self.done:]
        if not new:
            return
        a_ids = [e.ids for e in self._encode_a([" " + w for w in new])]
        b_ids = self.b.encode(new, num_threads=1)
        whole = [(" " + w).encode() for w in new]
        a_flat = np.fromiter((i for x in a_ids for i in x), np.int64)
        b_flat = np.fromiter((i for x in b_ids for i in x), np.int64)
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
        size = np.array([len(w) for w in whole], dtype=np.int64)
        good = np.ones(len(new), dtype=bool)
        all_bytes = b"".join(whole)
        for ids, n, sizes, tokens in ((a_flat, n_a, self.a_size, self.a_bytes), (b_flat, n_b, self.b_size, self.b_bytes)):
            spelt = np.concatenate([[0], np.cumsum(sizes[ids])])
            of_word = np.concatenate([[0], np.cumsum(n)])
            if (np.diff(spelt[of_word]) == size).all() and b"".join(map(tokens.__getitem__, ids.tolist())) == all_bytes:
                continue
            for k, w in enumerate(whole):
                good[k] &= b"".join(map(tokens.__getitem__, ids[of_word[k]:of_word[k + 1]].tolist())) == w
        if not good.all():
            a_flat, b_flat = a_flat[np.repeat(good, n_a)], b_flat[np.repeat(good, n_b)]
        self._append(good, a_flat, b_flat, np.where(good, n_a, 0), np.where(good, n_b, 0), np.where(good, size, 0))
        self.done = len(self.numbers)
        self.kept += int(size.sum())

    def _encode_a(self, words: list[str]):
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return encode(words, add_special_tokens=False)

    def _append(self, good, a, b, n_a, n_b, size) -> None:
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(ends_a, ends_b)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)  # ends of groups, words' ends among them
        code = (a[np.searchsorted(ends_a, ends)] << B_BITS) | b[np.searchsorted(ends_b, ends)]
        stop = np.cumsum(size)
        n_links, n_groups = (np.diff(np.searchsorted(x, stop, "right"), prepend=0) for x in (ends, both))
        rows = np.stack([n_a, n_b, n_groups, n_links], axis=1)
        rows[~good] = -1
        self.table = np.concatenate([self.table, rows])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n_links)])
        self.codes = np.concatenate([self.codes, code])
        # the groups' text: tokens by (group, side), each with what stands behind it
        group = np.concatenate([np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)])
        side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side = group[order], side[order]
        last_of_word = np.zeros(len(both), dtype=bool)
        last_of_word[np.searchsorted(both, stop[size > 0])] = True
        behind = np.full(len(order), ",", dtype=object)
        if len(order):
            turn = np.append(group[1:] != group[:-1], True)
            behind[np.append(side[1:] != side[:-1], False) & ~turn] = "|"
            behind[turn] = np.where(last_of_word[group[turn]], "\n", ";")
        spelt = np.empty(2 * len(order), dtype=object)
        spelt[0::2] = np.concatenate([self.a_text[a], self.b_text[b]])[order]
        spelt[1::2] = behind
        lines = iter("".join(spelt.tolist()).split("\n"))
        self.text += [next(lines) if ok else "" for ok in good.tolist()]


def _lists(offsets: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))


def _packed(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    first = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1))
    return sorted_keys[first], np.diff(np.append(first, len(sorted_keys)))


_aligners: dict[str, Aligner] = {}


def _aligner(shared) -> Aligner:
    name, *files = shared.value
    if name not in _aligners:
        _aligners.clear()
        _aligners[name] = Aligner(*files)
    return _aligners[name]


def _links(shared):
    """Links of each document, the pairs of each slice, and the identity vector of the task."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(shared)
        slice_id = TaskContext.get().partitionId() << 32  # the same when a task is run again
        vector = np.zeros(len(al.a_bytes), np.int64)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                if len(al.numbers) > KEPT_WORDS or al.kept > KEPT_BYTES:
                    al.clear()
                texts = [_decoded(t) for t in part.column("text").to_pylist()]
                words = [al.words(t) if t else [] for t in texts]
                al.align_new()
                yield _slice_rows(al, slice_id, part.column("doc_id"), words, vector)
                slice_id += 1
        ids = np.flatnonzero(vector)
        yield _row_batch(slice_id, VECTOR, ids, vector[ids], np.zeros(0, np.int64), np.zeros(0, np.int64))
    return made


def _decoded(t: bytes | None) -> str:
    """The text; a marker (which has no tokens) where it is no UTF-8."""
    try:
        return (t or b"").decode()
    except UnicodeDecodeError:
        return "▁"


def _row_batch(slice_id, kind, same, same_n, other, other_n) -> pa.RecordBatch:
    """One row without a document."""
    one = lambda x: np.array([0, len(x)])
    none = pa.array([None], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([slice_id], pa.int64()), none, none, none, none, none, pa.array([None], pa.string()),
         _lists(one(same), same, np.int32), _lists(one(same_n), same_n, np.int64).cast(pa.list_(pa.int32())),
         _lists(one(other), other, np.int64), _lists(one(other_n), other_n, np.int32),
         pa.array([kind], pa.int32())], _COLUMNS)


_COLUMNS = [c.split()[0] for c in _LINKS.split(", ")]


def _slice_rows(al: Aligner, slice_id: int, doc_ids, words: list[list[int]], vector: np.ndarray) -> pa.RecordBatch:
    n = len(words)
    word = np.fromiter((w for x in words for w in x), np.int64)
    doc = np.repeat(np.arange(n), [len(x) for x in words])
    bad = np.zeros(n, dtype=bool)
    bad[doc[al.table[word, 0] < 0]] = True
    keep = ~bad[doc]
    word, doc = word[keep], doc[keep]
    totals = np.stack([np.bincount(doc, al.table[word, c], minlength=n) for c in range(4)]).astype(np.int64)
    text = [hashlib.sha256(";".join(map(al.text.__getitem__, x)).encode()).hexdigest() if x and not b else ""
            for x, b in zip(words, bad.tolist())]
    # every link occurrence as (document, pair)
    n_links = al.table[word, 3]
    take = np.repeat(al.at[word] - np.concatenate([[0], np.cumsum(n_links)[:-1]]) if len(word) else word, n_links)
    codes = al.codes[take + np.arange(len(take))]
    bits = B_BITS + int(len(al.a_bytes)).bit_length()
    key, times = _packed(np.sort((np.repeat(doc, n_links) << bits) | codes))
    of, code = key >> bits, key & ((1 << bits) - 1)
    a, b = code >> B_BITS, code & ((1 << B_BITS) - 1)
    same = al.identity[a] == b
    vector += np.bincount(a[same], minlength=len(vector))
    lists = []
    for chosen, values in ((same, a), (~same, code)):
        at = np.concatenate([[0], np.cumsum(np.bincount(of[chosen], minlength=n))])
        lists += [_lists(at, values[chosen], np.int32 if values is a else np.int64), _lists(at, times[chosen], np.int32)]
    docs = pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, slice_id)), doc_ids, *[pa.array(t) for t in totals], pa.array(text, pa.string()), *lists,
         pa.array(np.full(n, DOC, np.int32))], _COLUMNS)
    pairs, holders = _packed(np.sort(code[~same]))
    none = np.zeros(0, np.int64)
    both = pa.Table.from_batches([docs, _row_batch(slice_id, PAIRS, none, none, pairs, holders)])
    return both.combine_chunks().to_batches()[0]


def _sums(vector, best):
    """Columns of a slice's documents from its links and the counts of its pairs."""
    def made(docs: pa.Table, replies: pa.Table) -> pa.Table:
        count, most = vector.value, best.value
        code = replies.column("code").to_numpy()
        order = np.argsort(code)
        code, total = code[order], replies.column("total").to_numpy()[order]
        docs = docs.combine_chunks()
        n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        for name in ("same", "other"):
            column, times = docs.column(name).chunk(0), docs.column(name + "_n").chunk(0)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            if name == "same":
                a, held = flat, count[flat]
            else:
                a, held = flat >> B_BITS, total[np.searchsorted(code, flat)]
            for out, what in ((n_best, n * (held == most[a])), (count_sum, n * held)):
                at = np.concatenate([[0], np.cumsum(what)])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                out += at[ends[1:]] - at[ends[:-1]]
        cols = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(cols | {"n_best": n_best, "count_sum": count_sum, "groups_sha256": docs.column("groups_sha256")})
    return made


def align_documents(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """The contract's row for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    files = tokenizer_files(model_a, model_b)
    name = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    shared = spark.sparkContext.broadcast((name, *files))  # two vocabulary files
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").cast("binary").alias("text"))
    rows = staged(texts.mapInArrow(_links(shared), _LINKS), "links")
    n_a = len(Aligner(*files).a_bytes)
    # links along the identity map: a vector of the vocabulary's length
    vector, best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    for r in (rows.where(F.col("kind") == VECTOR).select(F.explode(F.arrays_zip("same", "same_n")).alias("x"))
              .groupBy("x.same").agg(F.sum("x.same_n").alias("n")).collect()):
        vector[r["same"]] = r["n"]
    asked = rows.where(F.col("kind") == PAIRS).select(
        "slice", F.explode(F.arrays_zip("other", "other_n")).alias("x")).select(
        "slice", F.col("x.other").alias("code"), F.col("x.other_n").alias("n"))
    counts = staged(asked.groupBy("code").agg(F.sum("n").alias("total")), "pair-counts")
    for r in (counts.groupBy(F.shiftright("code", B_BITS).alias("a")).agg(F.max("total").alias("most")).collect()):
        best[r["a"]] = r["most"]  # one row an A id
    best = np.maximum(best, vector)
    replies = asked.join(counts, "code").select(F.col("slice").alias("of_slice"), "code", "total")
    documents = rows.where(F.col("kind") == DOC).drop("kind")
    return documents.groupBy("slice").cogroup(replies.groupBy("of_slice")).applyInArrow(
        _sums(spark.sparkContext.broadcast(vector), spark.sparkContext.broadcast(best)), _OUT)


def op11_token_align(spark, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
