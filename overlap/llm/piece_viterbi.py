"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces are those of a given model file. Its scores are not used, as those of a BPE file are
negated merge ranks and no likelihoods: log probabilities are estimated by ``ROUNDS`` rounds of
expectation maximisation over all documents, from equal ones on. Words (see below) are counted
once; a round adds up every piece's expected count over all segmentations of all words, in fixed
point, and only a vocabulary-sized result reaches the driver. A count under ``FLOOR`` is taken as
``FLOOR``, so every piece stays usable. The best segmentation of the text maximises the sum of piece scores; a character that
is no piece costs the least score minus 10 and becomes its UTF-8 byte pieces. A blank is the
marker U+2581, and one marker is put before a text that isn't empty; decoding undoes both and
leaves markers that come from byte pieces alone, so every text is restored byte by byte.

Pieces hold markers only at their front, so the best path of a text is the chain of the best
paths of its words (a run of blanks with what follows it). The distinct words of a slice of texts are
solved together, in arrays (see ``lattice``), and kept for the next slices up to a limit; words that are
long, hold a marker of their own or aren't UTF-8 are solved one at a time. The trie is an array of
fixed size that is built once and broadcast.

Defined cases: a null text encodes as an empty one, to no token; ties go to the path whose last
piece is longest; a text of any length is read whole; bytes that aren't UTF-8 fall back to byte
pieces; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import exp, inf, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.llm.common import slices, staged
from overlap.llm.lattice import Lattice, by_length

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
CACHE = 800_000  # words a task keeps between slices
ROUNDS = 4
FLOOR = 0.5
FIXED = 1 << 16
KEPT_STEPS = 4096  # positions of a word whose steps are kept from the forward to the backward pass
COUNT_BYTES = 32 << 20
COUNT_WORDS = 1_000_000
SOLVED = 4_000  # words in a lattice: its arrays stay in a core's cache
SLICE_BYTES = 4 << 20


def load_vocabulary(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces as bytes (b"" for control pieces), their scores, and the id of each byte piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], np.full(256, -1, dtype=np.int32)
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
        text = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        pieces.append(sp.id_to_piece(i).encode() if text else b"")
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a blank behind other characters")
    return pieces, np.array([sp.get_score(i) for i in range(len(pieces))]), byte_ids


def double_array(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and piece id of each state; state 0 is the root, a step adds byte + 1."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for i, p in enumerate(pieces):
        if not p:
            continue
        at = 0
        for b in p:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
            at = children[at][b]
        ends[at] = i
    size = 4 * len(children) + 1024
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    value = np.full(size, -1, np.int32)
    free = np.ones(size, dtype=bool)
    free[0] = False
    todo, lowest, top = [(0, 0)], 257, 257
    while todo:
        node, state = todo.pop()
        value[state] = ends.get(node, -1)
        steps = np.array(sorted(children[node]), dtype=np.int64) + 1
        if not len(steps):
            continue
        if top + 2048 > size:
            grow = size
            base = np.append(base, np.zeros(grow, np.int32))
            check, value = (np.append(x, np.full(grow, -1, np.int32)) for x in (check, value))
            free = np.append(free, np.ones(grow, dtype=bool))
            size += grow
        if len(steps) == 1:  # lone children fill the gaps
            while not free[lowest]:
                lowest += 1
            at = lowest - int(steps[0])
        else:  # families go where the array is still open: one fits at top at the latest
            near = np.arange(max(0, top - 512), top + 1)
            at = int(near[free[near[:, None] + steps[None, :]].all(axis=1).argmax()])
        top = max(top, at + int(steps[-1]) + 1, lowest + 1)
        base[state] = at
        for s in steps.tolist():
            free[at + s], check[at + s] = False, state
            todo.append((children[node][s - 1], at + s))
    top += 258  # a step from any state stays inside
    return base[:top], check[:top], value[:top]


class Codec:
    """Encodes and decodes byte strings; one for each worker process."""

    def __init__(self, pieces, scores, byte_ids, base, check, value) -> None:
        self.trie = base.astype(np.int64), np.append(check, np.full(
            max(0, int(base.max()) + 258 - len(check)), -1, check.dtype)).astype(np.int64), value.astype(np.int64)
        self.base, self.check, self.value = base.tolist(), check.tolist(), value.tolist()
        self.check += [-1] * max(0, int(base.max()) + 258 - len(self.check))
        self.scores, self.byte_ids = scores.tolist(), byte_ids
        normal = [s for s, p in zip(self.scores, pieces) if p]
        self.unknown = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.is_byte = np.zeros(len(pieces), dtype=bool)
        self.is_byte[byte_ids] = True
        # bytes that begin a character stand for its score, the others for none
        self.score_of = scores.copy()
        self.score_of[byte_ids] = [0.0 if b & 0xC0 == 0x80 else self.unknown for b in range(256)]
        self.out = [p.replace(MARK, b" ") for p in pieces]
        for b, i in enumerate(byte_ids.tolist()):
            self.out[i] = bytes([b])
        line = b"" if any(b"\n" in p for p in pieces) else b"\n"
        self.chunks = re.compile(b" +[^ " + line + b"]*|[^ " + line + b"]+" + (b"|\n" if line else b"")).findall
        self.score_array = scores
        self.clear()

    def clear(self) -> None:
        """Forgets the words solved so far."""
        self.numbers, self.done = _Numbers(), 0
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _best(self, chunk: bytes) -> bytes:
        """Ids (int32, packed) of the best path of one chunk."""
        blanks = len(chunk) - len(chunk.lstrip(b" "))
        s = MARK * blanks + chunk[blanks:]
        n = len(s)
        # markers of the text itself are no blanks: no piece may cover them
        own = [n] if MARK not in chunk else [
            m.start() for m in re.finditer(MARK, s) if m.start() >= 3 * blanks] + [n]
        base, check, value, scores = self.base, self.check, self.value, self.scores
        best, back, piece = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -1e300:
                continue
            stop = i + 1
            while stop < n and s[stop] & 0xC0 == 0x80:
                stop += 1
            state, single = 0, False
            if i == own[0]:
                own.pop(0)
            else:
                for j in range(i, own[0]):
                    to = base[state] + s[j] + 1
                    if check[to] != state:
                        break
                    state = to
                    v = value[state]
                    if v >= 0:
                        if j + 1 == stop:
                            single = True
                        x = here + scores[v]
                        if x > best[j + 1]:
                            best[j + 1], back[j + 1], piece[j + 1] = x, i, v
            if not single and here + self.unknown > best[stop]:
                best[stop], back[stop], piece[stop] = here + self.unknown, i, -1
        ids, j = [], n
        while j > 0:
            i = back[j]
            if piece[j] >= 0:
                ids.append(piece[j])
            else:
                ids.extend(self.byte_ids[list(s[i:j])][::-1].tolist())
            j = i
        return np.array(ids[::-1], dtype=np.int32).tobytes()

    def _steps(self, s: bytes, i: int, until: int) -> list[tuple[int, int]]:
        """(end, piece) of what may follow position i; piece -1 is a character that is none."""
        n, base, check, value = len(s), self.base, self.check, self.value
        stop = i + 1
        while stop < n and s[stop] & 0xC0 == 0x80:
            stop += 1
        out, state, single = [], 0, False
        for j in range(i, until):
            to = base[state] + s[j] + 1
            if check[to] != state:
                break
            state = to
            if value[state] >= 0:
                single |= j + 1 == stop
                out.append((j + 1, value[state]))
        if not single:
            out.append((stop, -1))
        return out

    def expected(self, chunk: bytes, times: int, counts: dict[int, int]) -> None:
        """Adds the expected counts (times FIXED) of the pieces of ``times`` such chunks."""
        blanks = len(chunk) - len(chunk.lstrip(b" "))
        s = MARK * blanks + chunk[blanks:]
        n, scores, unknown = len(s), self.scores, self.unknown
        own = [n] if MARK not in chunk else [
            m.start() for m in re.finditer(MARK, s) if m.start() >= 3 * blanks] + [n]
        kept: dict[int, list[tuple[int, int]]] = {}
        forward, backward = [-inf] * (n + 1), [-inf] * (n + 1)
        forward[0] = backward[n] = 0.0
        for i in range(n):
            here = forward[i]
            if here == -inf:
                continue
            steps = self._steps(s, i, own[bisect_left(own, i)])
            if n <= KEPT_STEPS:
                kept[i] = steps
            for j, v in steps:
                x, y = here + (scores[v] if v >= 0 else unknown), forward[j]
                forward[j] = x if y == -inf else max(x, y) + log1p(exp(-abs(x - y)))
        whole = forward[n]
        for i in range(n - 1, -1, -1):
            if forward[i] == -inf:
                continue
            total = -inf
            for j, v in kept.get(i) or self._steps(s, i, own[bisect_left(own, i)]):
                x = backward[j] + (scores[v] if v >= 0 else unknown)
                total = x if total == -inf else max(x, total) + log1p(exp(-abs(x - total)))
                if v >= 0:
                    counts[v] += round(times * FIXED * min(1.0, exp(forward[i] + x - whole)))
            backward[i] = total

    def expected_of(self, words: list[bytes], times: list[int], counts: np.ndarray) -> None:
        """Adds the expected counts (times FIXED) of the pieces of words, each so many times."""
        one, often = Counter(), np.array(times, dtype=np.float64)
        plain, others = by_length(words)
        for k in others:
            self.expected(words[k], times[k], one)
        for v, n in one.items():
            counts[v] += n
        for lo in range(0, len(plain), SOLVED):
            part = plain[lo:lo + SOLVED]
            Lattice([words[k] for k in part.tolist()], *self.trie).expected(
                self.score_array, self.unknown, often[part], FIXED, counts)

    def solve(self) -> None:
        """Best paths of the words that were numbered since the last call."""
        new = list(self.numbers)[self.done:]
        sizes = np.zeros(len(new), np.int64)
        found, places = [], []
        plain, others = by_length(new)
        for lo in range(0, len(plain), SOLVED):
            part = plain[lo:lo + SOLVED]
            ids, n = Lattice([new[k] for k in part.tolist()], *self.trie).best(
                self.score_array, self.unknown, self.byte_ids)
            found.append(ids)
            places.append(part)
            sizes[part] = n
        for k in others:
            ids = np.frombuffer(self._best(new[k]), dtype=np.int32)
            found.append(ids)
            places.append(np.array([k]))
            sizes[k] = len(ids)
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.zeros(at[-1], np.int32)
        for ids, place in zip(found, places):
            flat[_spread(at[place], sizes[place])] = ids
        self.ids, self.at = np.concatenate([self.ids, flat]), np.concatenate([self.at, self.at[-1] + at[1:]])
        self.done = len(self.numbers)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.numbers) > CACHE or len(self.ids) > 8 * CACHE:
            self.clear()
        words = [self.chunks(b" " + t) if t else [] for t in texts]
        word = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        if len(self.numbers) > self.done:
            self.solve()
        sizes = self.at[word + 1] - self.at[word]
        ids = self.ids[_spread(self.at[word], sizes)]
        per_text = np.bincount(np.repeat(np.arange(len(texts)), [len(x) for x in words]), sizes, minlength=len(texts))
        return np.split(ids, np.cumsum(per_text).astype(np.int64)[:-1]) if len(texts) else []

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.out.__getitem__, ids.tolist()))[1:]

    def score(self, ids: np.ndarray) -> float:
        return float(self.score_of[ids].sum())


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[k], starts[k] + 1, ... of ranges of the given sizes."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """This process's codec for the broadcast tables, which their digest names."""
    name = shared.value[0]
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(*shared.value[1:])
    return _codecs[name]


_ENCODED = ("doc_id long, n_bytes long, n_tokens long, n_fallback long, score double, "
            "lossless boolean, text_sha256 string, token_ids array<int>")


def shared_tables(spark, model: str = MODEL, scores: np.ndarray | None = None, built: tuple | None = None):
    """The broadcast vocabulary and trie of a model file, with its scores or the given ones."""
    pieces, own, byte_ids, *trie = built or _built(model)
    scores = own if scores is None else scores
    name = hashlib.sha256(b"\0".join(pieces) + scores.tobytes()).hexdigest()
    return spark.sparkContext.broadcast((name, pieces, scores, byte_ids, *trie))  # one vocabulary


def _built(model: str) -> tuple:
    pieces, scores, byte_ids = load_vocabulary(model)
    return pieces, scores, byte_ids, *double_array(pieces)


def log_probabilities(counts: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Of each piece by its count, FLOOR at least; other ids have the least."""
    normal = np.array([bool(p) for p in pieces])
    seen = np.where(normal, np.maximum(counts, FLOOR), 0.0)
    return np.log(np.where(normal, seen, FLOOR) / max(seen.sum(), FLOOR))


def words_of_documents(texts: DataFrame, shared) -> DataFrame:
    """word, n: how often each word occurs in the column ``text`` (binary)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, found, held = _codec(shared).chunks, Counter(), 0

        def flushed() -> Iterator[pa.RecordBatch]:
            words, lo, size = list(found), 0, 0
            for hi, w in enumerate(words, 1):
                size += len(w)
                if size >= COUNT_BYTES or hi - lo >= 1 << 17 or hi == len(words):
                    part = words[lo:hi]
                    yield pa.RecordBatch.from_pydict({
                        "word": pa.array(part, pa.binary()), "n": pa.array([found[w] for w in part], pa.int64())})
                    lo, size = hi, 0
            found.clear()

        for batch in batches:
            for part in slices(batch):
                for t in part.column("text").to_pylist():
                    if t:
                        found.update(chunks(b" " + t))
                        held += len(t)
                        if held >= COUNT_BYTES or len(found) >= COUNT_WORDS:
                            yield from flushed()
                            held = 0
        yield from flushed()

    # a number of partitions that is not reduced: the words are work for every core
    many = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (texts.mapInArrow(counted, "word binary, n long").repartition(many, "word")
            .groupBy("word").agg(F.sum("n").alias("n")))


def estimate(docs: DataFrame, built: tuple, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces over all of ``docs``."""
    spark, pieces = docs.sparkSession, built[0]
    scores = log_probabilities(np.zeros(len(pieces)), pieces)
    words = staged(words_of_documents(docs.select(F.col("text").cast("string").cast("binary").alias("text")),
                                      shared_tables(spark, scores=scores, built=built)), "piece-words")
    for _ in range(rounds):
        shared = shared_tables(spark, scores=scores, built=built)

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            codec, counts = _codec(shared), np.zeros(len(pieces), np.int64)
            for batch in batches:
                codec.expected_of(batch.column("word").to_pylist(), batch.column("n").to_pylist(), counts)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int32()), "n": pa.array(counts[some])})

        counts = np.zeros(len(pieces))
        for r in (words.mapInArrow(expected, "piece int, n long").groupBy("piece")
                  .agg(F.sum("n").alias("n")).collect()):  # a row for each piece
            counts[r["piece"]] = r["n"] / FIXED
        scores = log_probabilities(counts, pieces)
        shared.unpersist()
    return scores


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: token ids, their score, and whether decoding gives the text back.

    ``text_sha256`` is that of the decoded text.
    """
    built = _built(model)
    shared = shared_tables(docs.sparkSession, scores=estimate(docs, built), built=built)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        try:
            for batch in batches:
                for part in slices(batch, size=SLICE_BYTES):
                    texts = [t or b"" for t in part.column("text").to_pylist()]
                    ids = codec.encode_all(texts)
                    decoded = [codec.decode(i) for i in ids]
                    sizes = np.array([len(i) for i in ids], dtype=np.int64)
                    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column("doc_id"),
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "n_tokens": pa.array(sizes),
                        "n_fallback": pa.array([int(codec.is_byte[i].sum()) for i in ids], pa.int64()),
                        "score": pa.array([codec.score(i) for i in ids], pa.float64()),
                        "lossless": pa.array([d == t for d, t in zip(decoded, texts)], pa.bool_()),
                        "text_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                        "token_ids": pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                            pa.array(flat, pa.int32()))})
        finally:  # the process serves other tasks, also of other operators
            codec.clear()
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        encoded, _ENCODED)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and token_ids (null ids give an empty text)."""
    shared = shared_tables(encoded.sparkSession, model)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text": pa.array([codec.decode(np.array(i or [], dtype=np.int32)) for i in
                                  batch.column("token_ids").to_pylist()], pa.binary())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(
        decoded, "doc_id long, text binary").select("doc_id", F.col("text").cast("string").alias("text"))


def op3_piece_viterbi(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
