"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its hashed
words and word beginnings; the document's score is the noisy-or of its sentences, ``1 - prod(1 - p_s)``. Weights
are learned from document labels alone (AdaGrad steps on the noisy-or likelihood, with an L1
shrinkage, for the features that occur in clearly more toxic documents than others), so the sentence scores that come with the model locate the offending sentences.

The model is fitted on a bounded sample of labelled rows: at most ``max_positive`` toxic and
``max_negative`` other documents, the first by a hash of the id (production values 1,500 and
3,000); the sample's features are the only rows the driver sees. Every document is scored, over
its whole text. A word is a run of ASCII letters and non-ASCII bytes, A-Z lower-cased.

Defined cases: a null or empty text is one empty sentence; a document labelled twice is toxic
if any label says so; null labels and ids are not learned from; without labels of both kinds
every score is 0; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.llm.common import (documents_of, held_out, letter_words_of, lower_bytes, mix,
                                prefix_hash, slices, span_hash)

HASH_BITS = 18
PREFIXES = (4, 5)
SENTENCE_WORDS = 8
ERRORS, LEAST_DOCS = 4.0, 3
EPOCHS = 25
RATE = 0.3
L1 = 1e-3
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True


def sentences(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets, the sentence of each feature, and the byte spans of the sentences.

    A word gives itself and its first bytes. A sentence ends behind a stop or line break, but
    at most once in SENTENCE_WORDS words, so shouted single words make no sentence each.
    """
    b = lower_bytes(text)
    starts, stops = letter_words_of(b)
    ends = np.flatnonzero(_END[b]) + 1
    ends = ends[ends < len(b)]
    step = np.searchsorted(starts, ends) // SENTENCE_WORDS
    ends = ends[(step > 0) & (np.diff(step, prepend=0) > 0)]
    bounds = np.concatenate([[0], ends, [len(b)]])
    spans = np.stack([bounds[:-1], bounds[1:]], axis=1)
    p = prefix_hash(b)
    h, at = [span_hash(p, starts, stops)], [starts]
    for n in PREFIXES:
        longer = starts[stops - starts > n]
        h.append(mix(span_hash(p, longer, longer + n) + np.uint64(n)))
        at.append(longer)
    bucket = (np.concatenate(h) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return bucket, np.searchsorted(ends, np.concatenate(at), side="right"), spans


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def telling(bags: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray) -> np.ndarray:
    """Mask of the buckets that occur in clearly more toxic documents than others.

    Documents' shares are compared in standard errors; equal documents count once.
    """
    seen = np.zeros((2, 1 << HASH_BITS))
    for (bucket, _, _), t in zip(bags, toxic.tolist()):
        seen[t, np.unique(bucket)] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], dtype=np.float64)
    p = seen.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n).sum())
    return (seen[1] / n[1] - seen[0] / n[0] >= ERRORS * error) & (seen[1] >= LEAST_DOCS)


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], labels: list[int]) -> np.ndarray:
    """Weights (the bias last) from bags (feature buckets, sentence of each, sentences)."""
    distinct = {hashlib.sha256(b.tobytes() + s.tobytes()).digest(): i for i, (b, s, _) in enumerate(bags)}
    bags, toxic = [bags[i] for i in distinct.values()], np.array([labels[i] for i in distinct.values()])
    size = 1 << HASH_BITS
    w = np.zeros(size + 1)
    w[-1] = -4.0
    if len(set(toxic.tolist())) < 2:
        w[-1] = -30.0 if not toxic.any() else 30.0
        return w
    use = telling(bags, toxic)
    packed = []  # each feature once a sentence
    for (bucket, sent, n) in bags:
        on = use[bucket]
        once = np.unique(sent[on].astype(np.int64) * size + bucket[on])
        idx, inv = np.unique(once % size, return_inverse=True)
        packed.append((once % size, once // size, n, idx, inv))
    seen = np.full(size + 1, 0.1)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(packed)).tolist():
            bucket, sent, n, idx, inv = packed[i]
            z = w[-1] + np.bincount(sent, weights=w[bucket], minlength=n)
            a = float(_softplus(z).sum())
            p = np.exp(-_softplus(-z))
            g = p if toxic[i] == 0 else np.maximum(-p / max(np.expm1(min(a, 50.0)), 1e-6), -1.0)
            gb = float(g.sum())
            seen[-1] += gb * gb
            w[-1] -= RATE / np.sqrt(seen[-1]) * gb
            if len(idx):
                gw = np.bincount(inv, weights=g[sent], minlength=len(idx))
                seen[idx] += gw * gw
                step = RATE / np.sqrt(seen[idx])
                moved = w[idx] - step * gw
                w[idx] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0.0)
    return w


def _places(sentences: int):
    """The type for sentence numbers: the sample is held by the driver, so a short one."""
    return np.uint16 if sentences <= 1 << 16 else np.int32


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            bags = [sentences(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "toxic": part.column("toxic"),
                "bucket": [b.astype(np.int32).tobytes() for b, _, _ in bags],
                "sent": [s.astype(_places(len(x))).tobytes() for _, s, x in bags],
                "n": pa.array([len(x) for _, _, x in bags], pa.int32())})


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 1500,
          max_negative: int = 3000) -> np.ndarray | None:
    """Weights learned from labelled documents outside the held-out fold."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("toxic").cast("int").alias("toxic"))
            .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
            .filter(~held_out(5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    pick = [r for toxic, most in ((1, max_positive), (0, max_negative))
            for r in rows.filter((F.col("toxic") > 0) == bool(toxic))
            .orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most).collect()]
    if len({r["toxic"] > 0 for r in pick}) < 2:
        return None
    chosen = docs.sparkSession.createDataFrame(
        [(r["doc_id"], int(r["toxic"] > 0)) for r in pick], "doc_id long, toxic int")
    bags = (documents_of(docs).join(F.broadcast(chosen), "doc_id")  # max_positive + max_negative rows
            .groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # one row an id, however often it occurs
            .mapInArrow(_features, "toxic int, bucket binary, sent binary, n int").collect())
    # the hash in the sort gives the same weights whatever order the rows arrive in
    bags.sort(key=lambda r: (r["toxic"], bytes(r["bucket"]), bytes(r["sent"])))
    return fit([(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["sent"], _places(r["n"])), r["n"])
                for r in bags], [r["toxic"] for r in bags])


def _bag_logits(text: str | None, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit and byte span of each sentence."""
    bucket, sent, spans = sentences(text)
    return float(w[-1]) + np.bincount(sent, weights=w[bucket], minlength=len(spans)), spans


def _noisy_or(z: np.ndarray) -> float:
    return float(-np.expm1(-_softplus(z).sum()))


_SCORED = "doc_id long, score double, n_sentences int, worst_start long, worst_end long, worst_score double"


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, score, and the byte span and score of the most toxic sentence."""
    model = docs.sparkSession.sparkContext.broadcast(
        None if weights is None else weights.astype(np.float32))  # 2^HASH_BITS floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(),
                                        part.column("text").to_pylist()):
                    if w is None:
                        rows.append((doc_id, 0.0, len(sentences(text)[2]), 0, 0, 0.0))
                        continue
                    z, spans = _bag_logits(text, w)
                    top = int(z.argmax())
                    rows.append((doc_id, _noisy_or(z), len(spans),
                                 int(spans[top, 0]), int(spans[top, 1]),
                                 float(1.0 / (1.0 + np.exp(-z[top])))))
                yield pa.RecordBatch.from_pydict(dict(zip(
                    ("doc_id", "score", "n_sentences", "worst_start", "worst_end", "worst_score"),
                    (pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(),
                        pa.float64()))))))

    return documents_of(docs).mapInArrow(scored, _SCORED)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the most toxic sentence of each document."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences", "worst_start", "worst_end", "worst_score")


def without_toxic(docs: DataFrame, weights: np.ndarray | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they are."""
    if weights is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([_noisy_or(_bag_logits(t, model.value)[0]) < limit
                                            for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op7_toxic_mil(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                    spark.read.parquet(f"{sf_dir}/labels.parquet"))
