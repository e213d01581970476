"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased code points (runs of what is neither a
letter nor a mark count as one space), weighted by log term frequency times inverse document frequency and scaled to unit
length. Document frequencies are counted over every learnable document. Weights are trained by
follow-the-regularised-leader (FTRL-proximal: per-coordinate rates, L1 and L2 penalties), one
softmax row for each language. The languages are all of the learnable documents; the weights see a
sample of each: its first texts by hash, equal texts counted once, as many as ``quota`` gives every
language so that all take ``max_docs`` (production value 4,000), and ``LEAST_DOCS`` at least, or all
it has. Of each language's sample, three parts are for the weights and one for the temperature that
calibrates the scores. So languages weigh alike, however rare, and the sample grows with the number
of languages only. Every document is predicted over its whole text.

Learnable: non-null language, not held out (crc32 of the id as text mod 4 is not 2). Defined
cases: a null text or one without a letter is ``und`` with score 0, as is every text when
nothing can be learned; null ids are not held out; repeated rows are predicted each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlap.llm.common import documents_of, held_out, mix, slices, staged

HASH_BITS = 16
ORDERS = (1, 2, 3)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS = 3
LEAST_DOCS = 50
LETTER = r"\p{L}"
UNKNOWN = "und"
_LETTER = regex.compile(LETTER)
_GAP = regex.compile(r"[^\p{L}\p{M}]+")


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the text's n-grams; None where there is no letter."""
    t = _GAP.sub(" ", (text or "").lower())
    if not _LETTER.search(t):
        return None
    c = np.frombuffer(f" {t.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = []
    for n in ORDERS:
        g = np.full(max(0, len(c) - n + 1), n, dtype=np.uint64)
        for j in range(n):
            g = g * np.uint64(0x110001) + c[j:len(c) - n + 1 + j]
        grams.append((mix(g) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    tf = np.bincount(np.concatenate(grams), minlength=1 << HASH_BITS)
    at = np.flatnonzero(tf)
    return at, tf[at]


def _tfidf(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(tf)) * idf[at]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """FTRL-proximal weights (buckets + 1 for the bias, classes) from (buckets, values, class)."""
    z = np.zeros(((1 << HASH_BITS) + 1, classes))
    n = np.zeros_like(z)
    bias = 1 << HASH_BITS

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0,
                        -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            at, x, y = rows[i]
            at, x = np.append(at, bias), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search on its log."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(1 << HASH_BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if (got := counts_of(text)) is not None:
                df[got[0]] += 1
                docs += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], ["bucket", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            got = [(*r, c) for *r, t in zip(*(part.column(k).to_pylist() for k in (
                "lang", "key", "nth", "text"))) if (c := counts_of(t)) is not None]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([r[0] for r in got], pa.string()),
                "key": pa.array([r[1] for r in got], pa.int64()),
                "nth": pa.array([r[2] for r in got], pa.int32()),
                "at": pa.array([r[3][0].astype(np.int32).tobytes() for r in got], pa.binary()),
                "tf": pa.array([r[3][1].astype(np.int32).tobytes() for r in got], pa.binary())})


def quota(sizes: list[int], most: int) -> int:
    """Texts of each language, so that languages of these sizes take ``most`` together.

    What small languages leave goes to the others; LEAST_DOCS at least.
    """
    left = most
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size > share:
            return max(share, LEAST_DOCS)
        left -= size
    return max([LEAST_DOCS, *sizes])


def sample(learn: DataFrame, max_docs: int) -> DataFrame:
    """lang, key, nth, text: the first texts of each language by hash, equal texts once."""
    keyed = (learn.filter(F.col("text").rlike(LETTER))
             .select("lang", F.xxhash64(F.lit(9), "text").alias("key"), "text"))
    keys = staged(keyed.select("lang", "key"), "lang-keys")
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(  # a row for each language
        F.approx_count_distinct("key", 0.02).alias("n")).collect()}
    if not sizes:
        return keyed.select("lang", "key", F.lit(1).alias("nth"), "text")
    each = quota(list(sizes.values()), max_docs)
    # keys are uniform: below the bound lie about 3 * each of a language's texts, or all of them
    bounds = keys.sparkSession.createDataFrame(
        [(lang, -2 ** 63 + min(2 ** 64 - 1, 2 ** 64 * 3 * each // n)) for lang, n in sizes.items()],
        "lang string, bound long")
    first = (keys.join(F.broadcast(bounds), "lang").filter("key <= bound")
             .select("lang", "key").distinct()
             .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
             .filter(F.col("nth") <= each))
    return (keyed.join(F.broadcast(first), ["lang", "key"])  # ``each`` rows a language
            .groupBy("lang", "key", "nth").agg(F.first("text").alias("text")))


def train(docs: DataFrame, max_docs: int = 4000) -> tuple[list[str], np.ndarray, np.ndarray, float] | None:
    """(languages, idf, weights, temperature) from the learnable documents."""
    learn = (documents_of(docs, F.col("lang").cast("string").alias("lang"))
             .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
             .filter(~held_out(4, 2)))
    df = np.zeros(1 << HASH_BITS)
    total = 0
    for r in (learn.select("text").mapInArrow(_document_frequency, "bucket long, df long")
              .groupBy("bucket").agg(F.sum("df").alias("df")).collect()):  # 2^HASH_BITS + 1 rows
        if r["bucket"] < 0:
            total = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    if not total:
        return None
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    got = (sample(learn, max_docs).select("lang", "key", "nth", "text")
           .mapInArrow(_features, "lang string, key long, nth int, at binary, tf binary").collect())
    if not got:
        return None
    got.sort(key=lambda r: (r["key"], r["lang"]))
    langs = sorted({r["lang"] for r in got})
    number = {lang: k for k, lang in enumerate(langs)}
    rows = []
    for r in got:
        at = np.frombuffer(r["at"], np.int32).astype(np.int64)
        rows.append((at, _tfidf(at, np.frombuffer(r["tf"], np.int32), idf), number[r["lang"]]))
    for_scores = [i for i, r in enumerate(got) if r["nth"] % 4 == 0]
    kept = set(for_scores)
    w = fit([x for i, x in enumerate(rows) if i not in kept], len(langs))
    logits = np.array([rows[i][1] @ w[rows[i][0]] + w[-1] for i in for_scores])
    return langs, idf, w, temperature(logits, np.array([rows[i][2] for i in for_scores], dtype=np.int64))


def predict(docs: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(
        None if model is None else  # 2^HASH_BITS rows of one weight a language
        (model[0], model[1].astype(np.float32), model[2].astype(np.float32), model[3]))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs, scores = [], []
                for text in part.column("text").to_pylist():
                    got = None if shared.value is None else counts_of(text)
                    if got is None:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    names, idf, w, heat = shared.value
                    x = _tfidf(*got, idf)
                    p = _softmax((x @ w[got[0]] + w[-1]) / heat)
                    best = int(p.argmax())
                    langs.append(names[best])
                    scores.append(float(p[best]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "lang_pred": pa.array(langs, pa.string()),
                    "score": pa.array(scores, pa.float64())})

    return documents_of(docs).mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs)).select("doc_id", held_out(4, 2).alias("held_out"),
                                             "lang_pred", "score")


def op8_lang_ftrl(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
