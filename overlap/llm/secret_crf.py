"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The patterns (``assign``, ``access``, ``hex``) find base spans in every whole text. A CRF tags the tokens as
begin (B), inside (I) or outside (O) of a secret. Its features are the token's shape (length, shares of
digits and letters, changes between them, first bytes), the token itself, the three tokens
before it, the one behind it, and the file (shares of punctuation and of tokens with digits, number
of lines), alone and with the shape. They are hashed to ``DIM`` weights a tag; O scores 0.

Training. There are no labels for secrets, so the base spans of a sample serve: the value of an
assignment, the whole of the other kinds. The sample is bounded: the ``MAX_FOUND`` documents with base
spans and the ``MAX_CLEAN`` documents without any that come first by hash, and of each at most ``WINDOWS``
windows of ``WINDOW`` tokens about secrets and as many elsewhere. The log-likelihood with an L2 penalty is
maximised by forward-backward sums over all windows and AdaGrad steps. Equal texts count once.

Decoding is exact Viterbi. A token whose scores for B and I stay below O's whatever its neighbours are
is O on the best path; such tokens cut a text into short runs, and runs of all texts of a slice are
decoded together. A decoded span that touches no base span is added as kind ``crf``.

Defined cases: null texts are empty and have no span; every row is scanned, repeated rows and null ids
too; bytes that aren't UTF-8 count as one replacement character each; a table without any
base span trains no model and adds none; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.llm.common import mix, prefix_hash, slices, span_hash, staged

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
LEAST_VALUE = 6

DIM = 1 << 18
MAX_FOUND, MAX_CLEAN = 200, 200
WINDOW, WINDOWS = 48, 4
ROUNDS, RATE, PENALTY = 60, 0.3, 1e-3
SLICE_BYTES = 4 << 20
O, B, I = 0, 1, 2
_OUT = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

_KIND = np.full(256, 2, dtype=np.uint8)  # white space 0, characters of a word 1, others one token each
_KIND[[*range(0x21)]] = 0
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-"]] = 1
_KIND[0x80:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CHAR = np.full(256, 3, dtype=np.uint8)  # digit 0, lower 1, upper 2, other 3
_CHAR[0x30:0x3A], _CHAR[0x61:0x7B], _CHAR[0x41:0x5B] = 0, 1, 2
_HEXDIGIT = np.zeros(256, dtype=bool)
_HEXDIGIT[[ord(c) for c in "0123456789abcdef"]] = True
FEATURES = 12


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the fixed patterns, sorted, and where the secrets themselves lie."""
    spans, values = [], []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            spans.append((m.start(), 1, m.end()))
            values.append(m.span())
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
        values.append(m.span())
    return sorted(spans), values


# ---- tokens and features of a slice ------------------------------------------------------------
class Tokens:
    """Tokens of several texts: starts, ends (bytes in ``b``), the text each is of, feature ids."""

    def __init__(self, texts: list[bytes]) -> None:
        self.b = b = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        self.text_at = np.cumsum([0, *[len(t) + 1 for t in texts]])
        kind = _KIND[b]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        after = np.concatenate([kind[1:], [0]]).astype(np.uint8)
        there = kind != 0
        self.start = np.flatnonzero(there & ((kind == 2) | (before != kind)))
        self.end = np.flatnonzero(there & ((kind == 2) | (after != kind))) + 1
        self.text = np.searchsorted(self.text_at, self.start, "right") - 1
        self.n_texts = len(texts)

    def _count(self, marks: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        return c[self.end] - c[self.start]

    def features(self) -> np.ndarray:
        """(tokens, FEATURES) ids of weights."""
        n = len(self.start)
        if not n:
            return np.zeros((0, FEATURES), np.int32)
        b, size = self.b, self.end - self.start
        char = _CHAR[b]
        digits, lowers, uppers = (self._count(char == c) for c in range(3))
        changes = self._count(np.concatenate([char[1:] != char[:-1], [False]]))
        letters, is_hex = lowers + uppers, self._count(_HEXDIGIT[b]) == size
        length = np.searchsorted([1, 2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64], size, "right")
        share = np.where(digits == 0, 0, np.where(digits == size, 3, np.where(2 * digits >= size, 2, 1)))
        mixed = np.minimum(changes, 15) * (digits > 0)
        odd = (size - digits - letters) > 0
        shape = ((((length * 4 + share) * 2 + is_hex) * 2 + (uppers > 0)) * 2 + (lowers > 0)) * 2 + odd
        with np.errstate(over="ignore"):
            word = span_hash(prefix_hash(_LOWER[b]), self.start, self.end)
        first = np.zeros(n, np.int64)
        for k in range(4):
            at = np.minimum(self.start + k, len(b) - 1)
            first = first * 257 + np.where(k < size, b[at].astype(np.int64) + 1, 0)
        file = self._file(size, digits)

        def near(k: int) -> np.ndarray:
            """The word k tokens away, 0 beyond the text."""
            out = np.zeros(n, np.uint64)
            if abs(k) < n:
                to, of = (slice(None, n - k), slice(k, None)) if k > 0 else (slice(-k, None), slice(None, n + k))
                out[to] = np.where(self.text[to] == self.text[of], word[of], np.uint64(0))
            return out

        last, last2, last3, following = near(-1), near(-2), near(-3), near(1)
        columns = [shape, length * 16 + mixed, word, last, last2, last3, following, first, file, file * 65536 + shape,
                   mixed * 4 + share]
        ids = np.zeros((n, FEATURES), np.int32)  # the last column is the constant
        with np.errstate(over="ignore"):
            for k, c in enumerate(columns):
                salt = np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
                ids[:, k] = 1 + (mix(c.astype(np.uint64) ^ salt) % np.uint64(DIM - 1)).astype(np.int32)
        return ids

    def _file(self, size: np.ndarray, digits: np.ndarray) -> np.ndarray:
        total = np.maximum(np.bincount(self.text, minlength=self.n_texts), 1)
        punctuation = np.bincount(self.text, _KIND[self.b[self.start]] == 2, minlength=self.n_texts) / total
        numeric = np.bincount(self.text, digits > 0, minlength=self.n_texts) / total
        ends = np.concatenate([[0], np.cumsum(self.b == 0x0A)])
        lines = ends[self.text_at[1:]] - ends[self.text_at[:-1]]
        code = (np.searchsorted([0.05, 0.2, 0.4], punctuation) * 4 + np.searchsorted([0.02, 0.1, 0.3], numeric)) * 4 \
            + np.searchsorted([2, 10, 100], lines, "right")
        return code[self.text]


def tags_of(tokens: Tokens, values: list[list[tuple[int, int]]], texts: list[str]) -> np.ndarray:
    """B, I, O of each token by the texts' secrets (code points)."""
    inside, begins = np.zeros(len(tokens.b) + 1, np.int64), np.zeros(len(tokens.b) + 1, dtype=bool)
    for k, (spans, t) in enumerate(zip(values, texts)):
        for s, e in spans:
            lo = int(tokens.text_at[k]) + len(t[:s].encode())
            hi = lo + len(t[s:e].encode())
            inside[lo] += 1
            inside[hi] -= 1
            begins[lo] = True
    depth = np.cumsum(inside)
    covered = np.concatenate([[0], np.cumsum(depth > 0)])
    secret = covered[tokens.end] > covered[tokens.start]
    opened = np.concatenate([[0], np.cumsum(begins & (depth > 0))])
    fresh = opened[tokens.end] > opened[tokens.start]
    first = secret & ~np.concatenate([[False], secret[:-1]])
    return np.where(secret, np.where(first | (fresh & (depth[tokens.start] < 2)), B, I), O)


# ---- the model ---------------------------------------------------------------------------------
def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _unary(weights: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores (.., 3) of the tags; O's are 0."""
    out = np.zeros((*ids.shape[:-1], 3))
    for k in range(ids.shape[-1]):
        out[..., 1:] += weights[ids[..., k]]
    return out


def likelihood(weights: np.ndarray, trans: np.ndarray, ids: np.ndarray, tags: np.ndarray, length: np.ndarray):
    """Log-likelihood of the windows (chains between two O), and its derivatives.

    ``ids`` is (windows, tokens, features), padded behind ``length`` tokens.
    """
    n, m = tags.shape
    u = _unary(weights, ids)
    there = np.arange(m)[None, :] < length[:, None]
    fwd, bwd = np.zeros((n, m, 3)), np.zeros((n, m, 3))
    fwd[:, 0] = u[:, 0] + trans[O]
    for t in range(1, m):
        step = _lse(fwd[:, t - 1, :, None] + trans[None], 1) + u[:, t]
        fwd[:, t] = np.where(there[:, t, None], step, fwd[:, t - 1])
    whole = _lse(fwd[:, -1] + trans[:, O], 1)
    bwd[:, -1] = trans[:, O]
    for t in range(m - 2, -1, -1):
        step = _lse(trans[None] + (u[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        bwd[:, t] = np.where(there[:, t + 1, None], step, trans[:, O])
    node = np.exp(fwd + bwd - whole[:, None, None]) * there[..., None]
    truth = np.eye(3)[tags] * there[..., None]
    pair = (fwd[:, :-1, :, None] + trans + (u + bwd)[:, 1:, None, :]) - whole[:, None, None, None]
    both = there[:, 1:]
    g_trans = (np.einsum("nta,ntb->ab", truth[:, :-1] * both[..., None], truth[:, 1:])
               - (np.exp(pair) * both[..., None, None]).sum(axis=(0, 1)))
    last = length - 1
    rows = np.arange(n)
    g_trans[O] += (truth[:, 0] - node[:, 0]).sum(axis=0)
    g_trans[:, O] += (truth[rows, last] - node[rows, last]).sum(axis=0)
    off = (truth - node)[..., 1:][there]
    grad = np.stack([np.bincount(ids[there].ravel(), np.repeat(off[:, c], ids.shape[-1]), minlength=len(weights))
                     for c in range(2)], axis=1)
    path = (u * truth).sum() + trans[O, tags[:, 0]].sum() + trans[tags[rows, last], O].sum() \
        + (trans[tags[:, :-1], tags[:, 1:]] * both).sum()
    return path - whole.sum(), grad, g_trans


def fit(ids: np.ndarray, tags: np.ndarray, length: np.ndarray, rounds: int = ROUNDS):
    """Weights (DIM, 2) and transitions (3, 3) by AdaGrad on the penalised likelihood."""
    weights, trans = np.zeros((DIM, 2)), np.zeros((3, 3))
    used = np.unique(ids[np.arange(tags.shape[1])[None, :] < length[:, None]])
    local = np.searchsorted(used, ids).clip(0, len(used) - 1).astype(np.int32)  # only features that occur
    w, sq_w, sq_t = np.zeros((len(used), 2)), np.full((len(used), 2), 1e-8), np.full((3, 3), 1e-8)
    for _ in range(rounds):
        _, g, g_t = likelihood(w, trans, local, tags, length)
        g, g_t = g - PENALTY * w * len(ids), g_t - PENALTY * trans * len(ids)
        sq_w, sq_t = sq_w + g * g, sq_t + g_t * g_t
        w, trans = w + RATE * g / np.sqrt(sq_w), trans + RATE * g_t / np.sqrt(sq_t)
    weights[used] = w
    return weights.astype(np.float32), trans


def open_tokens(u: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """True where a token could be other than O on the best path: with any neighbours, a tag y in
    place of O changes the transitions by at most ``gain`` of y."""
    gain = [(trans[:, y, None] + trans[None, y, :] - trans[:, O, None] - trans[None, O, :]).max() for y in (B, I)]
    return (u[:, B] + gain[0] >= 0) | (u[:, I] + gain[1] >= 0)


def viterbi(u: np.ndarray, trans: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Tags of the best paths of all texts; each text is a chain between two O."""
    tags = np.zeros(len(u), np.int64)
    at = np.flatnonzero(open_tokens(u, trans))
    if not len(at):
        return tags
    new = np.concatenate([[True], (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])])
    first = at[new]
    length = np.diff(np.append(np.flatnonzero(new), len(at)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    score = u[first] + trans[O]
    came = []
    for t in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -t))  # runs longer than t
        options = score[:n, :, None] + trans[None]
        came.append(options.argmax(axis=1).astype(np.int8))
        score[:n] = options.max(axis=1) + u[first[:n] + t]
    tag = (score + trans[:, O]).argmax(axis=1)
    tags[first + length - 1] = tag
    for t in range(int(length[0]) - 1, 0, -1):
        n = int(np.searchsorted(-length, -t))
        tag[:n] = came[t - 1][np.arange(n), tag[:n]]
        tags[first[:n] + t - 1] = tag[:n]
    return tags


def decoded_spans(tokens: Tokens, tags: np.ndarray) -> list[list[tuple[int, int]]]:
    """(start, end) in code points of the tagged secrets of each text; an I without a B opens one."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(tokens.n_texts)]
    some = np.flatnonzero(tags)
    if not len(some):
        return out
    opens = (tags[some] == B) | np.concatenate([[True], (np.diff(some) > 1)
                                                | (tokens.text[some[1:]] != tokens.text[some[:-1]])])
    lo = some[opens]
    hi = some[np.append(np.flatnonzero(opens)[1:] - 1, len(some) - 1)]
    points = np.concatenate([[0], np.cumsum((tokens.b & 0xC0) != 0x80)])
    base = points[tokens.text_at[tokens.text[lo]]]
    for k, s, e in zip(tokens.text[lo].tolist(), (points[tokens.start[lo]] - base).tolist(),
                       (points[tokens.end[hi]] - base).tolist()):
        out[k].append((s, e))
    return out


# ---- Spark -------------------------------------------------------------------------------------
def _strings(part: pa.RecordBatch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in part.column("text").to_pylist()]


def _windows(texts: list[str], values: list[list[tuple[int, int]]], hashes: list[int]):
    """Per text: token ids, tags and lengths of its windows."""
    tokens = Tokens([t.encode() for t in texts])
    ids, tags = tokens.features(), tags_of(tokens, values, texts)
    for k, h in enumerate(hashes):
        mine = np.flatnonzero(tokens.text == k)
        if not len(mine):
            continue
        lo, hi = int(mine[0]), int(mine[-1]) + 1
        rng = np.random.default_rng(h & 0xFFFFFFFF)
        starts, last = [], lo
        for s in (np.flatnonzero(tags[lo:hi] == B) + lo).tolist():
            if len(starts) < WINDOWS and s >= last:
                starts.append(max(lo, s - int(rng.integers(4, WINDOW // 2))))
                last = starts[-1] + WINDOW
        starts += rng.integers(lo, max(lo + 1, hi - WINDOW), WINDOWS).tolist()
        yield h, [(ids[s:min(hi, s + WINDOW)], tags[s:min(hi, s + WINDOW)]) for s in starts]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first texts by hash of a task, with and without base spans, as windows."""
    heaps: dict[bool, list] = {True: [], False: []}
    most = {True: MAX_FOUND, False: MAX_CLEAN}
    seen: dict[bool, set] = {True: set(), False: set()}
    for batch in batches:
        for part in slices(batch, size=SLICE_BYTES):
            for h, t in zip(part.column("h").to_pylist(), part.column("text").to_pylist()):
                if not t or all(len(heaps[f]) == most[f] and -heaps[f][0][0] <= h for f in heaps):
                    continue
                text = t.decode("utf-8", "replace")
                _, values = base_spans(text)
                found = bool(values)
                if h in seen[found]:
                    continue
                if len(heaps[found]) < most[found]:
                    put = heapq.heappush
                elif h < -heaps[found][0][0]:
                    put = heapq.heappushpop
                else:
                    continue
                gone = put(heaps[found], (-h, *next(iter(_packed_windows([text], [values], [h])), ())))
                seen[found].add(h)
                if gone:
                    seen[found].discard(-gone[0])
    for found, heap in heaps.items():
        rows = [(-r[0], *r[1:]) for r in heap if len(r) > 1]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([found] * len(rows)),
                 *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]], ["h", "found", "ids", "tags", "length"])


def _packed_windows(texts, values, hashes):
    for _, windows in _windows(texts, values, hashes):
        yield (np.concatenate([i for i, _ in windows]).astype(np.int32).tobytes(),
               np.concatenate([t for _, t in windows]).astype(np.int8).tobytes(),
               np.array([len(t) for _, t in windows], np.int32).tobytes())


def train(docs: DataFrame):
    """Weights and transitions from the sample of ``docs``; None where it holds no base span."""
    rows = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("string").cast("binary").alias("text"))
    sample = staged(rows.mapInArrow(_sampled, "h long, found boolean, ids binary, tags binary, length binary"),
                    "crf-sample").dropDuplicates(["h", "found"])
    picked = []
    for found, most in ((True, MAX_FOUND), (False, MAX_CLEAN)):
        picked.append(sample.where(F.col("found") == found).orderBy("h").limit(most).collect())
    if not picked[0]:
        return None
    ids, tags, lengths = [], [], []
    for r in [*picked[0], *picked[1]]:
        i, t = np.frombuffer(r["ids"], np.int32).reshape(-1, FEATURES), np.frombuffer(r["tags"], np.int8)
        at = 0
        for n in np.frombuffer(r["length"], np.int32).tolist():
            ids.append(np.pad(i[at:at + n], ((0, WINDOW - n), (0, 0))))
            tags.append(np.pad(t[at:at + n], (0, WINDOW - n)))
            lengths.append(n)
            at += n
    return fit(np.stack(ids), np.stack(tags).astype(np.int64), np.array(lengths))


def tag_texts(texts: list[str], model) -> list[list[tuple[int, int]]]:
    """The model's spans of each text, in code points."""
    tokens = Tokens([t.encode() for t in texts])
    u = _unary(model[0], tokens.features())
    return decoded_spans(tokens, viterbi(u, model[1], tokens.text))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model) -> DataFrame:
    """The contract's row for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                texts = _strings(part)
                base = [base_spans(t)[0] for t in texts]
                added = tag_texts(texts, shared.value) if shared.value else [[] for _ in texts]
                every = []
                for spans, more in zip(base, added):
                    more = [(s, 3, e) for s, e in more if all(e <= s0 or e0 <= s for s0, _, e0 in spans)]
                    every.append(_joined(sorted(spans + more)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    **{f"n_{kind}": pa.array([sum(k == c for _, k, _ in x) for x in base], pa.int64())
                       for c, kind in enumerate(KINDS[:3])},
                    "base_sha256": pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]),
                    "spans": pa.array(every, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(made, _OUT)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Train on a sample of ``docs`` (doc_id, text) and scan all of them."""
    return scan(docs, train(docs))


def op12_secret_crf(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
