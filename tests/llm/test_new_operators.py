"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlap.llm import token_align, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "s", 0) for i, t in rows], DOCS)


# ---- 11: alignment ---------------------------------------------------------------------------
def _whole_alignment(rows):
    """Whole texts through the two libraries, links by comparing every token pair's ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_align.MODEL_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_align.MODEL_B)
    symbol = token_align.byte_symbols()
    entry = {i: bytes(symbol[c] for c in t) for t, i in json.load(open(token_align.MODEL_A))["model"]["vocab"].items()}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5 + 0], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at += len(of(i))
        return out

    links, out, holders = [], [], Counter()
    for doc_id, text in rows:
        x = y = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = (" " + text).encode()
            if b"".join(entry[i] for i in ia) == whole == b"".join(map(piece, ib)):
                x, y = spans(ia, entry.__getitem__), spans(ib, piece)
        mine = [(i, j) for i, s, e in x for j, t, f in y if s < f and t < e]
        ends = sorted({e for *_, e in x} & {e for *_, e in y})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            groups.append(",".join(str(i) for i, s, e in x if lo <= s and e <= hi) + "|"
                          + ",".join(str(i) for i, s, e in y if lo <= s and e <= hi))
        links.append(mine)
        holders.update(set(mine))
        text_of = ";".join(groups)
        out.append([doc_id, len(x), len(y), len(groups), len(mine),
                    hashlib.sha256(text_of.encode()).hexdigest() if x else ""])
    most = defaultdict(int)
    for (i, _), n in holders.items():
        most[i] = max(most[i], n)
    return [(*o[:5], sum(holders[p] == most[p[0]] for p in mine), sum(holders[p] for p in mine), o[5])
            for o, mine in zip(out, links)]


def _aligned(df):
    r = token_align.align_documents(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                               "count_sum", "groups_sha256").collect()
    return sorted(map(tuple, r), key=str)


ODD_TEXTS = ["", None, " ", "  two  blanks ", "a", "tab\tand\nline\r\n end ", "it's we'll I'D", "x  y  z",
             "▁marker", "<s> </s> <unk> <|endoftext|> <0x41>", "naïve café Ünïcödé 漢字かな 🙂🙂 é",
             "aaa aa a aaaa" * 3, "123 4567 89,000.5", "word \n next", "ends with blank ", " starts", "a\u0000b",
             "x \x1c y \x85z", "- -- --- ...", "$$$ ### %%% &&& ***", "a  b", "The the THE", "​ ​z"]


def test_alignment_equals_whole_text_encoding(spark):
    rng = random.Random(3)
    words = ["the", "antithetical", "éa", "token", "ization", "x1", "don't", "(a)", "ﬁ", "über", "12", "\n", " "]
    texts = ODD_TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(40)]
    texts += ["".join(rng.choice("ab \n\té'1.") for _ in range(60)) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (None, "null id"), (7, "other text of the same id")]
    got = _aligned(_docs(spark, rows).repartition(3))
    assert got == sorted(_whole_alignment(rows), key=str)


def test_alignment_over_several_slices_and_a_small_cache(spark, monkeypatch):
    rows = [(i, f"common words and {i} of them, token{i % 7}") for i in range(60)]
    want = sorted(_whole_alignment(rows), key=str)
    monkeypatch.setattr(token_align, "SLICE_BYTES", 64)
    files = token_align.tokenizer_files()
    al = token_align.Aligner(*files)
    for _, t in rows[:5]:
        al.words(t)
        al.align_new()
        al.clear()
    assert _aligned(_docs(spark, rows).repartition(4)) == want


def test_alignment_of_a_real_table_and_of_none(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(40).collect()]
    assert _aligned(_docs(spark, rows)) == sorted(_whole_alignment(rows), key=str)
    none = token_align.align_documents(_docs(spark, []))
    assert none.collect() == [] and none.columns[-1] == "groups_sha256"


# ---- 13: whitening ---------------------------------------------------------------------------
EMB = "vec_id long, embedding array<double>, label int, component int, n long"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], EMB)


def _brute_whitening(rows):
    x = [(i, np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000) for i, v in rows]
    fit = np.unique(np.stack([v for _, v in x]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (n * fit - s) / n
    values, basis = np.linalg.eigh(z.T @ z / n)
    return n, s, values[::-1], basis[:, ::-1], x


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24)) * np.linspace(0.2, 4, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5, base[5].tolist()), (900, base[7].tolist())]
    odd = [(1001, None), (1002, [1.0, None] * 12), (1003, [float("nan")] * 24), (1004, [float("inf")] * 24),
           (1005, []), (1006, [1.0]), (1007, [1e300] * 24)]
    got = whitening.whiten(_vectors(spark, rows + odd)).toPandas()
    n, s, values, basis, x = _brute_whitening(rows)
    assert set(got.vec_id) == {i for i, _ in rows} and len(got) == 16 * len(rows)
    assert set(got.n) == {n} == {300}
    sign = {}
    for i, v in x:
        mine = got[got.vec_id == i]
        assert set(mine.deviation) == {int(((n * v - s) ** 2).sum())}
        want = (n * v - s) / n @ basis[:, :16] / np.sqrt(values[:16])
        for c, w in zip(mine.component, mine.whitened):
            sign.setdefault(c, np.sign(w * want[c - 1]) or 1)
            assert abs(sign[c] * w - want[c - 1]) < 1e-8
    share = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(share - values[:16] / values.sum()).max() < 1e-12
    assert set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-9


def test_whitening_of_few_and_equal_vectors(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(5)]
    got = whitening.whiten(_vectors(spark, line)).toPandas()
    assert set(got.component) == {1} and abs(got.explained[0] - 1) < 1e-12 and got.identity_error[0] < 1e-9
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(_vectors(spark, [])).collect() == []
    assert whitening.whiten(_vectors(spark, [(None, [0.0, 0.0]), (2, [0.0, 1.0])])).count() == 2


@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
def test_eigenvectors_of_hard_matrices(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    spectra = [np.ones(d), np.repeat([5.0, 1.0], d)[:d], np.r_[np.full(d // 2, 2.0), np.full(d - d // 2, 2 - 1e-13)],
               np.r_[1.0, np.zeros(d - 1)], np.linspace(1, 2, d), 10.0 ** -np.arange(d)]
    for e in spectra:
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        k = min(16, d)
        values, basis = whitening.leading_eigenvectors(a, k)
        assert np.abs(values - np.sort(e)[::-1][:k]).max() < 1e-13 * max(1, e.max()) * 10
        assert np.abs(basis.T @ basis - np.eye(k)).max() < 1e-12
        assert np.abs(a @ basis - basis * values).max() < 1e-12 * max(1, e.max())


def test_large_deviations_are_exact_or_null():
    x = np.array([[1 << 40, 0], [3, 1 << 20]], dtype=np.int64)
    n, s = 1 << 12, np.array([1 << 42, 5], dtype=object)
    q, r = (np.array([int(v) // n for v in s]), np.array([int(v) % n for v in s]))
    want = [sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, s)) for row in x]
    assert whitening._deviations(x, n, q, r) == [w if w < 1 << 63 else None for w in want]


# ---- 12: secrets -----------------------------------------------------------------------------
from overlap.llm import secret_crf as crf  # noqa: E402


def _plain_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


SECRET_TEXTS = ["", "token:token:abcdefg", "PASSWORD = 'abc123x' api_key: zz", "ApiKey=\"k1/k2+k3==\" secret :abcde",
                "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 9, "AKIA" + "Z9" * 12, "deadbeef" * 3 + "g" + "a" * 23,
                "é€ token=é password=sécret123", "ſecret=abcdefgh toKen=abcdefgh", "x" * 50 + "0123456789abcdef" * 4]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["token", "=", ":", " ", "secret", "abcdef", "12", "\"", "'", "AKIA", "ABCDEFGH12", "deadbeef", "\n", "é", "Api_Key"]
    texts = SECRET_TEXTS + ["".join(rng.choice(parts) for _ in range(30)) for _ in range(500)]
    for t in texts:
        assert crf.base_spans(t)[0] == _plain_base(t), t


def _all_paths(u, trans):
    import itertools
    return {p: sum(u[t, y] for t, y in enumerate(p)) + trans[0, p[0]] + trans[p[-1], 0]
            + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=len(u))}


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_and_likelihood_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    trans = rng.standard_normal((3, 3))
    chains = [rng.standard_normal((n, 3)) * np.array([0, 3, 3]) - np.array([0, 2, 2]) * (seed % 2)
              for n in (1, 2, 5, 7, 3)]
    u, text = np.concatenate(chains), np.repeat(np.arange(5), [len(c) for c in chains])
    tags = crf.viterbi(u, trans, text)
    for k, c in enumerate(chains):
        paths = _all_paths(c, trans)
        assert abs(paths[tuple(tags[text == k])] - max(paths.values())) < 1e-9
    # the likelihood and its derivatives, by all paths and by differences
    ids = rng.integers(0, 6, (3, 5, 4)).astype(np.int32)
    gold, length, w = rng.integers(0, 3, (3, 5)), np.array([5, 3, 1]), rng.standard_normal((6, 2))
    value, g, g_t = crf.likelihood(w, trans, ids, gold, length)
    want = 0.0
    for i, n in enumerate(length):
        paths = _all_paths(crf._unary(w, ids[i, :n]), trans)
        want += paths[tuple(gold[i, :n])] - np.log(sum(np.exp(v) for v in paths.values()))
    assert abs(value - want) < 1e-8
    for at in np.ndindex(6, 2):
        step = np.zeros_like(w)
        step[at] = 1e-6
        d = (crf.likelihood(w + step, trans, ids, gold, length)[0] - crf.likelihood(w - step, trans, ids, gold, length)[0])
        assert abs(d / 2e-6 - g[at]) < 1e-5
    for at in np.ndindex(3, 3):
        step = np.zeros((3, 3))
        step[at] = 1e-6
        d = crf.likelihood(w, trans + step, ids, gold, length)[0] - crf.likelihood(w, trans - step, ids, gold, length)[0]
        assert abs(d / 2e-6 - g_t[at]) < 1e-5


def _scan(spark, rows):
    return sorted(map(tuple, crf.scan_secrets(_docs(spark, rows)).collect()), key=str)


def test_scan_keeps_base_spans_and_defined_cases(spark):
    rows = [*enumerate(SECRET_TEXTS), (50, None), (None, SECRET_TEXTS[2]), (3, SECRET_TEXTS[3])]
    got = _scan(spark, rows)
    want = []
    for i, t in rows:
        base = _plain_base(t or "")
        text = ",".join(f"{crf.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((i, *[sum(k == c for _, k, _ in base) for c in range(3)], hashlib.sha256(text.encode()).hexdigest(), text))
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert set(filter(None, w[5].split(","))) <= set(g[5].split(","))
        keys = [(int(x.split(":")[1]), crf.KINDS.index(x.split(":")[0])) for x in g[5].split(",") if x]
        assert keys == sorted(keys)
    assert crf.scan_secrets(_docs(spark, [])).collect() == []
    assert [r["spans"] for r in crf.scan_secrets(_docs(spark, [(1, "no secrets here"), (2, None)])).collect()] == ["", ""]


def test_the_model_finds_secrets_that_the_patterns_miss(spark):
    """Keys of a form that the patterns know, in places where they don't look."""
    rng = random.Random(2)
    words = "the of and there was once a long walk home by river in spring".split()
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18))
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(400):
        t = prose(60)
        if i % 4 == 0:
            t += f" password={value()} " + prose(30)
        rows.append((i, t))
    hidden = [(1000 + i, prose(40) + f" passphrase={value()} " + prose(20)) for i in range(40)]
    model = crf.train(_docs(spark, rows))
    got = {r["doc_id"]: r["spans"] for r in crf.scan(_docs(spark, rows + hidden), model).collect()}
    found = sum("crf:" in got[i] for i, _ in hidden)
    assert found >= 36, found
    assert sum("crf:" in got[i] for i, _ in rows) <= 4
    for i, t in hidden:
        for s in got[i].split(","):
            if s.startswith("crf:"):
                _, a, b = s.split(":")
                assert set(t[int(a):int(b)]) <= set("0123456789abcdef")


def test_held_out_agreement_of_the_model_with_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = crf.train(docs)
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    hit = total = extra = 0
    for t, spans in zip(texts, crf.tag_texts(texts, model)):
        values = crf.base_spans(t)[1]
        total += len(values)
        hit += sum(any(s < e0 and s0 < e for s, e in spans) for s0, e0 in values)
        extra += sum(all(e <= s0 or e0 <= s for s0, e0 in values) for s, e in spans)
    assert total and hit >= 0.95 * total and extra <= 0.02 * len(texts)


# ---- 1: ids beyond 2^53 ----------------------------------------------------------------------
def test_archive_ids_stay_exact_beside_nulls(spark, tmp_path):
    from overlap.llm import warc_chain

    big = 1 << 60
    rows = [(big + 1, "u1", "<p>same</p>"), (big + 3, "u2", "<p>same</p>"), (big + 7, "u3", "<p>other</p>"),
            (None, "u4", "<p>third</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc_chain.write_archives(pages, str(tmp_path / "w"))
    got = {(r["page_id"], r["refers_to"]) for r in warc_chain.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {(big + 1, big + 3), (big + 3, None), (big + 7, None), (None, None)}


# ---- repairs of earlier operators ---------------------------------------------------------------
def test_equal_texts_share_a_shard_but_at_cuts(spark):
    from overlap.llm import kd_shards

    rows = [(i, f"text {i // 2:06d}") for i in range(4000)]  # pairs of one length
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {}
    for r in kd_shards.kd_shards(docs).collect():
        by.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in by.values()) <= 39  # one group a cut


@pytest.mark.parametrize("text,letters", [("\u00bd \u00b2", 0), ("\u2167", 0), ("\u2460", 0), ("\u0301", 0),
                                          ("a\u0301", 1), ("\u0939\u093f\u0928\u094d\u0926\u0940", 1)])
def test_only_letters_make_a_language(text, letters):
    from overlap.llm import lang_ftrl

    got = lang_ftrl.counts_of(text)
    assert (got is not None) == bool(letters)
    if len(text) == 6:  # marks stay within the word: one word of six code points, eight with its blanks
        assert got[1].sum() == 8 + 7 + 6


def test_toxic_sample_takes_one_row_an_id(spark, monkeypatch):
    from overlap.llm import toxic_mil

    seen = []
    monkeypatch.setattr(toxic_mil, "fit", lambda bags, labels: seen.extend(labels))
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit("some words").alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    toxic_mil.train(docs, labels)
    assert 0 < len(seen) <= 3


def test_nearest_of_vectors_whose_squares_overflow():
    from overlap.llm import block_ann

    rng = np.random.default_rng(4)
    for scale in (1e200, 1e300, 1.0, 1e-200):
        q, c = rng.standard_normal((5, 8)) * scale, rng.standard_normal((40, 8)) * scale
        c[0] = 1e-150
        at, to = block_ann._tile(*block_ann._tame(q, c), np.zeros((5, 40), bool), 3)
        got = {(a, t) for a, t in zip(at.tolist(), to.tolist())}
        with np.errstate(over="ignore"):
            true = np.sqrt((((q[:, None] - c[None]) / scale) ** 2).sum(axis=2))
        for i in range(5):
            assert {(i, int(t)) for t in np.argsort(true[i])[:3]} <= got
        score = block_ann._exact(q[at], c[to])
        if scale > 1:
            assert np.isfinite(score).all()
            np.testing.assert_allclose(score / scale, true[at, to], rtol=1e-9)
