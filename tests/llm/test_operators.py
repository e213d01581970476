"""The ten corpus operators against brute force on small tables with every edge case."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlap.llm import (block_ann, components, content_sort, entropy_mix, kd_shards, lang_ftrl,
                         piece_viterbi, suffix_dedup, token_groups, toxic_mil, warc_chain)
from overlap.llm.common import keep_rows, screened, text_hash

#: extra columns whose names the operators use themselves
CLASH = ["node", "h", "text_hash", "size", "rank", "copies", "sig", "did", "dup", "n", "run", "shard"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, parts=3):
    """documents with the given (doc_id, text[, lang, source]) rows, and clashing columns."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit("x") for c in CLASH})


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus(seed=5, n=60):
    """Random texts with copies, near copies, shared passages, empties, nulls and a long one."""
    rng = random.Random(seed)
    passage, rows = words(rng, 40), []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            t = rng.choice(rows)[1]
        elif kind < 0.35 and rows:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = "edit%d" % i
            t = " ".join(w)
        elif kind < 0.5:
            t = words(rng, rng.randint(5, 30)) + " " + passage + "\n" + words(rng, rng.randint(1, 30))
        else:
            t = words(rng, rng.randint(1, 120))
        if rng.random() < 0.1 and t:
            t = t.upper()
        rows.append((i, t, None, f"s{i % 4}" if i % 7 else None))
    rows += [(n, "", None, "s1"), (n + 1, None, None, None), (n + 2, "Ünïcode ▁ \t mark x", None, "s2"),
             (n + 3, words(rng, 4000), None, "s1"), (n + 4, "two words", None, "s0"),
             (n + 5, "TWO words", None, "s0")]
    return rows


def lower(t):
    return (t or "").encode().lower()


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).limit(0)


# ---- 1 WARC -----------------------------------------------------------------------------------
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit("x"))


def test_warc_round_trip(spark, tmp_path):
    trap = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 77\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
            "tail\r\n\r\n")
    given = [(i, f"http://x/{i}", f"<p>{i % 5}</p>" * (i % 3)) for i in range(40)]
    given += [(40, "u\r\nWARC-Type: forged", trap), (41, None, trap), (42, "http://y", None),
              (43, "http://z", "é" * 5000 + "\n"), (43, "http://z", "é" * 5000 + "\n"),
              (None, "http://w", "only"), (44, "http://v", "\r\n\r\n")]
    path = str(tmp_path / "warc")
    warc_chain.write_archives(pages(spark, given), path)
    got = warc_chain.read_archives(spark, path)
    heads = {}
    for i, _, h in given:
        heads[h or ""] = max([x for x in (heads.get(h or ""), i) if x is not None], default=None)
    want, seen = [], Counter()
    for i, _, h in given:
        body, head = (h or "").encode(), heads[h or ""]
        first = i == head and not seen[(i, h or "")]
        seen[(i, h or "")] += 1
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "response" if first else "revisit", None if first else head))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted(map(str, have)) == sorted(map(str, want))
    # the forged header and the record inside the payload were candidates, and were rejected
    assert all(r.page_id != 77 for r in got.collect())


def test_warc_small_payloads_and_empty_table(spark, tmp_path):
    given = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]
    warc_chain.write_archives(pages(spark, given), str(tmp_path / "a"), min_bytes=5)
    got = {r.page_id: (r.record_type, r.refers_to)
           for r in warc_chain.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    warc_chain.write_archives(pages(spark, given).limit(0), str(tmp_path / "b"))
    assert warc_chain.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_warc_long_url_breaks_no_chain(spark, tmp_path):
    given = [(0, "data:text/plain," + "x" * 200_000, "first")] + [(i, f"u{i}", f"page {i}") for i in range(1, 6)]
    path = str(tmp_path / "warc")
    warc_chain.write_archives(pages(spark, given).coalesce(1), path)
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc_chain.read_archives(spark, path).collect()}
    assert got == {i: (len(h), "response") for i, _, h in given}


def test_warc_headers_of_candidates_that_share_a_blank_line():
    m = warc_chain.MAGIC
    data = (m + b"no name\r\n" + m + b"A: 1\r\nb: 2\r\nA: 3\r\nx:" + m + b"b: 4\r\n\r\nblock" + m + b"\r\n"
            + b"c: 5\r\n\r\n" + m + b"d: 6")
    headers, at, got = warc_chain._Headers(data), data.find(m), []
    while at >= 0:
        got.append(headers.at(at))
        at = data.find(m, at + 1)
    start = data.find(b"block")
    assert got == [None, ({"a": "3", "b": "4", "x": "WARC/1.1"}, start), ({"b": "4"}, start), None, None]


def test_pointer_jumping_keeps_the_chain():
    rng = random.Random(2)
    for _ in range(50):
        chain = np.cumsum([0, *[rng.randint(1, 9) for _ in range(rng.randint(1, 40))]])
        offsets, nexts = list(chain[:-1]), list(chain[1:])
        others = [x for x in range(int(chain[-1])) if x not in set(chain) and rng.random() < 0.4]
        offsets += others
        nexts += [rng.randint(x + 1, int(chain[-1])) for x in others]
        order = rng.sample(range(len(offsets)), len(offsets))
        o, s = np.array(offsets)[order], np.array(nexts)[order]
        assert sorted(o[warc_chain.reachable(o, s)]) == list(chain[:-1])


# ---- 2 suffix dedup ---------------------------------------------------------------------------
def brute_spans(docs, length=100):
    seen, out = set(), {}
    for i, t in docs:
        b, last = (t or "").encode(), 0
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                cover[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for _ in re.finditer(rb"\x01+", bytes(cover)))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_matches_brute_force(spark, rows, docs):
    rng = random.Random(3)
    extra = [(100, "ab" * 400), (101, "x" * 250), (102, "x" * 251 + "y"), (103, words(rng, 60))]
    extra += [(104, extra[3][1][:150] + "é" * 120 + extra[3][1][150:])]
    all_rows = [(r[0], r[1]) for r in rows] + extra
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.suffix_dedup(table(spark, all_rows)).collect()}
    assert got == brute_spans(sorted(all_rows))
    assert sum(v[1] for v in got.values()) > 2000


def test_suffix_dedup_repeated_rows_null_ids_and_empty(spark, empty):
    t = "q" * 60 + words(random.Random(1), 40)
    got = suffix_dedup.suffix_dedup(table(spark, [(7, t), (7, t), (None, t), (9, None)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted(
        [("7", 0), ("7", len(t)), ("None", len(t)), ("9", 0)])
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_deep_shallow_orders_and_prefixes():
    rng = random.Random(4)
    for _ in range(100):
        base = bytes(rng.choice(b"ab\0") for _ in range(50))
        strings = [base[:rng.randint(0, 50)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30)))
                   for _ in range(rng.randint(1, 15))]
        group = np.array([rng.randint(0, 1) for _ in strings])
        rank, edge = suffix_dedup.deep_shallow(group, strings, 60)
        order = np.argsort(rank)
        assert [(group[i], strings[i][:60]) for i in order] == sorted(
            (g, s[:60]) for g, s in zip(group, strings))
        for a, b, e in zip(order, order[1:], edge[1:]):
            shared = next((k for k, (x, y) in enumerate(zip(strings[a], strings[b])) if x != y),
                          min(len(strings[a]), len(strings[b])))
            assert e == (-1 if group[a] != group[b] else min(60, shared))


# ---- 3 pieces ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    pieces, scores, byte_ids = piece_viterbi.load_vocabulary(piece_viterbi.MODEL)
    return piece_viterbi.Codec(pieces, scores, byte_ids, *piece_viterbi.double_array(pieces)), pieces, scores


def plain_viterbi(text, pieces, scores, unknown):
    """The best score of a whole text over characters, without trie, words or cache."""
    ids = {p: s for p, s in zip(pieces, scores) if p}
    chars = [piece_viterbi.MARK.decode()] + [
        "\0mark" if c == "▁" else piece_viterbi.MARK.decode() if c == " " else c for c in text]
    best = [0.0] + [-math.inf] * len(chars)
    for i in range(len(chars)):
        single = chars[i].encode() in ids
        for j in range(i + 1, min(len(chars), i + 20) + 1):
            if "\0mark" in chars[i:j]:
                break
            s = ids.get("".join(chars[i:j]).encode())
            if s is not None:
                best[j] = max(best[j], best[i] + s)
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


def test_viterbi_is_best_and_lossless(codec, rows):
    c, pieces, scores = codec
    texts = [r[1] for r in rows if r[1]][:25] + ["  two  blanks ", "\n\nline", "tab\tü日本 🙂", "▁▁ x▁y", " "]
    for t in texts:
        t = t[:400]
        ids = c.encode(t.encode())
        assert c.decode(ids) == t.encode()
        assert c.score(ids) == pytest.approx(plain_viterbi(t, pieces, scores, c.unknown), abs=1e-3)


def test_pieces_have_probabilities_of_the_documents(spark):
    """Merge ranks split ' the' and ' information'; likelihoods of a text that repeats them do not."""
    text = "the information of the house in the form of information " * 20
    docs = table(spark, [(i, text) for i in range(5)] + [(9, None), (10, "zq ▁x 日 🙂 " + "y" * 5000)])
    built = piece_viterbi._built(piece_viterbi.MODEL)
    scores = piece_viterbi.estimate(docs, built)
    normal = [bool(p) for p in built[0]]
    assert np.exp(scores[normal]).sum() == pytest.approx(1)
    assert (scores == piece_viterbi.estimate(docs, built)).all()
    got = {r.doc_id: r for r in piece_viterbi.encode_documents(docs).collect()}
    assert [built[0][i].decode() for i in got[0].token_ids][:5] == ["▁the", "▁information", "▁of", "▁the", "▁house"]
    assert got[0].score == pytest.approx(scores[got[0].token_ids].sum())
    assert all(r.lossless for r in got.values())


def test_expected_counts_match_all_segmentations(codec):
    """The sum over every path, for short words, some with markers and characters that are no piece."""
    _, pieces, _ = codec
    built = piece_viterbi._built(piece_viterbi.MODEL)
    scores = piece_viterbi.log_probabilities(np.arange(len(pieces)) % 97, pieces)
    c = piece_viterbi.Codec(pieces, scores, *built[2:])
    for word in (" then", "  in", "a▁b", " 🙂x", "\n"):
        paths = []

        def walk(i, path, score, s, own):
            if i == len(s):
                return paths.append((path, score))
            until = min([m for m in own if m >= i], default=len(s))
            ends = [j for j in range(i + 1, until + 1) if s[i:j] in c_ids]
            for j in ends:
                v = c_ids[s[i:j]]
                walk(j, [*path, v], score + scores[v], s, own)
            one = i + len(s[i:].decode()[0].encode())
            if one not in ends:
                walk(one, path, score + c.unknown, s, own)

        c_ids = {p: i for i, p in enumerate(pieces) if p}
        blanks = len(word) - len(word.lstrip(" "))
        s = piece_viterbi.MARK * blanks + word[blanks:].encode()
        own = [m.start() for m in re.finditer(piece_viterbi.MARK, s) if m.start() >= 3 * blanks]
        walk(0, [], 0.0, s, own)
        whole, want, got = sum(math.exp(x) for _, x in paths), Counter(), Counter()
        for path, x in paths:
            for v in path:
                want[v] += 3 * math.exp(x) / whole
        c.expected(word.encode(), 3, got)
        assert {v: n / piece_viterbi.FIXED for v, n in got.items() if n} == pytest.approx(
            {v: n for v, n in want.items() if v in got and got[v]}, abs=1e-3)
        assert sum(got.values()) / piece_viterbi.FIXED == pytest.approx(sum(want.values()), abs=1e-2)


def test_lattice_equals_the_words_one_at_a_time(codec):
    """Expected counts, best paths and ties of many words at once, odd ones among them."""
    _, pieces, _ = codec
    built = piece_viterbi._built(piece_viterbi.MODEL)
    rng = random.Random(6)
    parts = ["the", "ation", "x", "é", "漢", "🙂", "▁", "\t", "y" * 90, "0", "Ø", "ing"]
    words = list(dict.fromkeys(
        [" " * rng.randrange(4) + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
        + [" ", "   ", "\n", "a" * 3000]))
    words = [w.encode() for w in words] + [b" \xff\xfe", b"\xa9x"]
    for scores in (piece_viterbi.log_probabilities(np.arange(len(pieces)) % 97, pieces),
                   np.full(len(pieces), -3.0)):  # equal scores: ties everywhere
        c = piece_viterbi.Codec(pieces, scores, *built[2:])
        want, got = Counter(), np.zeros(len(pieces), np.int64)
        for k, w in enumerate(words):
            c.expected(w, 1 + k % 5, want)
        c.expected_of(words, [1 + k % 5 for k in range(len(words))], got)
        assert np.abs(got - np.array([want[i] for i in range(len(pieces))])).max() <= len(words)
        for w in words:
            c.numbers[w]
        c.solve()
        for k, w in enumerate(words):
            assert c.ids[c.at[k]:c.at[k + 1]].tobytes() == c._best(w), w


def test_double_array_holds_exactly_the_pieces(codec):
    c, pieces, _ = codec
    for i, p in enumerate(pieces):
        if p:
            state = 0
            for b in p:
                to = c.base[state] + b + 1
                assert c.check[to] == state
                state = to
            assert c.value[state] == i
    assert sum(v >= 0 for v in c.value) == sum(bool(p) for p in pieces)


def test_encode_and_decode_documents(spark, rows, docs, empty):
    out = piece_viterbi.encode_documents(docs).cache()
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(r.lossless for r in got.values())
    assert all(r.n_tokens == len(r.token_ids) for r in got.values())
    assert got[rows[-5][0]].n_tokens == 0  # a null text
    back = {r.doc_id: r.text for r in piece_viterbi.decode_documents(out).collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    assert piece_viterbi.encode_documents(empty).count() == 0


# ---- 4 n-gram join ----------------------------------------------------------------------------
def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 4 else {tuple(w[i:i + 4]) for i in range(len(w) - 3)}


def brute_components(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_components_match_brute_force(spark, rows, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in token_groups.ngram_components(docs).collect()}
    want = brute_components([(r[0], r[1]) for r in rows])
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_ngram_chain_of_links(spark):
    """Neighbours in a chain are linked, its ends are not: groups must join through the middle."""
    rng = random.Random(8)
    base, chain = words(rng, 120).split(), []
    for step in range(12):
        base = list(base)
        base[step * 9 + 3] = f"new{step}"
        chain.append(" ".join(base))
    rows = [(i * 3 % 12, t) for i, t in enumerate(chain[:4])] + [(20 + i, t) for i, t in enumerate(chain[4:])]
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in token_groups.ngram_components(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_signatures_miss_no_linked_pair():
    rng = np.random.default_rng(6)
    classes = token_groups._Classes(85)
    for trial in range(1500):
        n = int(rng.integers(1, 300)) if trial % 3 else int(rng.integers(1, 12))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 6 + 2))
        add = int(rng.integers(0, n // 6 + 2))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 85 * (len(x) + len(y) - both):
            assert len(np.intersect1d(classes.signatures(x), classes.signatures(y)))


def test_matrix_opens_only_what_may_hold_a_partner(spark):
    """The second step finds links between components that the first one did not compare."""
    base = [int(x) for x in range(100)]
    sets = {1: base, 2: base[:97] + [201, 202, 203], 3: base[:50] + list(range(300, 350)), 4: base[3:]}
    frame = spark.createDataFrame(list(sets.items()), "node long, tokens array<long>")
    buckets = spark.createDataFrame([(9, n, n) for n in sets], "sig long, node long, rep long")
    groups = spark.createDataFrame([(n, n, 0) for n in sets], "node long, component long, label long")
    links = {tuple(sorted((r.a, r.b))) for r in token_groups._matrix_links(buckets, groups, frame, 85).collect()}
    want = {(a, b) for a in sets for b in sets if a < b
            and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    assert links == want and (1, 2) in want and (1, 3) not in want


def test_low_bits_of_shingles_lose_no_link(spark):
    """The overlap of the low 16 bits bounds that of the sets, also where many tokens share theirs."""
    rng = np.random.default_rng(11)
    sets, pairs = {}, []
    for k in range(0, 120, 2):
        n = int(rng.choice([1, 5, 40, 400, 30_000]))
        x = np.unique(rng.integers(-1 << 62, 1 << 62, n))
        if k % 3 == 0:
            x = np.unique(x << 12)  # few low bits differ
        keep = rng.permutation(x)[int(rng.integers(0, n // 4 + 1)):]
        sets[k], sets[k + 1] = x, np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, n // 9)]))
        pairs.append((k, k + 1))
    frame = spark.createDataFrame(
        [(k, len(s), s.tolist(), np.unique(s.astype(np.int16)).tolist()) for k, s in sets.items()],
        "node long, n int, tokens array<long>, low array<smallint>")
    asked = spark.createDataFrame(pairs, "a long, b long")
    want = {(a, b) for a, b in pairs
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    low = {tuple(r) for r in token_groups._linked(asked, frame, 80, "low").collect()}
    assert want and {tuple(r) for r in token_groups._linked(asked, frame, 80).collect()} == want <= low
    assert len(low) < len(pairs)


def test_ngram_star_of_uneven_near_copies(spark):
    """Copies of one text with few to many edits: some link to it, some to each other, some not."""
    rng = random.Random(12)
    base, rows = words(rng, 150).split(), []
    for i in range(150):
        t = list(base)
        for k in rng.sample(range(150), rng.choice([0, 1, 2, 4, 8, 12])):
            t[k] = rng.choice(["left", "right", f"own{i}"])
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in token_groups.ngram_components(table(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_ngram_null_ids_repeats_and_empty(spark, empty):
    t = "one two three four five six"
    rows = [(5, t), (5, t), (None, t), (3, t.upper()), (8, ""), (9, None), (10, "two"), (11, "two")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id))
                 for r in token_groups.ngram_components(table(spark, rows)).collect())
    assert got == sorted([("5", 3, "3"), ("5", 3, "3"), ("None", 3, "None"), ("3", 3, "3"), ("8", 0, "8"),
                          ("9", 0, "9"), ("10", 1, "10"), ("11", 1, "10")])
    assert token_groups.ngram_components(empty).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(1000), 200)
    links = list(zip(nodes[:150], nodes[1:150])) + [(nodes[160], nodes[170]), (nodes[180], nodes[180])]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(nodes[:150]) for n in nodes[:150]} | {
        n: min(nodes[160], nodes[170]) for n in (nodes[160], nodes[170])}


# ---- 5 exact dedup ----------------------------------------------------------------------------
def test_content_sort_matches_brute_force(spark, rows, docs):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest())
            for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in content_sort.content_sort_dedup(docs).collect()}
    assert got == want


def test_content_sort_group_over_many_partitions(spark, empty):
    rows = [(i, "Same" if i % 2 else "SAME") for i in range(300)] + [(300, "other"), (301, None), (302, "")]
    out = content_sort.content_sort_dedup(table(spark, rows)).collect()
    assert sum(r.kept for r in out) == 3
    assert {(r.keep_id, r.group_size) for r in out} == {(299, 300), (300, 1), (302, 2)}
    assert content_sort.content_sort_dedup(empty).count() == 0


def test_content_sort_repeated_rows_and_null_ids(spark):
    out = content_sort.content_sort_dedup(table(spark, [(4, "a"), (4, "A"), (None, "a"), (None, "z")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out) == sorted(
        [("4", "4", 3, True), ("4", "4", 3, False), ("None", "4", 3, False), ("None", "None", 1, True)])


# ---- 6 shards ---------------------------------------------------------------------------------
def test_kd_shards(spark, empty):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(900)]
    rows += [(900 + i, "one very common text") for i in range(500)] + [(2000, None), (2001, ""), (None, "x")]
    out = kd_shards.kd_shards(table(spark, rows), shards=7).collect()
    texts = Counter((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((str(r.doc_id), r["size"], r.text_crc32) for r in out) == texts
    sums, slots = Counter(), defaultdict(list)
    for r in out:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(sums) == list(range(7))
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r["size"] for r in out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r.doc_id, r.shard, r.slot) for r in kd_shards.kd_shards(table(spark, rows, 5), shards=7).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in out}
    assert kd_shards.kd_shards(empty).count() == 0


def test_kd_shards_fewer_rows_than_shards(spark):
    out = kd_shards.kd_shards(table(spark, [(1, "a"), (2, "b"), (2, "b")])).collect()
    assert len(out) == 3 and all(0 <= r.shard < 40 for r in out)


# ---- 7 toxicity -------------------------------------------------------------------------------
def toxic_corpus(seed=1, n=700):
    rng = random.Random(seed)
    bad, rows, labels = ["vileword", "nastything", "badlyone"], [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        lines = [words(rng, rng.randint(8, 16), "abcdefghijklmnop") for _ in range(rng.randint(1, 8))]
        if toxic:
            k = rng.randrange(len(lines))
            lines[k] = lines[k] + " " + rng.choice(bad) + rng.choice(["", "s", "er"])
        rows.append((i, ". ".join(lines) + ".", None, None))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_located(spark):
    rows, labels = toxic_corpus()
    rows += [(9000, None), (9001, ""), (9002, "!!! ??? ..."), (None, rows[0][1])]
    rows = [(*r, *[None] * (4 - len(r))) for r in rows]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = toxic_mil.toxicity(table(spark, rows), marks).collect()
    assert len(out) == len(rows)
    truth, texts = {i: t for i, _, t in labels}, {r[0]: r[1] for r in rows}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    found = [r for r in held if r.predicted and truth[r.doc_id]]
    inside = [re.search("vileword|nastything|badlyone",
                        texts[r.doc_id].encode()[r.worst_start:r.worst_end].decode()) for r in found]
    assert sum(map(bool, inside)) >= 0.95 * len(found) > 0


def test_toxicity_without_labels_and_empty(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxic_mil.toxicity(docs, none).collect()} == {0.0}
    assert toxic_mil.toxicity(empty, none).count() == 0
    assert toxic_mil.without_toxic(docs, None).columns == docs.columns


def test_noisy_or_gradient_direction():
    b = np.array([1, 2]), np.array([0, 1]), 2
    w = toxic_mil.fit([b, (np.array([2]), np.array([0]), 1)] * 1, [1, 1])
    assert toxic_mil._noisy_or(np.array([w[-1]])) > 0.5  # one label only: a constant


# ---- 8 language -------------------------------------------------------------------------------
def test_language_id(spark, empty):
    rng = random.Random(2)
    letters = {"xx": "abcdefg", "yy": "ghijklm", "zz": "éàùçbcd"}
    rows = [(i, words(rng, rng.randint(3, 30), letters[lang]), lang)
            for i in range(240) for lang in [rng.choice(list(letters))]]
    rows += [(1000, None, "xx"), (1001, "12 34 !!", "xx"), (1002, "", None), (None, "abc fed", None)]
    out = lang_ftrl.language_id(table(spark, rows)).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[None].lang_pred == "xx"
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 20
    assert all(0 <= r.score <= 1 for r in out)
    assert lang_ftrl.language_id(empty).count() == 0
    unlabelled = table(spark, [(1, "abc"), (2, "def")])
    assert {r.lang_pred for r in lang_ftrl.language_id(unlabelled).collect()} == {"und"}


def test_rare_language_is_learnt_beside_copies(spark):
    """3 texts of a language beside 900 of others, half of them copies, with a sample of 40."""
    rng = random.Random(4)
    rows = [(i, words(rng, 20, "abcdefg"), "xx") for i in range(450)]
    rows += [(1000 + i, "hot copy of one text hij", "yy") for i in range(400)]
    rows += [(2000 + i, words(rng, 20, "ghijklm"), "yy") for i in range(50)]
    learnable = [i for i in range(3000, 3100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rare = [(i, words(rng, 20, "éàùçbcd"), "zz") for i in learnable[:3]]
    held = [(i, words(rng, 20, "éàùçbcd"), "zz") for i in range(3100, 3200) if i not in learnable][:20]
    docs = table(spark, [*rows, *rare, *held])
    model = lang_ftrl.train(docs, max_docs=40)
    assert model[0] == ["xx", "yy", "zz"]
    got = {r.doc_id: r.lang_pred for r in lang_ftrl.predict(docs, model).collect()}
    assert all(got[i] == "zz" for i, *_ in [*rare, *held])
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.95 * len(rows)
    taken = lang_ftrl.sample(docs.filter("lang = 'yy'"), 40).collect()
    assert len({r.text for r in taken}) == len(taken) == lang_ftrl.LEAST_DOCS


def test_language_quota():
    assert lang_ftrl.quota([10 ** 6] * 4, 4000) == 1000
    assert lang_ftrl.quota([10 ** 6, 3, 10 ** 6], 4000) == 1998
    assert lang_ftrl.quota([5, 7], 4000) == lang_ftrl.LEAST_DOCS
    assert lang_ftrl.quota([10 ** 6] * 1000, 4000) == lang_ftrl.LEAST_DOCS


def test_language_weights_are_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    logits = np.stack([np.where(y == 0, 3.0, -3.0), np.zeros(400)], axis=1) * 8
    flip = rng.random(400) < 0.2
    t = lang_ftrl.temperature(logits, np.where(flip, 1 - y, y))
    assert t > 3  # overconfident logits are cooled
    assert lang_ftrl.temperature(logits[:0], y[:0]) == 1.0


# ---- 9 neighbours -----------------------------------------------------------------------------
def test_block_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[5] = v[100]
    v[6] = v[200] * np.float32(1 + 1e-7)
    v[300:340] = v[300]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(800, None, 0), (900, [0.0] * 16, 0), (1000, [math.nan] * 16, 0), (1100, [1.0, None] * 8, 0),
             (1200, [math.inf] * 16, 0), (1300, [1.0] * 3, 0), (None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    got = defaultdict(list)
    for r in block_ann.block_neighbours(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    w = v.astype(np.float64)
    assert sorted(got) == list(range(0, 700, 100))
    for q in got:
        d = np.zeros(700)
        for j in range(16):
            d += (w[:, j] - w[q, j]) ** 2
        best = sorted((math.sqrt(x), i) for i, x in enumerate(d) if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, s) for k, (s, i) in enumerate(best)]


def test_block_neighbours_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r["rank"], r.vec_id) for r in block_ann.block_neighbours(few).sort("rank").collect()] == [(1, 2), (2, 1)]
    assert block_ann.block_neighbours(few).count() == 2
    assert block_ann.block_neighbours(few.limit(0)).count() == 0
    assert block_ann.block_neighbours(few.filter("vec_id > 0")).count() == 0


def test_tile_bounds_hold_for_hostile_scales():
    rng = np.random.default_rng(1)
    for scale in (1e-12, 1.0, 1e12):
        q = rng.normal(size=(5, 8)) * scale
        c = np.concatenate([q + rng.normal(size=(5, 8)) * scale * 1e-9, rng.normal(size=(60, 8)) * scale])
        at, to = block_ann._tile(q, c, np.zeros((5, 65), bool), 3)
        kept = set(zip(at.tolist(), to.tolist()))
        d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
        assert all((i, int(j)) in kept for i in range(5) for j in np.argsort(d[i])[:3])


# ---- 10 mixing --------------------------------------------------------------------------------
def test_mix_targets_water_filling():
    got = entropy_mix.targets([("b", 100), (None, 100), ("a", 100), ("c", 1000)])
    assert got == {"a": 200.0, "b": pytest.approx(200.0), "c": pytest.approx(1350.0), None: 200.0} or (
        sum(got.values()) == pytest.approx(1.5 * 1300))
    assert entropy_mix.targets([]) == {}


def test_entropy_mix(spark, empty):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([3, 10, 10, 40, 200])), None, rng.choice(["a", "b", "c", "hot", None]))
            for i in range(800)]
    rows += [(1000 + i, "same four words here", None, "hot") for i in range(400)]
    rows += [(2000, None, None, "a"), (2001, "", None, "zero"), (2002, "x", None, "a"), (2002, "x", None, "a")]
    df = table(spark, rows)
    out = entropy_mix.entropy_mix(df).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    goal = entropy_mix.targets(list(size.items()))
    by, source = defaultdict(list), {r[0]: r[3] for r in rows}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == size[source[r.doc_id]]
        assert r.target == pytest.approx(goal[source[r.doc_id]])
        by[source[r.doc_id]].append(r.taken)
    for s, taken in by.items():
        assert abs(sum(taken) - goal[s]) <= max(10, 0.01 * goal[s])
    again = entropy_mix.entropy_mix(table(spark, rows, 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert entropy_mix.entropy_mix(empty).count() == 0


def test_mix_rates_are_exponential_tilts(spark):
    rows = [(i, "w " * (1 + i % 50), None, "a") for i in range(300)] + [
        (1000 + i, "w " * 20, None, "b") for i in range(300)]
    for _, group in __import__("itertools").groupby(
            sorted(entropy_mix.entropy_mix(table(spark, rows)).collect(), key=lambda r: r.source_size),
            key=lambda r: r.source_size):
        pairs = sorted({(r["size"], r.rate) for r in group if 0 < r.rate < 2})
        tilt = {round(math.log(x / (2 - x)) / n, 6) for n, x in pairs}
        assert len(tilt) <= 1  # one multiplier a source


# ---- keeping rows -----------------------------------------------------------------------------
def test_keep_rows(spark):
    df = table(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "n"), (2, "c")])
    kept = df.select("doc_id", text_hash().alias("text_hash")).filter("doc_id is null or doc_id = 1")
    out = keep_rows(df, kept, doc_id=F.col("doc_id"), text_hash=text_hash())
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "a"), ("1", "b"), ("None", "n")]
    twice = kept.distinct().withColumn("copies", F.lit(2))
    assert keep_rows(df, twice, doc_id=F.col("doc_id"), text_hash=text_hash()).count() == 6


def exchanges_of(df):
    """What each exchange of the plan is by, and the step below it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [a + b for a, b in zip(lines, lines[1:]) if "Exchange hashpartitioning" in a]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keep_rows_moves_the_documents_once(spark, no_broadcast, tmp_path):
    spark.createDataFrame([(1, "a", "s"), (1, "b", "s"), (1, "b", "s"), (2, "b", None), (None, None, "t")],
                          "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, "b"), (None, None), (7, "a")], "doc_id long, text string").select(
        "doc_id", text_hash().alias("text_hash")).write.parquet(str(tmp_path / "k"))
    docs, kept = (spark.read.parquet(str(tmp_path / k)) for k in "dk")
    out = keep_rows(docs, kept, doc_id=F.col("doc_id").cast("long"), text_hash=text_hash())
    assert len(exchanges_of(out)) == 2  # one of the documents, one of the keys
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.filter(
        "doc_id = 1 AND text = 'b' OR doc_id IS NULL").distinct().collect()))


def test_screened_loses_no_wanted_row(spark):
    rows = spark.range(0, 20000).select((F.col("id") - 10000).alias("k"), F.col("id").alias("v"))
    rows = rows.unionByName(rows.filter("k = 7")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) k, 1L v"))
    wanted = spark.range(0, 500).select((F.col("id") * 37 - 9000).alias("node"))
    got = screened(rows, "k", wanted)
    assert got.columns == rows.columns
    keys = [r.k for r in got.collect()]
    asked = {i * 37 - 9000 for i in range(500)}
    assert asked <= set(keys) and keys.count(7) in (0, 2) and len(keys) < 4000
    assert keys.count(-9000) == 1
    assert screened(rows, "k", wanted.limit(0)).count() == 0


def test_sets_stay_while_their_shingles_are_counted(spark, no_broadcast):
    sets = spark.createDataFrame([(i, 4, [4 * i, 4 * i + 1, 4 * i + 2, 4 * i + 3], [i]) for i in range(2000)],
                                 "node long, n int, tokens array<long>, low array<smallint>")
    nodes = spark.createDataFrame([(3,), (5,)], "node long")
    for half in (True, False):
        df = token_groups._undecided(nodes, sets, 85, half)
        assert not any(re.search(r"[\[ ]tokens#\d+[,\]]", x) for x in exchanges_of(df))
        assert df.count() == 0
    same = sets.unionByName(spark.createDataFrame([(9000, 4, [12, 13, 14, 15], [3])], sets.schema))
    nodes = spark.createDataFrame([(3,), (5,), (9000,)], "node long")
    assert {r.node for r in token_groups._undecided(nodes, same, 85, False).collect()} == {3, 9000}


def test_lattices_are_small_and_lose_no_word(codec, monkeypatch):
    words = [f"w{i:x}{'é' * (i % 3)}{'日' * (i % 2)}".encode() for i in range(9001)]
    c, made = codec[0], []

    class Seen(piece_viterbi.Lattice):
        def __init__(self, part, *trie):
            made.append(len(part))
            super().__init__(part, *trie)

    monkeypatch.setattr(piece_viterbi, "Lattice", Seen)
    c.clear()
    ids = c.encode_all(words)
    c.clear()
    assert max(made) <= 5000 and sum(made) >= 9001
    assert all(c.decode(i) == w for i, w in zip(ids, words))
    assert all(i.tobytes() == c._best(b" " + w) for i, w in zip(ids[:300], words))
