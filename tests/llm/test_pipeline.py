"""The pipeline's stages against brute force, and the registered queries' contracts."""

import hashlib
from collections import Counter

import duckdb
import pytest
from conftest import SF001
from pyspark.sql import functions as F
from test_operators import SCHEMA, brute_components, brute_spans, lower

import corpus_pipeline
from overlap.llm import catalog, entropy_mix, toxic_mil


@pytest.fixture(scope="module")
def staged_rows(spark, tmp_path_factory):
    """What every stage returns, over the whole of sf0.001, each fed with the one before."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [("input", docs)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(root / str(k))
        stage(spark, docs, SF001).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_stages_keep_the_columns(staged_rows):
    first = staged_rows[0][1]
    for _, df in staged_rows[1:-1]:
        assert df.columns == first.columns


def test_toxicity_stage_drops_what_the_model_rejects(spark, staged_rows):
    docs, after = staged_rows[0][1], staged_rows[1][1]
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    scored = toxic_mil.toxicity(docs, labels)
    want = {r.doc_id for r in scored.filter("predicted = 0").collect()}
    assert {r.doc_id for r in after.collect()} == want
    assert 0.7 * docs.count() < len(want) <= docs.count()


def test_exact_stage_keeps_the_largest_id(staged_rows):
    before, after = staged_rows[1][1], staged_rows[2][1]
    last = {}
    for r in before.collect():
        last[lower(r.text)] = max(last.get(lower(r.text), -1), r.doc_id)
    rows = {r.doc_id: tuple(r) for r in before.collect()}
    assert sorted(plain(after)) == sorted(rows[i] for i in last.values())


def test_ngram_stage_keeps_the_smallest_of_each_group(staged_rows):
    before, after = staged_rows[2][1], staged_rows[3][1]
    comps = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in comps.values()})


def near_components(rows, width=5, percent=80):
    """The least id of every row's group, by all pairs of sets of word shingles."""
    sets, root = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = lower(t).split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

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
    return {i: find(i) for i in root}


def test_ngram_stage_takes_five_words_and_four_fifths(spark):
    """Near copies below op4's limits: 4 scattered words of 200 changed, 45 words appended."""
    base = [f"w{k}" for k in range(200)]
    edited = [f"new{k}" if k in (30, 80, 120, 170) else w for k, w in enumerate(base)]
    longer = [f"v{k}" for k in range(200)]
    texts = [base, edited, longer, longer + [f"tail{k}" for k in range(45)],
             longer[:100] + [f"other{k}" for k in range(100)], [f"u{k}" for k in range(60)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.ngram_join(spark, docs, SF001).collect()}
    assert got == set(near_components(rows).values()) == {0, 2, 4, 5}


def test_ngram_stage_matches_brute_force_of_its_limits(staged_rows):
    before, after = staged_rows[2][1], staged_rows[3][1]
    want = near_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))


def test_mixing_stage_gives_copies(staged_rows):
    before, after = staged_rows[3][1], staged_rows[4][1]
    want = {r.doc_id: r.copies for r in entropy_mix.entropy_mix(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == Counter(want)
    assert set(want.values()) <= {1, 2}


def test_token_stage_is_lossless(staged_rows):
    before, after = staged_rows[4][1], staged_rows[5][1]
    assert after.filter("not lossless").count() == 0
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before.collect())
    assert Counter((r.doc_id, r.text_sha256) for r in after.collect()) == want


def test_pipeline_of_empty_and_odd_rows(spark):
    odd = [(1, None, None, None, None), (2, "", None, "a", 0), (2, "", None, "a", 0), (None, "x y", None, None, 3),
           (3, "Some words of text here", "en", "a", 22), (4, "some WORDS of text here", "en", "b", 22)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x"))
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF001)
        got = {r.doc_id for r in docs.collect()}
        assert got <= ({1, 2, 4, None} if rows else set())


CONTRACT = {
    "op1_": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string",
             "record_type": "string", "refers_to": "bigint"},
    "op2_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint",
             "kept_sha256": "string"},
    "op3_": {"doc_id": "bigint", "token_ids": "array<int>"},
    "op4_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean",
             "text_sha256": "string"},
    "op6_": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string",
             "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double",
              "taken": "bigint"},
}


@pytest.mark.parametrize("prefix", list(CONTRACT))
def test_query_contract(spark, prefix):
    name = next(q for q in catalog.queries() if q.startswith(prefix))
    df = catalog.queries()[name](spark, SF001)
    types = dict(df.dtypes)
    assert {c: types[c] for c in CONTRACT[prefix]} == CONTRACT[prefix]
    rows = df.collect()
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    if name in catalog.oracle_sql():
        res = con.execute(catalog.oracle_sql()[name])
        cols = [d[0] for d in res.description]
        assert sorted(map(str, res.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in rows)
    elif prefix != "op1_":
        ids = con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()
        assert sorted(r.doc_id for r in rows) == [i for i, in ids]
    if prefix == "op2_":
        texts = con.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_spans(texts)
