"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
rows as Parquet in the shared folder and hands the reread table to the next. The first four
return the columns of ``documents``:

* toxicity drops documents that the multiple-instance model scores 0.5 or more;
* exact dedup keeps, of equal texts, the row with the largest id;
* n-gram join keeps, of each group of linked documents, the one with the smallest id (near copies:
  word shingles of ``NEAR_WIDTH`` words whose similarity is ``NEAR_PERCENT`` percent or more);
* mixing gives each document as often as the mix takes it (not at all, once or twice);
* tokens encodes each row: ids of the pieces, their score, and whether they decode to the text.

Rows repeated with one id and text count as one document; rows with a null id are linked with
nothing and stay in the n-gram stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.llm import content_sort, entropy_mix, piece_viterbi, token_groups, toxic_mil
from overlap.llm.common import keep_rows, staged, text_hash

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR_WIDTH, NEAR_PERCENT = 5, 80  # of the stage; op4's contract has limits of its own


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic_mil.without_toxic(docs, toxic_mil.train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = content_sort.content_sort_dedup(docs).filter("kept")
    same = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()).cast("binary"), 256)
    return keep_rows(docs, rows.select("doc_id", "text_sha256"),
                     doc_id=F.col("doc_id").cast("long"), text_sha256=same)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = token_groups.ngram_components(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    stays = rows.filter(F.col("component_id").isNull()
                        | F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "text_hash")
    return keep_rows(docs, stays.distinct(), doc_id=F.col("doc_id").cast("long"), text_hash=text_hash())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = entropy_mix.entropy_mix(docs).select("doc_id", "text_hash", "copies")
    return keep_rows(docs, rows, doc_id=F.col("doc_id").cast("long"), text_hash=text_hash())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_viterbi.encode_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram join", ngram_join),
          ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None  # the stages' models have no SQL form; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
