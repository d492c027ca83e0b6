"""A training-data pipeline over `documents`: toxicity, exact copies, near copies, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame; run() writes
each result as Parquet in the shared folder and reads it again as the next stage's docs.

docs may have further columns of any names, which all stages but the last keep. Rows are told apart by themselves, not by doc_id: it may
repeat or be null. Texts may be null, empty or of any length, and are read whole. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.byte_bpe import bpe_digests
from palimpsest.llm.common import odd_ids, ranked, written
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.minhash import near_dedup
from palimpsest.llm.mixing import mix_documents
from palimpsest.llm.toxicity import score_udf, train_fold


def _kept(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], nulls_first: bool) -> DataFrame:
    """The rows of docs that operator(doc_id, text) marks as kept. Where doc_id doesn't name the rows, they are numbered, in its order."""
    if not odd_ids(docs):
        kept = operator(docs).filter("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = written(ranked(docs, nulls_first))
    kept = operator(rows.select(F.col("row").alias("doc_id"), "data.text")).filter("kept").select(F.col("doc_id").alias("row"))
    return rows.join(kept, "row", "left_semi").select("data.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7 stay, null and empty texts among them; equal texts score alike. The lexicon is learnt from the labelled
    documents outside the held-out third."""
    lexicon = train_fold(spark, docs, sf_dir)
    return docs.filter(score_udf(lexicon)(F.col("text")) < 0.7)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (null as the empty text) one stays: that with the largest doc_id, one without a doc_id only where all are."""
    return _kept(docs, exact_dedup, nulls_first=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id, one without a doc_id only where all are. Texts without
    words (null, empty, blank) are in no group and stay."""
    return _kept(docs, near_dedup, nulls_first=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights, as documents: a row for each document and pass; null is a source, and documents
    without words are in no mix."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text of the mix, one for each row; null is the empty text."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: Scores, signatures, draws and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
