"""Exact deduplication by skew-safe combining: local, salted, global; full content decides at every stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_safe_join, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, every other character as it is."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def exact_dedup(docs: DataFrame, salts: int = 64, route_chars: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text, ...).

    Texts are equal when identical after lower-casing A-Z; null is the empty text. The row with the largest
    doc_id stays. Rows that repeat a doc_id are copies like any others, and all get their row; a null doc_id
    never stays while another is there. Other columns are not read. An empty table gives an empty result.

    1. Local: the partial aggregation on (digest, salt, content) combines equal texts within each task, so a
       text that fills a third of the corpus leaves a task once per salt.
    2. Salted: the same aggregation is completed for each (digest, salt, content).
    3. Global: the salt winners, `salts` of a group at most, are combined on (digest, content).
    The winners, without content, are written to the shared folder; rows then find theirs by digest, those of
    large groups without a shuffle. The digest, the first `route_chars` hex digits of SHA-256, only routes rows:
    should different contents share one, their rows (no others) are joined on content.
    """
    folded = docs.select("doc_id", fold_ascii(F.col("text")).alias("content"))
    rows = folded.select("doc_id", F.sha2("content", 256).alias("text_sha256"), "content")
    rows = rows.withColumn("digest", F.substring("text_sha256", 1, route_chars))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    salted = rows.groupBy("digest", salt, "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = winners.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("contents"))
    winners = written(winners)
    facts = winners.agg(F.sum("group_size"), F.max("contents")).first()
    total, contents = facts[0] or 0, facts[1] or 0
    out = hot_safe_join(rows.drop("content"), winners, ["digest"], "group_size", total)
    if contents > 1:
        clash = rows.join(winners.filter("contents > 1").select("digest"), "digest", "left_semi")
        whole = clash.groupBy("content", salt).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        whole = written(whole.groupBy("content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")))
        exact = hot_safe_join(clash, whole, ["content"], "group_size", total)
        out = out.filter("contents = 1").drop("contents").unionByName(exact.drop("content"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return exact_dedup(documents(spark, sf_dir))


OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
