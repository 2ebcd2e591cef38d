"""Incremental chunk index: what to insert, update, keep and delete, and the table that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def points(chunks: DataFrame, model: str, text: str = "embed_text") -> DataFrame:
    """``point_id, chunk_id, doc_id, text_sha256, embedding_model``: one point per chunk; repeated rows count once."""
    return chunks.select(
        T.point_id(F.col("id")).alias("point_id"), F.col("id").alias("chunk_id"), "doc_id", T.text_sha(F.col(text)).alias("text_sha256"), F.lit(model).alias("embedding_model")
    ).dropDuplicates(["point_id"])


def index_diff(current: DataFrame, existing: DataFrame) -> DataFrame:
    """``point_id, doc_id, action``: insert, update, unchanged or delete.

    Only documents that ``current`` holds are touched: points of other documents are left out. Hashes and models
    compare null-safe. One shuffle on the point id; the texts are not moved.
    """
    docs = current.select("doc_id").distinct()
    old = existing.join(docs, "doc_id", "left_semi").select("point_id", F.col("doc_id").alias("old_doc"), F.col("text_sha256").alias("old_sha"), F.col("embedding_model").alias("old_model"))
    both = current.join(old.withColumn("was", F.lit(True)), "point_id", "full_outer")
    same = F.col("text_sha256").eqNullSafe(F.col("old_sha")) & F.col("embedding_model").eqNullSafe(F.col("old_model"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("chunk_id").isNull(), "delete").when(same, "unchanged").otherwise("update")
    return both.select("point_id", F.coalesce("doc_id", "old_doc").alias("doc_id"), action.alias("action"))


def index_report(diff: DataFrame) -> DataFrame:
    """``doc_id, chunks, embedded, unchanged, deleted``."""
    has = lambda *a: F.count_if(F.col("action").isin(*a))
    return diff.groupBy("doc_id").agg(
        has("insert", "update", "unchanged").alias("chunks"), has("insert", "update").alias("embedded"), has("unchanged").alias("unchanged"), has("delete").alias("deleted")
    )


def apply_diff(existing: DataFrame, current: DataFrame, diff: DataFrame) -> DataFrame:
    """The index after the diff: first all that is new or changed, then without what is stale."""
    fresh = current.join(diff.filter("action IN ('insert', 'update')").select("point_id"), "point_id", "left_semi")
    gone = diff.filter("action <> 'unchanged'").select("point_id")
    return existing.join(gone, "point_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def point_counts(index: DataFrame) -> DataFrame:
    """``doc_id, points``: how many points the index holds of each document."""
    return index.groupBy("doc_id").agg(F.countDistinct("point_id").alias("points"))
