"""Incremental indexing: what changed, what goes, what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(previous: DataFrame, current: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """``path, status`` (added, changed, removed, same) and both hashes, by a full outer join on the path."""
    a, b = previous.select(key, F.col(digest).alias("old_hash")), current.select(key, F.col(digest).alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), "old_hash", "new_hash")


def reindex(points: DataFrame, chunks: DataFrame, changes: DataFrame, file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """(points after the run, new state). Chunks of removed and changed files go, those of added and changed files come.

    Files that gave no chunks are in the state all the same, so they are not read again.
    """
    touched = changes.where(F.col("status").isin("removed", "changed")).select(F.col("path").alias(file_col))
    kept = points.join(touched, file_col, "left_anti")
    fresh = changes.where(F.col("status").isin("added", "changed")).select(F.col("path").alias(file_col))
    state = changes.where(F.col("status") != "removed").select("path", F.col("new_hash").alias("hash"))
    return kept.unionByName(chunks.join(fresh, file_col, "left_semi"), allowMissingColumns=True), state
