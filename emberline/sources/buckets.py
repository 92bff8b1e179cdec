"""Points stored by hash bucket of their file: a change rewrites the buckets that it touches and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

BUCKETS = 256


class BucketedPoints:
    """A Parquet table of points, one folder a bucket; a file's points are all in one bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, file_col: str = "file", buckets: int = BUCKETS):
        self.spark, self.path, self.file_col, self.buckets = spark, path.rstrip("/"), file_col, buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self, file: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(file) if isinstance(file, str) else file, F.lit(""))), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All points, or those of some buckets; other buckets are not opened then."""
        there = sorted(int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith("bucket=")) if self._fs.exists(self._path(self.path)) else []
        chosen = there if only is None else [b for b in there if b in set(only)]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        names = [f.name for f in self.schema]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/bucket={b}" for b in chosen]).select(*names)

    def _touched(self, files: DataFrame, column: str) -> list[int]:
        """Numbers of the buckets of ``files``; as many as there are buckets at most."""
        return sorted(r["b"] for r in files.select(self.bucket(column).alias("b")).distinct().collect())

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        """Replaces the content of ``touched`` with ``rows``, which lie in no other bucket."""
        # Read and written are the same folders, so the new content is written down first.
        content = cut(rows.select(*[f.name for f in self.schema], self.bucket(self.file_col).alias("bucket")))
        full = {r["bucket"] for r in content.select("bucket").distinct().collect()}
        content.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in touched:
            if b not in full:
                self._fs.delete(self._path(f"{self.path}/bucket={b}"), True)

    def upsert(self, points: DataFrame, key: str = "id") -> list[int]:
        """Puts ``points`` in place of those of their buckets with the same key; the buckets that were written."""
        points = cut(points.select(*[f.name for f in self.schema]))
        touched = self._touched(points, self.file_col)
        if touched:
            self._put(self.read(touched).join(points.select(key), key, "left_anti").unionByName(points), touched)
        return touched

    def delete_files(self, files: DataFrame, condition: Column | None = None) -> list[int]:
        """Drops the points of ``files`` (column ``file_col``), of those that fit ``condition`` only."""
        return self.replace_files(files, None, condition)

    def delete_ids(self, ids: DataFrame, key: str = "id") -> list[int]:
        """Drops points by key, wherever they are; ``ids`` with their file touch the buckets of those files only."""
        ids = cut(ids)
        touched = self._touched(ids, self.file_col) if self.file_col in ids.columns else list(range(self.buckets))
        touched = [b for b in touched if self._fs.exists(self._path(f"{self.path}/bucket={b}"))]
        if touched:
            self._put(self.read(touched).join(ids.select(key), key, "left_anti"), touched)
        return touched

    def replace_files(self, files: DataFrame, chunks: DataFrame | None, condition: Column | None = None) -> list[int]:
        """Points of ``files`` go (those that fit ``condition`` only), ``chunks`` come; the buckets that were written."""
        files = cut(files.select(self.file_col).distinct())
        fresh = cut(chunks.select(*[f.name for f in self.schema])) if chunks is not None else self.spark.createDataFrame([], self.schema)
        touched = self._touched(files.unionByName(fresh.select(self.file_col)), self.file_col)
        if touched:
            old = self.read(touched)
            stays = old.join(files, self.file_col, "left_anti")
            if condition is not None:
                stays = stays.unionByName(old.join(files, self.file_col, "left_semi").where(~F.coalesce(condition, F.lit(False))))
            self._put(stays.unionByName(fresh), touched)
        return touched


def apply_changes(store: BucketedPoints, changes: DataFrame, chunks: DataFrame) -> tuple[list[int], DataFrame]:
    """A run of incremental indexing: (buckets written, new state ``path, hash``).

    ``changes`` are those of ``file_changes``; of ``chunks`` those of added and changed files come.
    """
    changes = cut(changes)
    gone = changes.where(F.col("status").isin("removed", "changed")).select(F.col("path").alias(store.file_col))
    fresh = changes.where(F.col("status").isin("added", "changed")).select(F.col("path").alias(store.file_col))
    written = store.replace_files(gone, chunks.join(fresh, store.file_col, "left_semi"))
    return written, changes.where(F.col("status") != "removed").select("path", F.col("new_hash").alias("hash"))
