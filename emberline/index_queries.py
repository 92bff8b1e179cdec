"""Registered queries of an index that is kept up to date, over whole documents as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, incremental
from .queries import _WORDS, query, table
from .sources.buckets import BucketedPoints, apply_changes
from .sources.shared import checkpoint_dir

POINT = "id string, file long, chunk int, digest string"


def file_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files before, files now), ``path, text, hash``: some have come, some have gone, every fifth has another line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    before = docs.where("path % 10 <> 3")
    now = docs.where("path % 10 <> 7").withColumn("text", F.when(F.col("path") % 5 == 0, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text")))
    return tuple(d.withColumn("hash", F.md5("text")) for d in (before, now))


def chunk_points(files: DataFrame) -> DataFrame:
    chunks = chunking.chunk_texts(files, "path")
    return chunks.select(F.concat_ws(":", "path", "chunk_index").alias("id"), F.col("path").alias("file"), F.col("chunk_index").alias("chunk"), F.md5("text").alias("digest"))


def updated(spark: SparkSession, sf_dir: str) -> tuple[BucketedPoints, DataFrame]:
    """(the store after a first run and an incremental one, the state)."""
    before, now = file_versions(spark, sf_dir)
    store = BucketedPoints(spark, f"{checkpoint_dir(spark)}/points-{uuid.uuid4().hex}", POINT, buckets=32)
    store.upsert(chunk_points(before))
    _, state = apply_changes(store, incremental.file_changes(before, now), chunk_points(now))
    return store, state


_NOW = f"""now AS (SELECT doc_id AS file, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || chr(10) || 'one more line' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 10 <> 7),
  w AS (SELECT file, {_WORDS} AS words FROM now WHERE length(trim(text)) >= 20),
  c AS (SELECT file, unnest(range(0, len(words), 448)) AS begun, words FROM w WHERE len(words) > 0)"""


@query(f"WITH {_NOW} SELECT file, (begun // 448)::INT AS chunk, md5(array_to_string(words[begun + 1 : begun + 512], ' ')) AS digest FROM c")
def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every file after an incremental run, with its content."""
    return updated(spark, sf_dir)[0].read().select("file", "chunk", "digest")


@query(f"WITH {_NOW} SELECT now.file AS path, md5(text) AS hash, count(c.begun) AS n_chunks FROM now LEFT JOIN c ON c.file = now.file GROUP BY now.file, text")
def index_state_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the index and the chunks of each file in it."""
    store, state = updated(spark, sf_dir)
    counts = store.read().groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return state.join(counts, "path", "left").select("path", "hash", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query("SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 50 = 7 AND doc_id % 3 <> 0) AND doc_id % 11 <> 0")
def bucket_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the code chunks of one file, and without listed ids, by rewriting touched buckets."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("file"), F.when(F.col("doc_id") % 3 == 0, F.lit("pattern")).otherwise(F.lit("code_chunk")).alias("type"))
    store = BucketedPoints(spark, f"{checkpoint_dir(spark)}/points-{uuid.uuid4().hex}", "id long, file string, type string", buckets=16)
    store.upsert(rows)
    store.delete_files(spark.range(1).select(F.lit("f7").alias("file")), F.col("type") == "code_chunk")
    store.delete_ids(rows.where("id % 11 = 0").select("id"))
    return store.read().select("id")
