"""Registered searches for many queries at once, each query against all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import postings, vector_index
from .operators.vector_index import VectorIndex
from .queries import query, table
from .sources.shared import checkpoint_dir


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of a search: ids divisible by 100."""
    return vectors(spark, sf_dir).where("vec_id % 100 = 0")


def index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    path = f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    return vector_index.build_index(vectors(spark, sf_dir), "vec_id", "embedding", path=path)


def nearest(spark: SparkSession, sf_dir: str, k: int = 10, conditions: tuple = (), exact: bool = True) -> DataFrame:
    return vector_index.search(index(spark, sf_dir), asked_vectors(spark, sf_dir), k, "vec_id", "embedding", conditions, exact=exact)


_NEAR = """SELECT q.vec_id AS query, p.vec_id AS id, p.label, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0"""


def _ranked_sql(rows: str, k: int, where: str = "true") -> str:
    return f"SELECT query, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM ({rows}) WHERE {where}) WHERE rank <= {k}"


@query(f"SELECT query, rank, id, round(score, 6) AS score FROM ({_ranked_sql(_NEAR, 10)})")
def dense_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for each query, through all cells."""
    return nearest(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"SELECT query, rank, id, round(score, 6) AS score FROM ({_ranked_sql(_NEAR, 10, 'label IN (1, 3)')})")
def filtered_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest among those with one of two labels, filtered inside cells."""
    return nearest(spark, sf_dir, conditions=(F.col("label").isin(1, 3),)).withColumn("score", F.round("score", 6))


@query()
def dense_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest among the cells that each query visits; a test holds its recall against ``dense_topk_many``."""
    return nearest(spark, sf_dir, exact=False).withColumn("score", F.round("score", 6))


_WORDS_OF = r"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\w+') AS words FROM documents), a AS (SELECT avg(len(words)) AS mean, count(*) AS n_docs FROM w),
  asked AS (SELECT item_id AS query, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM benchmark) GROUP BY ALL),
  tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM w) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
  weights AS (SELECT doc_id AS id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT mean FROM a))) AS weight FROM tf),
  rare AS (SELECT term, ln(1 + ((SELECT n_docs FROM a) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term)"""
_SPARSE_MANY = "SELECT query, id, round(sum(q * weight), 9) AS score FROM asked JOIN weights USING (term) GROUP BY query, id"
_RARE_MANY = "SELECT query, id, round(sum(q * idf * weight), 9) AS score FROM asked JOIN weights USING (term) JOIN rare USING (term) GROUP BY query, id"


def sparse_many(spark: SparkSession, sf_dir: str, k: int, idf: bool = False) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    built = postings.build_postings(table(spark, sf_dir, "documents"), "doc_id", path=path)
    return postings.search_postings(built, table(spark, sf_dir, "benchmark"), k, "item_id", idf=idf)


@query(f"WITH {_WORDS_OF} SELECT query, rank, id, round(score, 6) AS score FROM ({_ranked_sql(_SPARSE_MANY, 10)})")
def sparse_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each item of ``benchmark``, by blocks of postings."""
    return sparse_many(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_WORDS_OF} SELECT query, rank, id, round(score, 6) AS score FROM ({_ranked_sql(_RARE_MANY, 10)})")
def sparse_topk_many_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sparse_topk_many``, with the rarity of terms."""
    return sparse_many(spark, sf_dir, 10, idf=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {_WORDS_OF}, d AS (SELECT query // 100 AS query, rank, id FROM ({_ranked_sql(_NEAR, 40)}) WHERE query // 100 IN (SELECT item_id FROM benchmark)), s AS ({_ranked_sql(_SPARSE_MANY, 40)}),
  f AS (SELECT query, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(leg * 1000 + rank) AS first FROM (SELECT query, id, rank, 0 AS leg FROM d UNION ALL SELECT query, id, rank, 1 FROM s) GROUP BY query, id)
  SELECT query, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, first)::INT AS rank FROM f) WHERE rank <= 15""")
def hybrid_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs for each item of ``benchmark``, forty of each, fused; an item's vector is the one with a hundred times its id."""
    dense = nearest(spark, sf_dir, 40).withColumn("query", F.expr("query div 100")).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query")), "query", "left_semi")
    return postings.fuse([dense, sparse_many(spark, sf_dir, 40)], 15).withColumn("score", F.round("score", 6))
