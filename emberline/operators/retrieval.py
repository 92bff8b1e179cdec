"""Filtered dense, sparse and rank-fused top-k search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

PREFETCH, RRF_K = 40, 60


def payload_filter(type_: str | None = None, file: str | None = None, subsystem: str | None = None, package: str | None = None, kind: str | None = None, symbols: Sequence[str] = (), exclude_tests: bool = False) -> list[Column]:
    """The conditions of a search; every symbol must be declared in the chunk."""
    out = [F.col(c) == v for c, v in (("type", type_), ("subsystem", subsystem), ("crate", package), ("kind", kind)) if v]
    if file:
        out.append(F.contains("file", F.lit(file)))
    out += [F.array_contains("declared", s.strip()) for s in symbols if s.strip()]
    if exclude_tests:
        out.append(F.col("is_test") == F.lit(False))
    return out


def apply_filter(points: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    for c in conditions:
        points = points.where(c)
    return points


def scroll(points: DataFrame, conditions: Sequence[Column], key: str = "id") -> DataFrame:
    """All points that fit, in order of their ids."""
    return apply_filter(points, conditions).orderBy(key)


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], text_col: str = "text", prefix: str = "", normalise: bool = True) -> DataFrame:
    """``texts`` with ``dense`` vectors of an external model, called on Arrow batches."""

    def run(batch: pd.Series) -> pd.Series:
        import numpy as np

        vectors = np.asarray(model([prefix + (t or "") for t in batch]), dtype="float32")
        if normalise and len(vectors):
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(vectors))

    return texts.withColumn("dense", F.pandas_udf(run, ArrayType(FloatType()))(F.col(text_col)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def dense_topk(points: DataFrame, query: Sequence[float], k: int, key: str = "id", vector: str = "dense") -> DataFrame:
    """The ``k`` nearest by cosine: a scan and a bounded heap per task, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return points.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), key).limit(k)


_TERM = "(\\w+)"


def term_weights(docs: DataFrame, key: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, average: float | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """``key, term, weight``: BM25 term-frequency weights (no IDF) of lower-cased ``\\w+`` terms.

    With ``only`` just these terms get rows: they are counted inside each text, without a shuffle.
    ``average``: the mean number of terms, where it is known; else a pass over the texts counts it.
    """
    text = F.lower(F.coalesce(text_col, F.lit("")))
    words = docs.select(key, F.regexp_extract_all(text, F.lit(_TERM), 1).alias("words"))
    mean = F.lit(average) if average is not None else F.greatest(docs.agg(F.avg(F.regexp_count(text, F.lit(_TERM)))).scalar(), F.lit(1e-9))
    if only is not None:
        asked = F.filter("words", lambda w: w.isin(*only)) if only else F.array().cast("array<string>")
        found = words.select(key, F.size("words").alias("n"), asked.alias("asked")).where(F.size("asked") > 0)
        tf = found.select(key, "n", "asked", F.explode(F.array_distinct("asked")).alias("term")).select(key, "n", "term", F.size(F.filter("asked", lambda w: w == F.col("term"))).alias("tf"))
    else:
        tf = words.select(key, F.size("words").alias("n"), F.explode("words").alias("term")).groupBy(key, "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / mean))
    return tf.select(key, "term", weight.alias("weight"))


def inverse_document_frequency(weights: DataFrame, n_docs: int) -> DataFrame:
    """``term, idf``: the optional rarity weight of a term."""
    df = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(spark: SparkSession, text: str) -> DataFrame:
    import re
    from collections import Counter

    counts = Counter(re.findall(r"\w+", text.lower()))
    items = [F.struct(F.lit(t).alias("term"), F.lit(float(n)).alias("q")) for t, n in sorted(counts.items())]
    if not items:
        return spark.range(0).select(F.lit("").alias("term"), F.lit(0.0).alias("q"))
    return spark.range(1).select(F.inline(F.array(*items)))


def sparse_topk(weights: DataFrame, terms: DataFrame, k: int, key: str = "id", idf: DataFrame | None = None) -> DataFrame:
    """The ``k`` best by the dot product of term weights; ``terms`` are those of one query, so few."""
    joined = weights.join(F.broadcast(terms), "term")
    score = F.col("weight") * F.col("q")
    if idf is not None:
        joined, score = joined.join(idf, "term"), score * F.col("idf")
    return joined.groupBy(key).agg(F.sum(score).alias("score")).orderBy(F.desc("score"), key).limit(k)


def rrf_merge(legs: Sequence[DataFrame], limit: int, key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists of bounded length (columns ``key, score``).

    Ties go to the list and rank at which an id was first seen.
    """
    ranked = None
    for i, leg in enumerate(legs):
        order = Window.orderBy(F.desc("score"), key)
        one = leg.select(key, F.lit(i).alias("leg"), F.row_number().over(order).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    fused = ranked.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return fused.orderBy(F.desc("score"), "first.leg", "first.rank").limit(limit).select(key, "score", F.col("first.leg").alias("first_leg"), F.col("first.rank").alias("first_rank"))


def merged_search(code: DataFrame, notes: DataFrame | None, limit: int, key: str = "id") -> DataFrame:
    """Two ranked lists (``key, score``) of bounded length fused once more; without notes the code alone, with its own scores."""
    if notes is None or notes.isEmpty():
        return code.select(key, "score").orderBy(F.desc("score"), key).limit(limit)
    return rrf_merge([code, notes], limit, key).select(key, "score")


def hybrid_search(points: DataFrame, weights: DataFrame, query: Sequence[float], terms: DataFrame, limit: int, conditions: Sequence[Column] = (), key: str = "id", vector: str = "dense") -> DataFrame:
    """Both legs over the filtered points, ``PREFETCH`` of each, fused."""
    chosen = apply_filter(points, conditions)
    dense = dense_topk(chosen, query, PREFETCH, key, vector).select(key, "score")
    allowed = weights.join(chosen.select(key), key, "left_semi") if conditions else weights
    return rrf_merge([dense, sparse_topk(allowed, terms, PREFETCH, key)], limit, key)
