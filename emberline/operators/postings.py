"""Sparse search for many queries at once: posting lists with block maxima.

Documents are dealt into buckets by their place in the input, so an index is built without a
shuffle. A bucket is one row: its keys, and the postings of each of its terms as a block with the
largest weight among them; no term is ever one group. A search reads the buckets once. A task
keeps the best ``k`` of each query; the maxima of a bucket's blocks, summed over a query's terms,
bound the score of its documents, and the postings of those below the k-th best so far are not
looked at. Only the best of each task are shuffled.

The answer is that of a scan: a bound below the threshold cannot hide a better document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..sources.shared import cut

#: Documents in a bucket, and buckets that a task reads before it looks at bounds.
BUCKET_DOCS, FIRST_BUCKETS = 128, 2
#: Bounds and scores are sums of the same numbers in another order.
SLACK = 1e-9
#: Queries, and terms of queries, that one pass over the buckets answers.
PASS_QUERIES, PASS_TERMS = 4096, 200_000
#: Bytes of a row group, as a bucket is one row.
ROW_GROUP = 16 << 20
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class PostingIndex:
    """``buckets``: ``ids, lengths`` of documents, ``terms, sizes, most`` of blocks, ``docs, tf`` of postings, block by block.

    ``n_docs`` documents of ``mean`` terms stand behind them.
    """

    buckets: DataFrame
    n_docs: int
    mean: float
    key: str


def _weights(tf: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / mean))


def build_postings(docs: DataFrame, key: str = "id", text_col: str = "text", bucket_docs: int = BUCKET_DOCS, path: str | None = None) -> PostingIndex:
    """Blocks of all terms of all ``docs``; with ``path`` a Parquet table, else a table in the shared folder."""
    text = F.lower(F.coalesce(text_col, F.lit("")))
    n_docs, mean = docs.agg(F.count(F.lit(1)), F.avg(F.regexp_count(text, F.lit("(\\w+)")))).first()
    mean = max(mean or 0.0, 1e-9)
    words = docs.select(F.col(key).alias("id"), F.regexp_extract_all(text, F.lit("(\\w+)"), 1).alias("words"))
    lists = {"ids": words.schema["id"].dataType, "lengths": IntegerType(), "terms": StringType(), "sizes": IntegerType(), "most": DoubleType(), "docs": IntegerType(), "tf": IntegerType()}
    schema = StructType([StructField(c, ArrayType(kind)) for c, kind in lists.items()])

    def bucket(part: pa.RecordBatch) -> pa.RecordBatch | None:
        lengths = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
        coded = part.column(1).flatten().dictionary_encode()
        if not len(coded):
            return None
        doc = np.repeat(np.arange(len(lengths)), lengths)
        pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lengths) + doc, return_counts=True)
        term, doc = np.divmod(pairs, len(lengths))
        sizes = np.bincount(term)
        most = np.maximum.reduceat(_weights(tf, lengths[doc], mean), np.cumsum(sizes) - sizes)
        of = to_arrow_schema(schema)
        values = [part.column(0), pa.array(lengths), coded.dictionary, pa.array(sizes), pa.array(most), pa.array(doc), pa.array(tf)]
        columns = [pa.ListArray.from_arrays([0, len(v)], v.cast(f.type.value_type)).cast(f.type) for v, f in zip(values, of)]
        return pa.RecordBatch.from_arrays(columns, schema=of)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, bucket_docs):
                out = bucket(batch.slice(at, bucket_docs))
                if out is not None:
                    yield out

    buckets = words.mapInArrow(deal, schema)
    if path:
        buckets.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
        buckets = docs.sparkSession.read.parquet(path)
    else:
        buckets = cut(buckets)
    return PostingIndex(buckets, n_docs, mean, key)


def spoken(queries: DataFrame, query_key: str, text_col: str) -> DataFrame:
    """``query, term, q``: how often each query has each term."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("(\\w+)"), 1)
    return queries.select(F.col(query_key).alias("query"), F.explode(words).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).cast("double").alias("q"))


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Best:
    """The best ``k`` documents of each of ``n`` queries among the buckets of a task."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.found = k, np.full(n, -np.inf), [[] for _ in range(n)]

    def add(self, query: int, score: float, key: object) -> None:
        own = self.found[query]
        own.append((-round(score, 9), key is not None, key, score))
        if len(own) >= 4 * self.k:
            self.trim(query)

    def trim(self, query: int) -> None:
        own = sorted(self.found[query])[: self.k]
        self.found[query] = own
        if len(own) == self.k:
            self.least[query] = -own[-1][0]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one behind the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _pass(index: PostingIndex, asked: DataFrame, k: int, first: int) -> DataFrame:
    """``query, id, score``: the best ``k`` of each task for the queries of ``asked`` (``query, term, q``)."""
    rows = asked.orderBy("query", "term").collect()
    queries = list(dict.fromkeys(r["query"] for r in rows))
    terms = sorted({r["term"] for r in rows})
    query_no, term_no = {q: i for i, q in enumerate(queries)}, {t: i for i, t in enumerate(terms)}
    of_query, of_term = np.array([query_no[r["query"]] for r in rows], dtype=np.int64), np.array([term_no[r["term"]] for r in rows], dtype=np.int64)
    times, mean, n = np.array([r["q"] for r in rows], dtype=np.float64), index.mean, len(queries)
    schema = StructType([StructField("query", asked.schema["query"].dataType), StructField("id", index.buckets.schema["ids"].dataType.elementType), StructField("score", DoubleType())])

    def score(bucket: dict[str, pa.Array], best: _Best, bounded: bool, wanted: pa.Array) -> None:
        own = pc.index_in(bucket["terms"], value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False)
        block_of = np.full(len(terms), -1)
        met = np.nonzero(own >= 0)[0]
        block_of[own[met]] = met
        pair = np.nonzero(block_of[of_term] >= 0)[0]
        most, sizes = (bucket[c].to_numpy(zero_copy_only=False) for c in ("most", "sizes"))
        if bounded:
            bound = np.bincount(of_query[pair], times[pair] * most[block_of[of_term[pair]]], minlength=n)
            pair = pair[(bound * (1 + SLACK) + SLACK >= best.least)[of_query[pair]]]
        if not len(pair):
            return
        block = block_of[of_term[pair]]
        at = _ranges((np.cumsum(sizes) - sizes)[block], sizes[block])
        docs, tf, lengths = (bucket[c].to_numpy(zero_copy_only=False) for c in ("docs", "tf", "lengths"))
        doc = docs[at]
        weight = np.repeat(times[pair], sizes[block]) * _weights(tf[at], lengths[doc], mean)
        scores = np.bincount(np.repeat(of_query[pair], sizes[block]) * len(lengths) + doc, weight, minlength=n * len(lengths)).reshape(n, -1)
        # Equal to the last place that counts is good enough: the smaller key may win.
        for q, d in zip(*np.nonzero((scores > 0) & (scores >= best.least[:, None] - 2 * SLACK))):
            best.add(int(q), float(scores[q, d]), bucket["ids"][int(d)].as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, wanted, seen = _Best(n, k), pa.array(terms, pa.string()), 0
        for batch in batches:
            for i in range(batch.num_rows):
                score({name: batch.column(j)[i].values for j, name in enumerate(batch.schema.names)}, best, seen >= first, wanted)
                seen += 1
        for q in range(n):
            best.trim(q)
            if best.found[q]:
                found = best.found[q]
                columns = [[queries[q]] * len(found), [f[2] for f in found], [f[3] for f in found]]
                of = to_arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, of)], schema=of)

    return index.buckets.select("ids", "lengths", "terms", "sizes", "most", "docs", "tf").mapInArrow(run, schema)


def search_postings(index: PostingIndex, queries: DataFrame, k: int, query_key: str = "id", text_col: str = "text", idf: bool = False, first: int = FIRST_BUCKETS) -> DataFrame:
    """``query, rank, id, score``: the ``k`` best documents with a term of the query; ties go to the smaller key.

    Weights count as often as the query has the term, with ``idf`` times its rarity. More queries
    than one pass answers are dealt over passes.
    """
    asked = cut(spoken(queries, query_key, text_col))
    n_queries, n_terms = asked.agg(F.count_distinct("query"), F.count(F.lit(1))).first()
    if idf:
        wanted = asked.select("term").distinct()
        blocks = index.buckets.select(F.explode(F.arrays_zip("terms", "sizes")).alias("b")).select("b.terms", "b.sizes").toDF("term", "size")
        df = blocks.join(F.broadcast(wanted) if n_terms <= PASS_TERMS else wanted, "term").groupBy("term").agg(F.sum("size").alias("df"))
        rarity = F.log(1 + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = cut(asked.join(df, "term").select("query", "term", (F.col("q") * rarity).alias("q")))
    passes = max(1, -(-n_queries // PASS_QUERIES), -(-n_terms // PASS_TERMS))
    found = None
    for i in range(passes):
        own = _pass(index, asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i), k, first)
        found = own if found is None else found.unionByName(own)
    return _top(found, k).select("query", "rank", "id", "score")


def reachable(bounds: DataFrame, threshold: DataFrame) -> DataFrame:
    """Buckets whose bound reaches the threshold of the query, if it has one yet."""
    reaches: Column = F.col("least").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("least"))
    return bounds.join(threshold, "query", "left").where(reaches)


def fuse(legs: list[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion for each query of ranked lists ``query, rank, id``; ties go to the list and rank seen first."""
    every = None
    for i, leg in enumerate(legs):
        one = leg.select("query", "id", "rank", F.lit(i).alias("leg"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("query", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "first.leg", "first.rank")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "id", "score")
