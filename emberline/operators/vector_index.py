"""Nearest vectors for many queries at once: an inverted file of cells.

Cells are found by k-means on a bounded sample; every point is in the cell of its nearest centre.
A query visits its nearest cells, or all of them for an exact answer. Points and queries of a cell
meet by an equi-join in blocks of bounded size, so a cell with most of the points, or one that
most queries visit, is many tasks. How many cells a query has to visit is measured on the sample.
Scores are cosines, rounded to nine places so that equal vectors are equal; ties go to the
smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .retrieval import apply_filter

#: Vectors that cells are trained on, and cells at most.
SAMPLE_ROWS, MOST_CELLS = 20_000, 2048
#: Points and queries in a block.
POINT_BLOCK, QUERY_BLOCK = 4096, 1024
DIGITS = 9


@dataclass(frozen=True)
class VectorIndex:
    """``points``: ``cell`` and the columns of the indexed table; ``probes`` cells reach the measured recall on the sample."""

    points: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    probes: int
    key: str
    vector: str


def unit(flat: np.ndarray) -> np.ndarray:
    """Rows made unit length; a zero row stays zero and has the cosine 0 with all."""
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(norm > 0, norm, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def train_cells(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centres of k-means by cosine; a centre that nobody is near stays where it was."""
    rnd = np.random.default_rng(seed)
    centres = sample[rnd.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        held = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(held[:, None], unit(sums), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float, k: int = 10, queries: int = 300) -> int:
    """The fewest cells that a query of the sample visits for so much of its exact ``k`` nearest in the sample."""
    near = np.argmax(sample @ centres.T, axis=1)
    asked = sample[:: max(1, len(sample) // queries)]
    best = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    rank = np.empty((len(asked), len(centres)), dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-(asked @ centres.T), axis=1, kind="stable"), np.arange(len(centres))[None, :], axis=1)
    needed = np.take_along_axis(rank, near[best], axis=1).ravel()
    return int(np.quantile(needed, recall, method="higher")) + 1


def _sound(vector: str, dims: int | None = None) -> Column:
    there = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return there & (F.size(vector) > 0 if dims is None else F.size(vector) == dims)


def build_index(points: DataFrame, key: str = "id", vector: str = "dense", cells: int | None = None, recall: float = 0.97, path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex | None:
    """The index of all ``points`` (every column is kept); with ``path`` a Parquet table by cell. None without points.

    Points without a vector, with null or non-finite entries, or of another length than the
    longest vector of the sample are in no cell.
    """
    sound = points.where(_sound(vector))
    sample = sound.select(vector, F.xxhash64(key).alias("_at")).orderBy("_at").limit(sample_rows).select(vector).toArrow().column(0).combine_chunks()
    if not len(sample):
        return None
    lengths = np.diff(sample.offsets.to_numpy())
    dims = int(lengths.max())
    known = unit(np.array([v for v in sample.to_pylist() if len(v) == dims], dtype=np.float64))
    n = sound.count()
    centres = train_cells(known, min(MOST_CELLS, cells or max(1, round(n**0.5))))
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argmax(matrix(batch.column(vector)) @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], ["cell", *names])

    schema = "cell int, " + ", ".join(f"`{c}` {kind}" for c, kind in points.dtypes)
    dealt = points.where(_sound(vector, dims)).mapInArrow(run, schema)
    if path:
        dealt.repartition("cell", F.pmod(F.xxhash64(key), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(path)
        dealt = points.sparkSession.read.parquet(path).withColumn("cell", F.col("cell").cast("int")).select("cell", *names)
    else:
        dealt = cut(dealt)
    sizes = cut(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    return VectorIndex(dealt, sizes, centres, probes_for(known, centres, recall), key, vector)


def _best(k: int, key_type: pa.DataType):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = points.column("id").combine_chunks(), queries.column("asked").combine_chunks()
        if not len(ids) or not len(asked):
            return pa.table([pa.array([], asked.type), pa.array([], key_type), pa.array([], pa.float64())], names=["asked", "id", "score"])
        scores = np.round(matrix(queries.column("vector")) @ matrix(points.column("vector")).T, DIGITS)
        order = ids.to_numpy(zero_copy_only=False)
        if len(ids) > k:
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            q, p = np.nonzero(scores >= least[:, None])
        else:
            q, p = np.nonzero(np.ones_like(scores, dtype=bool))
        sort = np.lexsort((order[p], -scores[q, p], q))
        q, p = q[sort], p[sort]
        first = np.searchsorted(q, np.arange(len(asked)))
        top = np.arange(len(q)) - first[q] < k
        q, p = q[top], p[top]
        return pa.table([asked.take(pa.array(q)), ids.take(pa.array(p)).cast(key_type), pa.array(scores[q, p])], names=["asked", "id", "score"])

    return run


def search(index: VectorIndex, queries: DataFrame, k: int, query_key: str = "id", query_vector: str = "dense", conditions: Sequence[Column] = (), probes: int | None = None, exact: bool = False) -> DataFrame:
    """``query, rank, id, score``: the ``k`` nearest points that fit ``conditions`` for each query.

    ``probes``: cells that a query visits, by default those of the index; ``exact`` visits all.
    Queries of one vector are answered once. A query without a sound vector of the index's length
    has no answer; a zero vector has the score 0 with all points.
    """
    centres = index.centres
    visited = len(centres) if exact else min(len(centres), probes or index.probes)
    points = apply_filter(index.points, conditions).select("cell", F.col(index.key).alias("id"), F.col(index.vector).cast("array<double>").alias("vector"))
    asked = queries.where(_sound(query_vector, centres.shape[1])).select(F.col(query_key).alias("query"), F.col(query_vector).cast("array<double>").alias("vector"))
    distinct = cut(asked.groupBy("vector").agg(F.min("query").alias("asked")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = np.argsort(-(matrix(batch.column("vector")) @ centres.T), axis=1, kind="stable")[:, :visited]
                pick = pa.array(np.repeat(np.arange(batch.num_rows), visited))
                yield pa.RecordBatch.from_arrays([batch.column("asked").take(pick), batch.column("vector").take(pick), pa.array(best.ravel().astype(np.int32))], ["asked", "vector", "cell"])

    kind = dict(distinct.dtypes)["asked"]
    visits = distinct.select("asked", "vector").mapInArrow(near, f"asked {kind}, vector array<double>, cell int")
    # One row a cell: as many as there are centres at most.
    waiting = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    blocks = index.sizes.join(waiting, "cell").select("cell", F.ceil(F.col("n") / POINT_BLOCK).cast("int").alias("parts"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("turns"))
    blocks = F.broadcast(cut(blocks))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    left = points.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(upto("turns")).alias("turn"), "id", "vector")
    right = visits.join(blocks, "cell").select("cell", F.explode(upto("parts")).alias("part"), F.pmod(F.xxhash64("asked"), F.col("turns")).cast("int").alias("turn"), "asked", "vector")
    at = ["cell", "part", "turn"]
    key_kind = dict(points.dtypes)["id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_kind]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_best(k, arrow), f"asked {kind}, id {key_kind}, score double")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    members = asked.join(distinct, "vector").select("query", "asked")
    return ranked.join(members, "asked").select("query", "rank", "id", "score")
