"""Whitening of embeddings by a tiled covariance.

Dimensions are dealt into column blocks, and pairs of column blocks are tiles. Rows are gathered
in row blocks; the column blocks of one row block meet by a shuffle on its key, tile pairs are
multiplied and summed, first within a task, then per tile over all tasks. Memory of a task is one
row block and one set of tiles, whatever the number of rows. The matrix that the tiles make up
has the size of the dimensions alone, and its eigenvectors are found on the driver.

Entries are integers, so counts and sums are exact, and every row is centred before anything is
multiplied: large common offsets cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches

#: Dimensions in a column block, and rows in a row block at most.
TILE, BLOCK_ROWS = 64, 4096
#: Groups of tasks whose sums of one tile are added before those of all.
SALTS = 32
#: Entries whose scaled value has no exact double counterpart are as broken as infinite ones.
LARGEST = float(1 << 52)
#: Eigenvalues with a smaller share of the trace are rounding errors of it, at least in part.
ZERO_SHARE = 1e-12

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column without nulls, all of ``dims`` entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def fit_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: float, offset: int) -> DataFrame:
    """``vec_id, x``: floor(scale * entry) + offset for each vector without null or non-finite entries."""
    entry = F.col("v").cast("array<double>")
    sound = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c * F.lit(scale)) < F.lit(LARGEST)))
    whole = F.transform(entry, lambda c: F.floor(c * F.lit(scale)).cast("long") + F.lit(offset).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & sound).select("vec_id", whole.alias("x"))


def column_sums(rows: DataFrame, dims: int, kind: str) -> tuple[int, list]:
    """(number of rows, sum of each dimension) of the array column ``x``; sums of longs are exact."""
    exact = kind == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=object if exact else np.float64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            n += len(x)
            if exact:  # two halves, so that no sum of a batch leaves 64 bits
                total = total + (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
            else:
                total += x.sum(axis=0)
        if n:
            values = pa.array([str(t) for t in total]) if exact else pa.array(total)
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), values, pa.array([n] * dims, pa.int64())], ["dim", "total", "n"])

    partial = rows.select("x").mapInArrow(run, f"dim int, total {'string' if exact else 'double'}, n long")
    sums = partial.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)" if exact else "double")).alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    if not sums:
        return 0, []
    return sums[0]["n"], [int(r["total"]) if exact else float(r["total"]) for r in sums]


def _column_blocks(dims: int, base: np.ndarray, tile: int, block_rows: int):
    """Rows of ``x`` as column blocks of row blocks: entries less ``base``, in the smallest type that holds them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first, nth = (context.partitionId() if context else 0) << 32, 0
        waiting: list[np.ndarray] = []

        def blocks(x: np.ndarray) -> pa.RecordBatch:
            parts = [np.ascontiguousarray(x[:, i : i + tile]) for i in range(0, dims, tile)]
            if x.dtype == np.int64:
                parts = [p.astype(np.int32) if len(p) and np.abs(p).max() < 1 << 31 else p for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array([first + nth] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([p.dtype.str for p in parts]), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["row_block", "column_block", "kind", "entries"],
            )

        for batch in batches:
            waiting.append(_matrix(batch.column("x"), dims) - base)
            while sum(map(len, waiting)) >= block_rows:
                x = np.concatenate(waiting)
                yield blocks(x[:block_rows])
                waiting, nth = [x[block_rows:]], nth + 1
        if sum(map(len, waiting)):
            yield blocks(np.concatenate(waiting))

    return run


def _tile_products(dims: int, centre: np.ndarray, tile: int):
    """Sums over a task's row blocks of the products of their tile pairs, one row a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        block, columns = None, {}

        def multiply() -> None:
            for i, a in columns.items():
                for j, b in columns.items():
                    if i <= j:
                        sums[i, j] = sums[i, j] + a.T @ b if (i, j) in sums else a.T @ b
            columns.clear()

        for batch in batches:
            for row_block, at, kind, entries in zip(*(batch.column(c).to_pylist() for c in ("row_block", "column_block", "kind", "entries"))):
                if row_block != block:
                    multiply()
                    block = row_block
                own = centre[at * tile : (at + 1) * tile]
                columns[at] = np.frombuffer(entries, dtype=kind).reshape(-1, len(own)) - own
        multiply()
        yield _tiles(sums)

    return run


def _tiles(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].ravel() for k in keys], pa.list_(pa.float64()))],
        ["i", "j", "products"],
    )


def _add_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        products = batch.column("products")
        for row, key in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist())):
            values = products[row].values.to_numpy(zero_copy_only=False)
            sums[key] = sums[key] + values if key in sums else values.copy()
    yield _tiles(sums)


def tiled_covariance(rows: DataFrame, dims: int, n: int, base: np.ndarray, centre: np.ndarray, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The covariance (divisor ``n``) of the array column ``x`` about ``base + centre``."""
    blocks = rows.select("x").mapInArrow(_column_blocks(dims, base, tile, block_rows), "row_block long, column_block int, kind string, entries binary")
    met = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")
    schema = "i int, j int, products array<double>"
    partial = met.mapInArrow(_tile_products(dims, centre, tile), schema)
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("i", "j", "salt").drop("salt").mapInArrow(_add_tiles, schema)
    out = np.zeros((dims, dims))
    for r in salted.repartition("i", "j").mapInArrow(_add_tiles, schema).toArrow().to_pylist():
        i, j = r["i"] * tile, r["j"] * tile
        rest = min(tile, dims - j)
        part = np.array(r["products"]).reshape(-1, rest)
        out[i : i + len(part), j : j + rest] = part
        out[j : j + rest, i : i + len(part)] = part.T
    return out / n


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum over dimensions of (n*x - sum)^2, exactly; None where it leaves 64 bits."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
    if n * top < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        away = x * n - np.array(sums, dtype=np.int64)
        most = int(np.abs(away).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return (away * away).sum(axis=1).tolist()
        away = away.astype(object)
    else:
        away = x.astype(object) * n - np.array(sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1)]


def whiten_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    components: int = 32,
    scale: float = 64.0,
    offset: int = 1_000_000,
    tile: int = TILE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per vector and component, in the order of falling eigenvalue, ``components`` at most.

    Columns: ``vec_id, component`` (from 1), ``n`` (vectors fitted on, which are all that stay),
    ``deviation`` (sum over dimensions of (n*x - S)^2, exactly), ``whitened``, ``explained``
    (eigenvalue over the trace) and ``identity_error`` (largest entry of the covariance of
    ``whitened`` less the identity).

    Defined cases: vectors that are null, empty, or hold null or non-finite entries, or entries
    too large for exact arithmetic (2^52 once scaled), are left out, and so are those of another
    length than the most frequent one (of equally frequent ones the longest). A null id stays
    null; repeated rows count one by one; an eigenvalue that is zero to double precision has no
    component, so equal vectors alone give no rows; a deviation beyond 64 bits is null; an empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    sound = fit_rows(vectors, id_col, vec_col, scale, offset)
    empty = spark.createDataFrame([], WHITENED)
    common = sound.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return empty
    dims = common["dims"]
    rows = sound.where(F.size("x") == dims)
    n, sums = column_sums(rows, dims, "long")
    base = [s // n for s in sums]
    centre = np.array([(s - n * b) / n for s, b in zip(sums, base)])
    base = np.array(base, dtype=np.int64)
    covariance = tiled_covariance(rows, dims, n, base, centre, tile, block_rows)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(covariance))
    real = int((values > ZERO_SHARE * max(trace, 0.0)).sum())
    kept = min(components, real)
    if not kept:
        return empty
    explained = (values[:kept] / trace).tolist()
    project = axes[:, :kept] / np.sqrt(values[:kept])

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - base) - centre) @ project

    def only_whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(whitened(_matrix(batch.column("x"), dims)).ravel()), kept).cast(pa.list_(pa.float64()))], ["x"])

    projected = rows.select("x").mapInArrow(only_whitened, "x array<double>")
    mean = np.array(column_sums(projected, kept, "double")[1]) / n
    error = float(np.abs(tiled_covariance(projected, kept, n, np.zeros(kept), mean, tile, block_rows) - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WHITENED.split(", ")]
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            count = len(x)
            pick = pa.array(np.repeat(np.arange(count), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pick),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * kept, n, dtype=np.int64)),
                    pa.array(exact_deviation(x, n, sums), pa.int64()).take(pick),
                    pa.array(whitened(x).ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * kept, error)),
                ],
                names,
            )

    return rows.mapInArrow(run, WHITENED)
