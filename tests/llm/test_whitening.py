"""Whitening beside a plain numpy version with exact integers."""

from fractions import Fraction

import numpy as np
import pytest

from emberline.llm.queries import op13_embedding_whitening
from emberline.llm.whitening import exact_deviation, whiten_embeddings

SCHEMA = "vec_id long, embedding array<double>, label int, n string, x string, v string, component string"


def plain(vectors, most=32):
    """(ids, deviations, whitened, explained) of sound vectors."""
    sound = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, x = len(sound), np.array([v for _, v in sound], dtype=object)
    sums = x.sum(axis=0)
    away = n * x - sums
    centred = np.array([[float(Fraction(int(a), n)) for a in row] for row in away])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(most, int((values > 1e-12 * values.sum()).sum()))
    return [i for i, _ in sound], [int(d) for d in (away * away).sum(axis=1)], centred @ axes[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()


def compare(got, vectors):
    ids, deviations, whitened, explained = plain(vectors)
    kept, n = len(explained), len(ids)
    assert len(got) == n * kept and {r["n"] for r in got} == {n}
    by = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["deviation"], r["whitened"], r["explained"]) for r in got), key=lambda r: r[:4])
    order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0))
    table = np.array([r[4] for r in by]).reshape(n, kept)
    assert [r[3] for r in by[::kept]] == [deviations[i] for i in order]
    assert np.allclose([r[5] for r in by[:kept]], explained, rtol=1e-6)
    want = whitened[order]
    for c in range(kept):
        sign = np.sign(table[:, c] @ want[:, c])
        assert np.allclose(table[:, c] * sign, want[:, c], atol=1e-6), c
    assert max(r["identity_error"] for r in got) < 1e-8


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    compare(op13_embedding_whitening(spark, "/root/testdata/sf0.01").collect(), rows)


@pytest.mark.parametrize("tile, block_rows", [(2, 7), (3, 1000), (64, 1)])
def test_tiles_and_blocks(spark, tile, block_rows):
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.normal(size=8) @ np.diag(np.arange(1, 9)) + 1000).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0, "", "", "", "") for i, v in rows], SCHEMA).repartition(5)
    compare(whiten_embeddings(df, tile=tile, block_rows=block_rows).collect(), rows)


def test_odd_vectors(spark):
    rnd = np.random.default_rng(6)
    good = [(i, rnd.normal(size=3).tolist()) for i in range(12)]
    good += [(None, [0.5, -2.0, 3.25]), (3, good[3][1])]
    broken = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 0.0]), (54, [float("inf"), 0.0, 0.0]), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "", "", "", "") for i, v in good + broken], SCHEMA).repartition(3)
    got = whiten_embeddings(df).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in good}
    repeated = [r for r in got if r["vec_id"] == 3]
    assert len(repeated) == 2 * 3
    rest = [(i, v) for i, v in good if v != good[3][1]] + [(3, good[3][1])] * 2
    ids, deviations, _, explained = plain(rest)
    assert {r["deviation"] for r in got} == set(deviations) and np.allclose(sorted({r["explained"] for r in got})[::-1], explained)
    assert whiten_embeddings(df.limit(0)).count() == 0
    assert whiten_embeddings(spark.createDataFrame([(i, [1.0, 2.0], 0, "", "", "", "") for i in range(4)], SCHEMA)).count() == 0


def test_constant_dimension_has_no_component(spark):
    rows = [(i, [float(i), 5.0, float(i * i)]) for i in range(9)]
    got = whiten_embeddings(spark.createDataFrame([(i, v, 0, "", "", "", "") for i, v in rows], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2}
    compare(got, rows)


def test_deviation_beyond_64_bits():
    x = np.array([[10**6, 0], [0, 3]], dtype=np.int64)
    assert exact_deviation(x, 10**9, [0, 0]) == [None, 9 * 10**18]
    assert exact_deviation(x, 10**13, [0, 0]) == [None, None]
    assert exact_deviation(x, 2, [10**6, 3]) == [10**12 + 9, 10**12 + 9]
