"""Searches for many queries: cells and posting blocks beside brute force, hot vectors and hot terms."""

import random
from collections import Counter

import numpy as np
import pytest

from emberline.operators import postings, vector_index
from emberline.search_queries import dense_topk_cells, dense_topk_many

SF = "/root/testdata/sf0.1"


def test_recall_of_cells(spark):
    """Ids divisible by 100 against all vectors: at least nine in ten of the ten nearest, in a part of the cells."""
    near = {(r["query"], r["id"]) for r in dense_topk_cells(spark, SF).collect()}
    exact = {(r["query"], r["id"]) for r in dense_topk_many(spark, SF).collect()}
    assert len(exact) == 200 and len(near & exact) >= 0.9 * len(exact)


def test_every_point_is_in_one_cell(spark, tmp_path):
    points = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vector_index.build_index(points, "vec_id", "embedding", path=str(tmp_path / "cells"))
    assert index.points.select("vec_id").distinct().count() == index.points.count() == points.count()
    assert index.points.select("cell").distinct().count() > 20 and index.probes < len(index.centres)


def plain_nearest(points, asked, k):
    def unit(v):
        n = np.linalg.norm(v)
        return np.array(v) / (n if n else 1.0)

    out = []
    for q, v in asked:
        scored = sorted((-round(float(unit(v) @ unit(p)), 9) + 0.0, i) for i, p in points)
        out += [(q, rank, i, round(-s, 6) + 0.0) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 3)])
def test_hot_and_odd_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(vector_index, "POINT_BLOCK", blocks[0])
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", blocks[1])
    rnd = np.random.default_rng(4)
    common = [1.0, -2.0, 0.5]
    good = [(i, common if i % 3 == 0 else rnd.normal(size=3).round(3).tolist()) for i in range(120)] + [(500, [0.0, 0.0, 0.0])]
    broken = [(600, None), (601, []), (602, [1.0, None, 2.0]), (603, [float("nan"), 1.0, 1.0]), (604, [1.0, 2.0])]
    schema = "id long, dense array<double>, cell2 string, score string, rank int, label int"
    df = spark.createDataFrame([(i, v, "x", "y", 1, i % 2) for i, v in good + broken], schema).repartition(4)
    index = vector_index.build_index(df, cells=6)
    asked = df.where("id % 10 = 0")
    got = sorted((r["query"], r["rank"], r["id"], round(r["score"], 6) + 0.0) for r in vector_index.search(index, asked, 4, exact=True).collect())
    wanted = [(i, v) for i, v in good if i % 10 == 0]
    assert got == plain_nearest(good, wanted, 4)
    from pyspark.sql import functions as F

    got = sorted((r["query"], r["rank"], r["id"], round(r["score"], 6) + 0.0) for r in vector_index.search(index, asked, 4, conditions=(F.col("label") == 1,), exact=True).collect())
    assert got == plain_nearest([p for p in good if p[0] % 2], wanted, 4)
    assert vector_index.build_index(df.limit(0)) is None
    assert vector_index.search(index, df.limit(0), 4).count() == 0


def plain_sparse(docs, asked, k):
    import re

    words = {d: re.findall(r"\w+", (t or "").lower()) for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    out = []
    for q, text in asked:
        terms = Counter(re.findall(r"\w+", (text or "").lower()))
        scored = []
        for d, w in words.items():
            tf = Counter(w)
            own = [n * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in terms.items() if t in tf]
            if own:
                scored.append((-round(sum(own), 9), d))
        out += [(q, rank, d, round(-s, 6)) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket_docs, first", [(3, 1), (1000, 2), (10, 5)])
def test_postings_same_as_a_scan(spark, bucket_docs, first):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(["the", "the", "of", "a", *[f"w{j}" for j in range(30)]]) for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "Only w1, W1 and w2!"), (903, "the " * 4000)]
    asked = [(1, "the w1 w2 w2"), (2, "of w29"), (3, "missing"), (4, None), (5, "The OF a w3 w4 w5 w6")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "id long, text string, bucket string").repartition(4)
    index = postings.build_postings(df, bucket_docs=bucket_docs)
    queries = spark.createDataFrame(asked, "id long, text string")
    got = sorted((r["query"], r["rank"], r["id"], round(r["score"], 6)) for r in postings.search_postings(index, queries, 5, first=first).collect())
    assert got == plain_sparse(docs, asked, 5)


def test_buckets_below_the_threshold_are_not_read(spark):
    bounds = spark.createDataFrame([(1, 0, 5.0), (1, 1, 2.0), (1, 2, 3.0), (2, 0, 1.0)], "query long, bucket int, bound double")
    threshold = spark.createDataFrame([(1, 3.0)], "query long, least double")
    assert sorted(tuple(r)[:2] for r in postings.reachable(bounds, threshold).select("query", "bucket").collect()) == [(1, 0), (1, 2), (2, 0)]


def test_postings_stay_in_their_tasks(spark, monkeypatch):
    """Every document is in one bucket, built without a shuffle; a pass gives each task's best alone, and passes do not mix; copies tie."""
    docs = [(i, " ".join(f"w{j}" for j in range(i % 7 + 1))) for i in range(400)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(4)
    index = postings.build_postings(df, bucket_docs=16)
    assert sorted(i for r in index.buckets.select("ids").collect() for i in r["ids"]) == list(range(400))
    asked = [(q, f"w{q % 8} w0 w0 w{q % 3}") for q in range(20)]
    queries = spark.createDataFrame(asked, "id long, text string")
    told = postings._pass(index, postings.spoken(queries, "id", "text"), 3, 1)
    assert told.count() <= 3 * 20 * told.rdd.getNumPartitions() and "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(postings, "PASS_QUERIES", 6)
    got = sorted((r["query"], r["rank"], r["id"], round(r["score"], 6)) for r in postings.search_postings(index, queries, 3).collect())
    assert got == plain_sparse(docs, asked, 3)
