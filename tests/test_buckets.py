"""Buckets of points: what a change rewrites, and what is there afterwards."""

import random

from pyspark.sql import functions as F

from emberline.operators.incremental import file_changes
from emberline.sources.buckets import BucketedPoints, apply_changes

SCHEMA = "id long, file string, type string, n int"


def listing(path):
    """Part files of each bucket."""
    return {d.name: sorted(f.name for f in d.glob("part-*")) for d in path.glob("bucket=*")}


def rows(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_one_changed_file_rewrites_one_bucket(spark, tmp_path):
    store = BucketedPoints(spark, str(tmp_path / "p"), SCHEMA, buckets=16)
    points = [(i, f"f{i % 40}", "code_chunk", i) for i in range(400)]
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert len(store.upsert(frame(points))) == len(listing(tmp_path / "p")) > 10
    before = listing(tmp_path / "p")
    hashes = spark.createDataFrame([(f"f{i}", "old") for i in range(40)], "path string, hash string")
    changed = spark.createDataFrame([(f"f{i}", "new" if i == 3 else "old") for i in range(40)], "path string, hash string")
    chunks = frame([(1000 + i, f"f{i}", "code_chunk", 0) for i in range(40)])
    written, state = apply_changes(store, file_changes(hashes, changed), chunks)
    after = listing(tmp_path / "p")
    assert len(written) == 1 and [b for b in after if after[b] != before[b]] == [f"bucket={written[0]}"]
    assert rows(store) == sorted([p for p in points if p[1] != "f3"] + [(1003, "f3", "code_chunk", 0)])
    assert {r["path"]: r["hash"] for r in state.collect()}["f3"] == "new" and state.count() == 40
    written, _ = apply_changes(store, file_changes(changed, changed), chunks)
    assert written == [] and listing(tmp_path / "p") == after


def test_random_changes_same_as_a_dict(spark, tmp_path):
    rnd, store, known = random.Random(2), BucketedPoints(spark, str(tmp_path / "p"), SCHEMA, buckets=5), {}
    for turn in range(6):
        new = {(f := rnd.randrange(12)) * 100 + j: (f"f{f}" if f else None, rnd.choice(["code_chunk", "pattern"]), turn) for _ in range(6) for j in range(rnd.randint(1, 3))}
        store.upsert(spark.createDataFrame([(i, *v) for i, v in new.items()], SCHEMA))
        known |= new
        file = f"f{rnd.randrange(1, 12)}"
        store.delete_files(spark.createDataFrame([(file,), (file,)], "file string"), F.col("type") == "code_chunk")
        known = {i: v for i, v in known.items() if not (v[0] == file and v[1] == "code_chunk")}
        gone = rnd.sample(sorted(known), min(3, len(known)))
        store.delete_ids(spark.createDataFrame([(i,) for i in gone], "id long"))
        known = {i: v for i, v in known.items() if i not in gone}
        assert sorted(map(str, rows(store))) == sorted(str((i, *v)) for i, v in known.items())


def test_emptied_buckets_and_nothing_to_do(spark, tmp_path):
    store = BucketedPoints(spark, str(tmp_path / "p"), SCHEMA, buckets=3)
    none = spark.createDataFrame([], SCHEMA)
    assert store.read().count() == 0 and store.upsert(none) == [] and store.delete_ids(none.select("id")) == []
    store.upsert(spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 1)], SCHEMA))
    store.delete_files(spark.createDataFrame([("a",), ("b",)], "file string"))
    assert store.read().count() == 0 and listing(tmp_path / "p") == {}
