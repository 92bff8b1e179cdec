"""Near duplicates and repeated passages against brute force; components; the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from odd import ODD, PASSAGE, TWICE, frame

from pyspark.sql import functions as F

from emberline.llm import closing
from emberline.llm.closing import whole_groups
from emberline.llm.components import connected_components
from emberline.llm.near_dedup import near_duplicates
from emberline.llm.prefix_doubling import remove_repeats_by_doubling
from emberline.llm.suffix_dedup import remove_repeats, removed_runs

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_components(data, k):
    sets = {d: shingles(t, k) for d, t in data}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        common = Counter(o for g in sets[d] for o in holders[g])
        for g in sets[d]:
            holders[g].append(d)
        for o, c in common.items():
            if 100 * c >= 80 * (len(sets[d]) + len(sets[o]) - c):
                a, b = find(o), find(d)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), d == find(d)) for d in sets}


def near(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, **kw).collect()}


def corpus(seed, n=250):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(1, 60))] for _ in range(8)]
    out = []
    for i in range(n):
        own = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, max(1, len(own) // 8))):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        out.append((i + 100, " ".join(own).upper() if i % 7 == 0 else " ".join(own)))
    return out


def test_near_same_as_plain(spark):
    data = corpus(5) + [(d, t) for d, t, *_ in ODD if d is not None]
    df = frame(spark, [(d, t, "en", "a") for d, t in data])
    assert near(df, width=2) == plain_components(data, 2)


@pytest.mark.parametrize("seed", [6, 7])
def test_near_large_groups_are_dealt_out(spark, seed):
    data = corpus(seed, 400)
    df = frame(spark, [(d, t, "en", "a") for d, t in data], clashing=False)
    assert near(df, width=2, post_rows=20, family_rows=20, family_shingles=500) == plain_components(data, 2)


def one_large_group(spark, monkeypatch, n, hot):
    """Pairs inside one group of ``n`` that share a mark and a key; ``hot`` adds a key that a twentieth of all have. Rows sent to the kernel, and labels."""
    sent = []

    def same_mark(batches):
        for rows in whole_groups(batches, "task", 1000):
            pairs = defaultdict(list)
            for task, node, mark in zip(*(rows.column(c).to_pylist() for c in ("task", "node", "mark"))):
                pairs[task, mark].append(node)
            links = [(p[0], b) for p in pairs.values() for b in p[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    monkeypatch.setattr(closing, "_linked_in", lambda tasks, *rest, to=closing._linked_in: sent.append(tasks.count()) or to(tasks, *rest))
    nodes = spark.range(n).select(F.col("id").alias("node"), (F.col("id") % (n // 2)).alias("mark"))
    members = nodes.select("*", F.lit(-1).cast("long").alias("grp"), F.lit(1).alias("weight"))
    second = F.when(F.col("node") % 20 == 0, F.lit(-2)).otherwise(-10 - F.col("node")) if hot else -10 - F.col("node")
    keys = nodes.select("node", F.array(F.lit(-1).cast("long"), F.col("mark"), second.cast("long")).alias("keys"))
    labels = closing.close_groups(members, keys, ["mark"], same_mark, 100, 100)
    monkeypatch.undo()
    return sum(sent), {r["node"]: r["label"] for r in labels.collect()}


def test_unlinked_members_of_a_large_group_cost_rows_in_proportion(spark, monkeypatch):
    for n in (2000, 8000):
        rows, labels = one_large_group(spark, monkeypatch, n, hot=False)
        assert labels == {x: x % (n // 2) for x in range(n)}
        assert rows <= 4 * n, (n, rows)


def test_members_with_a_second_key_in_common_meet(spark, monkeypatch):
    rows, labels = one_large_group(spark, monkeypatch, 2000, hot=True)
    assert labels == {x: x % 1000 for x in range(2000)}
    assert rows <= 10 * 2000, rows


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 6])
def test_near_texts_of_few_words(spark, width):
    for n in range(7):
        text = " ".join("abcdefg"[:n])
        got = near(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1), width=width)
        assert got == plain_components([(1, text)], width)


def test_near_repeated_ids(spark):
    rows = [(1, "a b c d e f g h i j k l"), (1, "p q r s t u v w x y z 1"), (2, "a b c d e f g h i j k l m"), (3, "p q r s t u v w x y z 1 2"), (None, "a b c d e f g h i j k l")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in out) == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_near_odd_rows(spark, empty):
    assert near_duplicates(empty).count() == 0
    out = near_duplicates(frame(spark, [*ODD, *TWICE]), width=2).collect()
    assert len(out) == len(ODD) + 2
    by = {r["doc_id"]: r for r in out}
    assert by[12]["component_id"] == by[13]["component_id"] == 12 and by[1]["n_shingles"] == 0 and by[2]["kept"] and by[9]["component_id"] == 8
    assert [r["kept"] for r in out if r["doc_id"] == 20] == [True, True]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert {x: find(x) for x in parent if x in got or x not in loops} == got


def plain_removal(data, length=100):
    seen, out = set(), {}
    for key, text in sorted(data):
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        kept = bytes(c for c, h in zip(raw, hit) if not h)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out[key] = (len(raw), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def removal(df, **kw):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, **kw).collect()}


@pytest.mark.parametrize("group_rows, partitions", [(5000, 3), (1, 3), (1, 1)])
def test_removal_same_as_plain(spark, group_rows, partitions):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("ab cd") for _ in range(n))
    passages = [text(rnd.randint(60, 400)) for _ in range(12)]
    data = []
    for i in range(120):
        pieces = [rnd.choice([rnd.choice(passages), text(rnd.randint(0, 90)), rnd.choice(passages)[: rnd.randint(50, 150)], "xy" * rnd.randint(0, 150), "é" * rnd.randint(0, 80)]) for _ in range(rnd.randint(0, 6))]
        data.append((i + 100, "".join(pieces)))
    data += [(d, t) for d, t, *_ in ODD if d is not None and d not in (8, 9)]
    df = frame(spark, [(d, t, "en", "a") for d, t in data], partitions)
    assert removal(df, group_rows=group_rows) == plain_removal(data)


@pytest.mark.parametrize("length, start", [(100, 16), (100, 100), (37, 5)])
def test_plain_doubling_same_as_plain(spark, length, start):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("ab cd") for _ in range(n))
    passages = [text(rnd.randint(60, 200)) for _ in range(6)]
    data = [(i, "".join(rnd.choice([rnd.choice(passages), text(rnd.randint(0, 90)), "xy" * rnd.randint(0, 60), "é" * rnd.randint(0, 60)]) for _ in range(rnd.randint(0, 5)))) for i in range(40)] + [(40, None), (41, "")]
    df = frame(spark, [(d, t, "en", "a") for d, t in data])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats_by_doubling(df, length=length, start=start).collect()}
    assert got == plain_removal(data, length)


def test_removal_odd_rows(spark, empty):
    assert remove_repeats(empty).count() == 0
    out = remove_repeats(frame(spark, [*ODD, *TWICE]), with_text=True).collect()
    assert len(out) == len(ODD) + 2
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_bytes"] == by[2]["n_removed"] == 0 and by[9]["n_removed"] > 40_000 and by[8]["n_removed"] > 0
    twice = [r for r in out if r["doc_id"] == 20]
    assert twice[0]["kept_sha256"] == twice[1]["kept_sha256"] and bytes(twice[0]["kept_bytes"]).startswith(b"twice here")
    assert PASSAGE.encode() not in bytes(by[6]["kept_bytes"])


def test_removed_runs():
    assert removed_runs(500, [(0, 3), (50, 60), (300, 300), (-5, -1)], 100) == [(0, 160), (300, 400)]
    assert removed_runs(50, [(0, 0)], 100) == []


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "pack"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toArrow(), out.schema)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] > sizes[3] == sizes[4] > 0
    packed = p.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (7, text), (7, text + " end"), (8, text), (None, text), (None, "alone " + text[::-1]), (9, ""), (10, None)]
    out = p.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_id", F.lit("x")), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] is not None and len(r["text"]) > 0) for r in out) == [(0, True), (7, True), (9, False), (10, False)]


def test_pipeline_same_as_plain(spark):
    """Each stage after the learned one beside SQL or plain Python, over the same rows; the whole run ends in the same pieces."""
    import corpus_pipeline as p
    import zlib

    import numpy as np
    from odd import sql_rows
    from tokenizers import Tokenizer

    from emberline.llm.queries import ORACLE_SQL, tokenizer_path

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = p.language_id(spark, docs, sf)
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    cleaned = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, first, sf).collect()}
    want = {dict(zip(("doc_id", "kept_sha256", "n_dropped", "n_lines"), r))["doc_id"]: r[1] for r in sql_rows(ORACLE_SQL["op8_line_dedup"], documents=first.select("doc_id", "text"))}
    assert set(cleaned) == set(texts) and {d: hashlib.sha256(t.encode()).hexdigest() for d, t in cleaned.items()} == want
    parts = plain_components(list(cleaned.items()), 5)
    kept = {d: cleaned[d] for d, (_, root, _) in parts.items() if d == root}
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = set()
    for d, t in kept.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            pieces.add((d, k // 2048, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    out = p.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out} == pieces and len(out) == len(pieces)
    used = defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(used) <= -(-sum(x[3] for x in pieces) // 2048) + 2


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as p

    docs = frame(spark, [*ODD, *TWICE])
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toArrow(), out.schema)
    assert docs.count() > 5 and p.STAGES[-1][1](spark, docs, "").count() > 0
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0
