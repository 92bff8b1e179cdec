"""Ranked search beside a plain version over all documents, and what it leaves unread."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd import LONG, ODD, PASSAGE, TWICE, frame

from emberline.llm import ranked_search
from emberline.llm.queries import op11_ranked_search
from emberline.llm.ranked_search import Shard, ShardBuilder, build_index, corpus_size, impacts, length_norm, pack_blocks, search, search_documents, unpack_block

TERM = re.compile(ranked_search.TERM_PATTERN)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """(item, rank, doc, score) rows, by scoring every document."""
    spoken = [(d, Counter(t)) for d, text in docs if (t := terms(text))]
    n, total = len(spoken), sum(sum(c.values()) for _, c in spoken)
    df = Counter(t for _, c in spoken for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in spoken:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, q string, rank int")


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    assert got(op11_ranked_search(spark, "/root/testdata/sf0.01")) == plain(docs, items)


@pytest.mark.parametrize("shard_docs, window, block, query_block, first_round", [(1, 5, 2, 2, 2), (7, 3, 2, 100, 3), (1000, 4096, 128, 1, 1), (9, 4, 3, 3, 10**9)])
def test_odd_tables(spark, shard_docs, window, block, query_block, first_round):
    rows = [*ODD, *TWICE, *[(100 + i, f"common word{i % 5} {'rare' * (i % 13 == 0)} Common", "en", "a") for i in range(40)]]
    items = [(1, PASSAGE), (2, "common WORD3 rare word3"), (3, None), (4, ""), (5, "nowhere-to-be-found zzz"), (6, "quick中文 naïve café 12"), (None, "common tea"), (2, "another text, same id: tea"), (1, PASSAGE), (7, LONG), (8, "row without an id")]
    index = build_index(frame(spark, rows, partitions=2), block=block, shard_docs=shard_docs)
    found = got(search(index, items_frame(spark, items), k=4, window=window, query_block=query_block, first_round=first_round))
    assert found == plain([r[:2] for r in rows], [i for i in items if i[1] is not None], 4)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BROADCAST_TERMS", 0)
    items = [(1, PASSAGE), (2, "tea in copper kettles")]
    assert got(search_documents(frame(spark, ODD), items_frame(spark, items))) == plain([r[:2] for r in ODD], items)


def test_empty_tables(spark):
    items = items_frame(spark, [(1, "tea")])
    assert search_documents(frame(spark, []), items).count() == 0
    assert search_documents(frame(spark, ODD), items.limit(0)).count() == 0
    assert search_documents(frame(spark, ODD[:3]), items).count() == 0


def test_blocks_round_trip():
    rnd = np.random.default_rng(1)
    sizes = np.array([1, 128, 5, 128, 3])
    starts = np.cumsum(sizes) - sizes
    docs = [np.sort(rnd.choice(10 ** (i + 3), s, replace=False)) for i, s in enumerate(sizes)]
    tf = [rnd.integers(1, 10 ** (5 - i) + 1, s) for i, s in enumerate(sizes)]
    gap = np.concatenate([np.diff(d, prepend=d[0]) for d in docs])
    packed, ends = pack_blocks(gap, np.concatenate(tf), starts, sizes)
    for i, s in enumerate(sizes.tolist()):
        d, t = unpack_block(packed[ends[i] : ends[i + 1]].tobytes(), int(docs[i][0]), s)
        assert d.tolist() == docs[i].tolist() and t.tolist() == tf[i].tolist()


def test_blocks_below_the_threshold_stay_packed():
    """A threshold near the best score leaves most blocks of frequent terms as they are; the answer is the same."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "of", "and", f"w{rnd.randint(0, 3000)}"]) for _ in range(rnd.randint(5, 60))) for _ in range(6000)]
    texts[4321] = "needle in the haystack of hay"
    texts[17] = "needle the of"
    words = [terms(t) for t in texts]
    n, total = len(texts), sum(map(len, words))
    builder = ShardBuilder(n, total, 128)
    builder.add(pa.record_batch([pa.array(range(n)), pa.array(texts)], ["doc_id", "text"]))
    rows = pa.Table.from_batches([builder.rows(0)])
    df = Counter(t for w in words for t in set(w))
    query = terms("the needle in the haystack of the and")
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(query)}
    rows = rows.filter(pa.compute.is_in(rows.column("term"), pa.array(["", *weight])))
    rows = rows.append_column("weight", pa.array([weight.get(t) for t in rows.column("term").to_pylist()], pa.int64()))
    items = [[{"q": 1, "times": query.count(t), "threshold": 0}] if t and b == 0 else None for t, b in zip(rows.column("term").to_pylist(), rows.column("block").to_pylist())]
    rows = rows.append_column("items", pa.array(items))
    shard = Shard(rows, 512)
    asked = shard.queries[1]
    docs, scores = shard.best(asked[0], asked[1], 0, 2)
    assert sorted(docs.tolist()) == [17, 4321]
    again = Shard(rows, 512)
    docs_again, scores_again = again.best(asked[0], asked[1], int(scores.min()), 2)
    assert sorted(docs_again.tolist()) == [17, 4321] and sorted(scores_again) == sorted(scores)
    # Without a first threshold it has to rise before blocks stay packed.
    assert len(again.unpacked) < 0.1 * len(again.postings) and len(shard.unpacked) < len(shard.postings)
    norm = length_norm(np.array([len(words[17])]), n, total)
    assert int(scores[docs == 17][0]) == sum(weight[t] * int(impacts(np.array([words[17].count(t)]), norm)[0]) for t in query if t in words[17])


def test_corpus_size(spark):
    assert corpus_size(frame(spark, ODD)) == (sum(bool(terms(r[1])) for r in ODD), sum(len(terms(r[1])) for r in ODD))
