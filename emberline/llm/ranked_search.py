"""Ranked lexical search: Block-Max WAND over an inverted index in shards.

**Index.** A task gathers documents into shards of bounded size and inverts each: the postings of
a term are cut into blocks of a fixed number, each block a row with its first and last document,
the largest impact in it, and the postings compressed to gaps and counts of the smallest width.
The index has every document and every term and is a table in the shared folder.

**Search.** The terms of the queries are joined to the index, so only their blocks are read.
Shards are searched apart, all queries of a block of queries at once, by windows of documents:

* shallow moves: block maxima give each term's bound in a window, without a posting read;
* the pivot condition of WAND: terms whose bounds together stay below the threshold cannot bring
  a document in by themselves, so only documents of the other terms are candidates, and a window
  in which all bounds stay below is left out;
* a candidate meets the remaining terms in falling order of their bounds: block maxima drop it as
  soon as it cannot reach the threshold, and only blocks that still hold a candidate are
  decompressed.

The threshold of a query is the score of its k-th best document so far. A first round searches
some shards; the k-th best scores of that round are lower bounds for all others, so these begin
with a threshold and send little. Nothing is lost: a bound must be below the threshold, equality
stays in. Scores and bounds are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import Words, slices, utf8
from .runtime import cut_table, small_batches

#: A shard ends with the text that makes it this large, or with this many documents.
SHARD_BYTES, SHARD_DOCS = 32 << 20, 1 << 15
#: Postings in a block, documents in a window.
BLOCK, WINDOW = 128, 4096
#: Queries that visit a shard together.
QUERY_BLOCK = 256
#: One shard in so many is searched first.
FIRST_ROUND = 16
#: Query terms, with the queries that hold them, up to which they are broadcast.
BROADCAST_TERMS = 200_000

#: Digits, ASCII letters and everything beyond ASCII.
TERM_BYTES = np.zeros(256, dtype=bool)
TERM_BYTES[0x30:0x3A] = TERM_BYTES[0x41:0x5B] = TERM_BYTES[0x61:0x7B] = TERM_BYTES[0x80:] = True
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INDEX = "shard long, term string, block int, first int, last int, most long, size int, postings binary"
HITS = "q long, doc_id long, score long"


def length_norm(n_terms: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Length of documents beside the mean, as a percentage of which a quarter is fixed."""
    return 25 + (75 * n_terms * docs) // max(total, 1)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def _terms(batch: pa.RecordBatch) -> Words:
    data, offsets = utf8(batch.column("text"))
    return Words(data, offsets, lower=True, member=TERM_BYTES)


def corpus_size(texts: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                n = np.diff(_terms(part).bounds)
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "total"])

    r = texts.select("text").mapInArrow(run, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    return r["docs"] or 0, r["total"] or 0


class ShardBuilder:
    """Inverts the documents of one shard after another."""

    def __init__(self, docs: int, total: int, block: int = BLOCK):
        self.docs, self.total, self.block = docs, total, block
        self.clear()

    def clear(self) -> None:
        self.bytes, self.ids, self.lengths = 0, [], []
        self.vocabulary: list[pa.Array] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @property
    def size(self) -> int:
        return len(self.ids)

    def add(self, batch: pa.RecordBatch) -> None:
        words = _terms(batch)
        n = np.diff(words.bounds)
        held = np.flatnonzero(n)
        if not len(held):
            return
        # Documents without a term have no place in a shard.
        place = np.cumsum(n > 0) - 1 + self.size
        vocabulary = len(words.encoded.dictionary)
        keys, tf = np.unique(words.texts * vocabulary + words.ids, return_counts=True)
        self.pairs.append((keys % vocabulary + sum(map(len, self.vocabulary)), place[keys // vocabulary], tf))
        self.vocabulary.append(words.encoded.dictionary)
        ids = batch.column("doc_id").to_pylist()
        self.ids += [ids[i] for i in held.tolist()]
        self.lengths += n[held].tolist()
        self.bytes += len(words.packed)

    def rows(self, shard: int) -> pa.RecordBatch:
        """The shard's rows, the first one without a term for its documents; then it starts anew."""
        norm = length_norm(np.array(self.lengths, dtype=np.int64), self.docs, self.total)
        encoded = pa.concat_arrays(self.vocabulary).dictionary_encode()
        same = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term = same[np.concatenate([p[0] for p in self.pairs])]
        doc = np.concatenate([p[1] for p in self.pairs])
        tf = np.concatenate([p[2] for p in self.pairs])
        order = np.argsort(term * self.size + doc, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        runs = np.flatnonzero(np.diff(term, prepend=-1))
        within = np.arange(len(term)) - np.repeat(runs, np.diff(runs, append=len(term)))
        starts = np.flatnonzero(within % self.block == 0)
        sizes = np.diff(starts, append=len(term))
        gap = np.diff(doc, prepend=0)
        gap[starts] = 0
        most = np.maximum.reduceat(impacts(tf, norm[doc]), starts)
        packed, ends = pack_blocks(gap, tf, starts, sizes)
        n = len(starts)
        known = np.array([i is not None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], dtype="<i8")
        documents = pa.py_buffer(b"".join([ids.tobytes(), norm.astype("<i8").tobytes(), known.tobytes()]))
        postings = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])
        names = [c.split()[0] for c in INDEX.split(", ")]
        columns = [
            pa.array(np.full(n, shard)),
            encoded.dictionary.cast(pa.binary()).take(pa.array(term[starts])).cast(pa.string()),
            pa.array((within[starts] // self.block).astype(np.int32)),
            pa.array(doc[starts].astype(np.int32)),
            pa.array(doc[starts + sizes - 1].astype(np.int32)),
            pa.array(most),
            pa.array(sizes.astype(np.int32)),
            postings,
        ]
        head = [pa.array([v], c.type) for v, c in zip((shard, "", 0, 0, self.size - 1, 0, self.size, documents.to_pybytes()), columns)]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.concat_arrays([h, c]) for h, c in zip(head, columns)], names)


_WIDTHS = np.array([1, 2, 4])


def pack_blocks(gap: np.ndarray, tf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blocks, ends of the blocks): two widths, the gaps, the counts."""
    width = [_WIDTHS[np.searchsorted([255, 65535], np.maximum.reduceat(v, starts))] for v in (gap, tf)]
    ends = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(2 + sizes * (width[0] + width[1]), out=ends[1:])
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    out[ends[:-1]], out[ends[:-1] + 1] = width
    within = np.arange(len(gap)) - np.repeat(starts, sizes)
    at = ends[:-1] + 2
    for values, wide in zip((gap, tf), width):
        each = np.repeat(wide, sizes)
        to = np.repeat(at, sizes) + within * each
        for byte in range(4):
            there = each > byte
            out[to[there] + byte] = (values[there] >> (8 * byte)) & 255
        at = at + sizes * wide
    return out, ends


def unpack_block(data: bytes, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, counts) of a block."""
    wide, high = data[0], data[1]
    gap = np.frombuffer(data, dtype=f"<u{wide}", count=size, offset=2)
    return first + np.cumsum(gap, dtype=np.int64), np.frombuffer(data, dtype=f"<u{high}", count=size, offset=2 + size * wide).astype(np.int64)


@dataclass(frozen=True)
class LexicalIndex:
    """Blocks of postings (``INDEX``), and how many documents and terms they stand for."""

    blocks: DataFrame
    docs: int
    total: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> LexicalIndex:
    """The index of all ``docs``, as a table in the shared folder."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, total = corpus_size(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 24
        builder = ShardBuilder(n_docs, total, block)
        for batch in batches:
            for part in slices(batch, "text"):
                builder.add(part)
                if builder.bytes >= shard_bytes or builder.size >= shard_docs:
                    yield builder.rows(shard)
                    shard += 1
        if builder.size:
            yield builder.rows(shard)

    return LexicalIndex(cut_table(texts.mapInArrow(run, INDEX)), n_docs, total)


class Shard:
    """One shard's blocks of the terms of some queries."""

    def __init__(self, rows: pa.Table, window: int = WINDOW):
        head = rows.filter(pc.equal(rows.column("term"), ""))
        documents, n = head.column("postings")[0].as_py(), head.column("size")[0].as_py()
        self.n, self.window = n, window
        self.ids = np.frombuffer(documents, dtype="<i8", count=n)
        self.norm = np.frombuffer(documents, dtype="<i8", count=n, offset=8 * n)
        self.known = np.frombuffer(documents, dtype=bool, count=n, offset=16 * n)
        rows = rows.filter(pc.not_equal(rows.column("term"), ""))
        term = rows.column("term").combine_chunks().dictionary_encode()
        term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((rows.column("block").to_numpy(), term))
        rows = rows.take(pa.array(order))
        self.term = term[order]
        self.first, self.last, self.size = (rows.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "size"))
        self.most = rows.column("most").to_numpy()
        self.postings = rows.column("postings").to_pylist()
        self.queries: dict[int, tuple[list[int], list[int], int]] = {}
        for t, weight, items in zip(self.term.tolist(), rows.column("weight").to_pylist(), rows.column("items").to_pylist()):
            for item in items or ():
                terms, factors, _ = self.queries.setdefault(item["q"], ([], [], item["threshold"]))
                terms.append(t)
                factors.append(item["times"] * weight)
        # Block ranges and bounds of each term in each window.
        n_terms, windows = int(self.term.max(initial=-1)) + 1, -(-n // window)
        self.key_last, self.key_first = self.term * n + self.last, self.term * n + self.first
        edge = np.minimum(np.arange(windows + 1) * window, n)
        at = np.arange(n_terms)[:, None] * n + edge[None, :]
        self.begin, self.stop = np.searchsorted(self.key_last, at[:, :-1]), np.searchsorted(self.key_first, at[:, 1:])
        self.bound = np.zeros((n_terms, windows), dtype=np.int64)
        for w in range(windows):
            there = np.flatnonzero(self.stop[:, w] > self.begin[:, w])
            if len(there):
                flat = np.stack([self.begin[there, w], self.stop[there, w]], axis=1).ravel()
                self.bound[there, w] = np.maximum.reduceat(np.append(self.most, 0), flat)[::2]
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block, decompressed when first asked for."""
        got = self.unpacked.get(b)
        if got is None:
            docs, tf = unpack_block(self.postings[b], int(self.first[b]), int(self.size[b]))
            got = self.unpacked[b] = docs, impacts(tf, self.norm[docs])
        return got

    def gathered(self, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(b) for b in blocks]
        return (parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))

    def best(self, terms: list[int], factors: list[int], threshold: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best of a query with a score above 0 and of at least ``threshold``."""
        term, factor = np.array(terms), np.array(factors, dtype=np.int64)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for w, low in enumerate(range(0, self.n, self.window)):
            bounds = factor * self.bound[term, w]
            order = np.argsort(bounds, kind="stable")
            sums = np.cumsum(bounds[order])
            if not sums[-1] or sums[-1] < threshold:
                continue
            beyond = int(np.searchsorted(sums, threshold, side="left"))  # terms that cannot reach the threshold together
            high = min(low + self.window, self.n)
            score = np.zeros(high - low, dtype=np.int64)
            for i in order[beyond:].tolist():
                if bounds[i]:
                    found, impact = self.gathered(list(range(self.begin[term[i], w], self.stop[term[i], w])))
                    a, b = np.searchsorted(found, (low, high))
                    score[found[a:b] - low] += factor[i] * impact[a:b]
            rest = int(sums[beyond - 1]) if beyond else 0
            here = np.flatnonzero((score > 0) & (score + rest >= threshold))
            score, here = score[here], here + low
            for nth in range(beyond - 1, -1, -1):
                if not len(here):
                    break
                i = order[nth]
                t, left = int(term[i]), int(sums[nth - 1]) if nth else 0
                a, b = self.begin[t, w], self.stop[t, w]
                if a < b:
                    at = a + np.searchsorted(self.last[a:b], here)
                    inside = (at < b) & (self.first[np.minimum(at, b - 1)] <= here)
                    reach = np.where(inside, factor[i] * self.most[np.minimum(at, b - 1)], 0)
                    alive = score + reach + left >= threshold
                    here, score, at, inside = here[alive], score[alive], at[alive], inside[alive]
                    if inside.any():
                        found, impact = self.gathered(np.unique(at[inside]).tolist())
                        spot = np.minimum(np.searchsorted(found, here), len(found) - 1)
                        score = score + np.where(found[spot] == here, factor[i] * impact[spot], 0)
                alive = score + left >= threshold
                here, score = here[alive], score[alive]
            if len(here):
                docs, scores = np.concatenate([docs, here]), np.concatenate([scores, score])
                if len(docs) > k:
                    top = np.lexsort((self.ids[docs], ~self.known[docs], -scores))[:k]
                    docs, scores = docs[top], scores[top]
                if len(docs) >= k:
                    threshold = max(threshold, int(scores.min()))
        return docs, scores


def _search_shard(k: int, window: int):
    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, window)
        q, ids, scores = [], [], []
        for query, (terms, factors, threshold) in shard.queries.items():
            docs, score = shard.best(terms, factors, threshold, k)
            q += [query] * len(docs)
            ids += [i if known else None for i, known in zip(shard.ids[docs].tolist(), shard.known[docs].tolist())]
            scores += score.tolist()
        return pa.table([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["q", "doc_id", "score"])

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(TERM_PATTERN), 0)


def search(index: LexicalIndex, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, window: int = WINDOW, query_block: int = QUERY_BLOCK, first_round: int = FIRST_ROUND) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each query with a score above 0.

    Equal scores are ranked by ascending ``doc_id``, null ids last. Queries alike in id and text
    are one query; queries of one id and other texts are queries of their own. A null text, or
    one without terms that the documents hold, has no answer.
    """
    spark = queries.sparkSession
    spoken = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    asked = cut_table(spoken.select(F.monotonically_increasing_id().alias("q"), "item_id", query_terms(F.col("text")).alias("terms")))
    blocks = max(1, -(-asked.count() // query_block))
    spread = F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("query_block")
    times = asked.select("q", spread, F.explode("terms").alias("term")).groupBy("q", "query_block", "term").agg(F.count(F.lit(1)).alias("times"))
    times = cut_table(times)
    wanted = times.select("term").distinct()
    few = times.count() <= BROADCAST_TERMS

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    df = index.blocks.select("term", "size").join(small(wanted), "term").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = cut_table(times.join(df.select("term", weight.alias("weight")).where("weight > 0"), "term"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("query_block")
    heads = index.blocks.where("term = ''").select("*", every)

    def hits(chosen: Column, thresholds: DataFrame | None) -> DataFrame:
        held = weighted.withColumn("threshold", F.lit(0).cast("long")) if thresholds is None else weighted.join(thresholds, "q", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long")))
        terms = held.groupBy("query_block", "term", "weight").agg(F.collect_list(F.struct("q", "times", "threshold")).alias("items"))
        mine = index.blocks.where(chosen).join(small(terms), "term")
        # One block of each term and shard carries the queries.
        mine = mine.withColumn("items", F.when(F.col("block") == 0, F.col("items")))
        none = [F.lit(None).cast("long").alias("weight"), F.lit(None).cast(dict(terms.dtypes)["items"]).alias("items")]
        both = mine.select(*index.blocks.columns, "query_block", "weight", "items").unionByName(heads.where(chosen).select("*", *none))
        return both.groupBy("shard", "query_block").applyInArrow(_search_shard(k, window), HITS)

    first = F.pmod(F.xxhash64("shard"), F.lit(first_round)) == 0
    begun = cut_table(_ranked(hits(first, None), k).select("q", "doc_id", "score"))
    thresholds = begun.groupBy("q").agg(F.min("score").alias("threshold"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
    ranked = _ranked(hits(~first, thresholds).unionByName(begun), k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best of all ``docs`` (``doc_id, text``) for each of ``queries`` (``item_id, text``).

    Defined cases: a null or termless text is in no answer and counts for nothing; a null
    ``doc_id`` is an id that ranks last among equal scores; repeated rows are documents of their
    own; an empty table on either side gives no rows; other columns are ignored. Queries: see
    ``search``.
    """
    return search(build_index(docs), queries, k=k)
