"""Removal of repeated 100-byte strings by distributed prefix doubling on sampled positions.

The plain form of prefix doubling ranks every position by a short prefix, sorts the position
and rank pairs, and reranks at growing offsets until ranks are unique or as long as the
threshold. Doing that for every byte would shuffle many times the input, so positions are
sampled by content: of the ``gram``-byte strings in each ``length``-byte window those with the
smallest hash are anchors. Equal windows have equal anchors at equal places, so no repeat is
missed, and about one position in 35 is ranked.

1. Rank by the ``gram`` bytes at an anchor and by the context that takes in every window around
   it: sort (rank, context, document, position) over ranges, which also splits a rank that a
   third of all rows share. Anchors whose rank is unique end here.
2. Of a class of equal contexts all but the first member repeat, whichever window is taken.
3. The first members of different classes with the same rank are compared window by window,
   which reaches the threshold itself. Ranks with up to ``group_rows`` classes are compared
   in sorted streams; larger ones by an aggregation over all their windows.

Each text is shuffled once, by document, and that exchange serves both steps that need bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import first_of_runs, mix64, slices, utf8
from .runtime import cut_table, small_batches

KEY = ["doc_id", "part"]
_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64)
_SLICE = 1 << 20


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def gram_ranks(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit rank of the ``gram`` bytes at each position, by doubling."""
    rank, done = _BYTE[data], 1
    while done < gram:
        step = min(done, gram - done)
        rank = mix64(rank[: len(rank) - step] * np.uint64(0xD6E8FEB86659FD93) + rank[step:] + np.uint64(done))
        done += step
    return rank


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks) of the grams that are smallest in some window inside one text."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - gram + 1
    rank = gram_ranks(data, gram)
    least = _slide(rank, width, np.minimum)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least[text[: len(least)] != text[length - 1 :]] = 0
    # A gram is an anchor if the largest of the minima of the windows around it is its own rank.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((_slide(padded, width, np.maximum) == rank) & (rank > 0))
    return at, rank[at]


def _texts(part: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray]:
    data, offsets = utf8(part.column("text"))
    return data.tobytes(), data, offsets


def _anchor_rows(length: int, gram: int):
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                raw, data, offsets = _texts(part)
                at, rank = anchors(data, offsets, length, gram)
                row = np.searchsorted(offsets, at, side="right") - 1
                low, high = np.maximum(offsets[row], at - before), np.minimum(offsets[row + 1], at + length)
                contexts = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], p - a) for p, a, b in zip(at.tolist(), low.tolist(), high.tolist())), np.uint64, len(at))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank.view(np.int64)), pa.array(contexts.view(np.int64)), part.column("doc_id").take(take), part.column("part").take(take), pa.array((at - offsets[row]).astype(np.int64))],
                    ["rank", "class", *KEY, "pos"],
                )

    return run


#: Kinds of rows that ``_runs`` gives.
REPEATED, MIXED, CROWDED, EDGE = 0, 1, 2, 3
#: Rows of one rank that a task holds back to count its classes.
_HELD_ROWS = 100_000


def _runs(group_rows: int, held_rows: int = _HELD_ROWS):
    """What becomes of anchors, from rows sorted by rank, class, document and position.

    A row that does not begin a run of its class repeats; one that does is compared further if
    its rank has other classes (``CROWDED``: more than ``group_rows``), and needs nothing if not.
    The first and the last rank of a partition may go on next door, and a rank of very many rows
    is not held back: the beginnings of their runs are ``EDGE`` rows, with rank and class.
    """

    def emit(rows: pa.Table, edges: tuple[bool, bool], before: tuple[int, int] | None) -> pa.RecordBatch:
        ranks, classes = rows.column("rank").to_numpy(), rows.column("class").to_numpy()
        new_rank = first_of_runs(ranks)
        first = new_rank | first_of_runs(classes)
        if before is not None and before == (ranks[0], classes[0]):
            first[0] = False
        starts = np.flatnonzero(new_rank)
        group = np.cumsum(new_rank) - 1
        n_classes = np.add.reduceat(first.astype(np.int64), starts)
        edge = np.zeros(len(starts), dtype=bool)
        edge[0] |= edges[0] or before is not None and before[0] == ranks[0]
        edge[-1] |= edges[1]
        kind = np.where(edge[group], EDGE, np.where(n_classes[group] > group_rows, CROWDED, MIXED))
        kind[~first] = REPEATED
        keep = np.flatnonzero(~first | edge[group] | (n_classes[group] > 1))
        take, is_edge = pa.array(keep), kind[keep] == EDGE
        return pa.RecordBatch.from_arrays(
            [pa.array(kind[keep].astype(np.int8)), pa.array(ranks[keep], mask=~is_edge), pa.array(classes[keep], mask=~is_edge), *[rows.column(c).take(take).combine_chunks() for c in (*KEY, "pos")]],
            ["kind", "rank", "class", *KEY, "pos"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        before: tuple[int, int] | None = None
        last: tuple | None = None
        at_start = True
        columns = ["rank", "class", *KEY, "pos"]
        for batch in gathered(batches, 20_000):
            end = tuple(batch.column(c)[-1].as_py() for c in columns)
            batch, last = distinct_places(batch, columns, last), end
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_tables([held, batch]).combine_chunks()
            ranks = rows.column("rank").to_numpy()
            whole = int(np.searchsorted(ranks, ranks[-1], side="left"))
            held = rows.slice(whole)
            if whole:
                yield emit(rows.slice(0, whole), (at_start, False), before)
                at_start, before = False, None
            if at_start or before is not None or held.num_rows > held_rows:
                yield emit(held, (True, True), before)
                before = (held.column("rank")[-1].as_py(), held.column("class")[-1].as_py())
                held, at_start = None, False
        if held is not None and held.num_rows:
            yield emit(held, (True, True), before)

    return run


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least ``rows`` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def distinct_places(rows: pa.Table, columns: list[str], last: tuple | None = None) -> pa.Table:
    """Sorted rows without those that are the same in ``columns`` as the one before (at the start: as ``last``).

    Only rows of the input that are alike give such rows; neither is earlier than the other.
    """
    same = np.ones(rows.num_rows, dtype=bool)
    for i, c in enumerate(columns):
        column = rows.column(c)
        values, nulls = pc.fill_null(column, 0).to_numpy(), pc.is_null(column).to_numpy()
        same[1:] &= (values[1:] == values[:-1]) & (nulls[1:] == nulls[:-1])
        same[0] &= last is not None and (None if nulls[0] else values[0]) == last[i]
    return rows.filter(pa.array(~same)) if same.any() else rows


def _positions(lists: pa.Array, i: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    value = lists[i].values
    return np.unique(value.to_numpy()) if value is not None and len(value) else np.zeros(0, np.int64)


def _contexts(length: int, gram: int):
    """Rows for the listed anchors of each text: rank, place, bytes before it in the context, the context."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                raw, data, offsets = _texts(part)
                all_ranks = gram_ranks(data, gram) if len(data) >= gram else np.zeros(0, np.uint64)
                rows, at, left, contexts = [], [], [], []
                for i in range(part.num_rows):
                    a, e = int(offsets[i]), int(offsets[i + 1])
                    own = _positions(part.column("listed"), i)
                    own = own[own + gram <= e - a]
                    rows.append(np.full(len(own), i))
                    at.append(own)
                    for p in (a + own).tolist():
                        lo, hi = max(a, p - before), min(e, p + length)
                        contexts.append(raw[lo:hi])
                        left.append(p - lo)
                if not left:
                    continue
                row, pos = np.concatenate(rows), np.concatenate(at)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(all_ranks[offsets[row] + pos].view(np.int64)), part.column("doc_id").take(take), part.column("part").take(take), pa.array(pos), pa.array(left, pa.int32()), pa.array(contexts, pa.binary())],
                    ["rank", *KEY, "pos", "left", "context"],
                )

    return run


def repeated_windows(group: np.ndarray, left: np.ndarray, contexts: list[bytes], length: int, gram: int) -> list[tuple[int, int, int]]:
    """(row, smallest, largest offset) for the windows of rows, in order, that an earlier row of the group has."""
    before, wide = length - gram, 2 * length - gram
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    begins = np.cumsum(sizes) - sizes
    matrix = np.zeros((len(contexts), wide), dtype=np.uint8)
    row = np.repeat(np.arange(len(contexts)), sizes)
    matrix[row, np.arange(len(flat)) - begins[row] + (before - left)[row]] = flat
    # A window's hash is a sum over its columns, so the next offset takes one column in and one out.
    table = np.random.default_rng(21).integers(0, 2**63, (wide, 256), dtype=np.uint64)
    sums = np.zeros(len(contexts), dtype=np.uint64)
    for column in range(before, wide):
        sums += table[column][matrix[:, column]]
    salt = mix64(group.astype(np.uint64))
    found: list[tuple[int, int, int]] = []
    hit = np.zeros((len(contexts), before + 1), dtype=bool)
    for d in range(before + 1):
        if d:
            sums += table[before - d][matrix[:, before - d]] - table[wide - d][matrix[:, wide - d]]
        valid = np.flatnonzero((left >= d) & (sizes - left >= length - d))
        if len(valid) < 2:
            continue
        key = mix64(sums[valid]) ^ salt[valid]
        order = np.argsort(key, kind="stable")
        hit[valid[order[~first_of_runs(key[order])]], d] = True
    for r in np.flatnonzero(hit.any(axis=1)).tolist():
        ds = np.flatnonzero(hit[r])
        breaks = np.flatnonzero(np.diff(ds) > 1)
        for lo, hi in zip(np.concatenate([ds[:1], ds[breaks + 1]]).tolist(), np.concatenate([ds[breaks], ds[-1:]]).tolist()):
            found.append((r, lo, hi))
    return found


def _compare_groups(length: int, gram: int, chunk: int = 20_000):
    """Window intervals that repeat, from rows sorted by rank, document and position."""

    def resolve(rows: pa.Table) -> list[pa.RecordBatch]:
        rows = distinct_places(rows, ["rank", *KEY, "pos"])
        found = repeated_windows(rows.column("rank").to_numpy(), rows.column("left").to_numpy().astype(np.int64), rows.column("context").to_pylist(), length, gram)
        take = pa.array([f[0] for f in found], pa.int64())
        pos = rows.column("pos").take(take).to_numpy()
        lo, hi = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)
        return pa.Table.from_arrays([rows.column("doc_id").take(take), rows.column("part").take(take), pa.array(pos - hi), pa.array(pos - lo)], names=[*KEY, "first_start", "last_start"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                whole = pa.Table.from_batches(held)
                ranks = whole.column("rank").to_numpy()
                cut_at = int(np.searchsorted(ranks, ranks[-1], side="left"))
                if cut_at:
                    yield from resolve(whole.slice(0, cut_at))
                    held = whole.slice(cut_at).to_batches()
                    rows = whole.num_rows - cut_at
        if rows:
            yield from resolve(pa.Table.from_batches(held))

    return run


def removed_runs(n: int, starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows starting in the given intervals cover, in a text of ``n`` bytes."""
    runs: list[list[int]] = []
    for a, b in sorted(starts):
        b = min(b, n - length)
        a = max(a, 0)
        if a > b:
            continue
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b + length)
        else:
            runs.append([a, b + length])
    return [(a, b) for a, b in runs]


def _remove(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                raw, _, offsets = _texts(part)
                spans = part.column("spans").to_pylist()
                out = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    text = raw[offsets[i] : offsets[i + 1]]
                    runs = removed_runs(len(text), [(s["first_start"], s["last_start"]) for s in spans[i] or ()], length)
                    kept = text
                    if runs:
                        edges = [0, *[x for r in runs for x in r], len(text)]
                        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                cols = list(zip(*out))
                arrays = [*[pa.array(cols[k], pa.int64()) for k in range(4)], pa.array(cols[4], pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[5], pa.binary())] if with_text else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if with_text else [])])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, part, text``: rows that repeat an id are told apart by a digest of their texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.pmod(F.crc32(text), F.lit(1 << 16)).cast("int").alias("part"), text.alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32, group_rows: int = 50_000, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_bytes``).

    A byte goes if a ``length``-byte string covers it that also starts earlier in the table: in a
    document with a smaller id, or earlier in the same document. Defined cases: a null or empty
    text has no bytes; a null id is smaller than any other; rows that repeat an id are ordered
    by a digest of their texts, and of rows alike in both none is earlier; an empty table gives
    no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    key_types = "doc_id long, part int"
    order = ["rank", "class", *KEY, "pos"]
    ranked = base.mapInArrow(_anchor_rows(length, gram), f"rank long, class long, {key_types}, pos long")
    kinds = f"kind byte, rank long, class long, {key_types}, pos long"
    runs = cut_table(ranked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs(group_rows), kinds))
    place = F.struct(*KEY, "pos")
    # A class begins once in every partition over which it was split: the list has at most so many rows.
    edges = runs.where(F.col("kind") == EDGE).groupBy("rank", "class").agg(F.min(place).alias("winner"), F.collect_list(place).alias("starts"))
    beaten = edges.where(F.size("starts") > 1).select(F.explode(F.filter("starts", lambda x: ~x.eqNullSafe(F.col("winner")))).alias("p")).select("p.*")
    repeated = runs.where(F.col("kind") == REPEATED).select(*KEY, "pos").unionByName(beaten)
    whole_windows = repeated.select(*KEY, (F.col("pos") - (length - gram)).alias("first_start"), F.col("pos").alias("last_start"))

    winners = edges.select("rank", "winner.*")
    several = cut_table(winners.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    split = winners.join(several, "rank")
    context_types = f"rank long, {key_types}, pos long, left int, context binary"

    def compared(kind: int, more: DataFrame) -> DataFrame:
        """Contexts of the anchors that are to be compared."""
        rows = runs.where(F.col("kind") == kind).select(*KEY, "pos").unionByName(more.select(*KEY, "pos"))
        return _with(base, rows.groupBy(*KEY).agg(F.collect_list("pos").alias("listed")), "inner").mapInArrow(_contexts(length, gram), context_types)

    few = compared(MIXED, split.where(F.col("n") <= group_rows))
    spans = whole_windows.unionByName(few.repartition("rank").sortWithinPartitions("rank", *KEY, "pos").mapInArrow(_compare_groups(length, gram), f"{key_types}, first_start long, last_start long"))
    if not several.where(F.col("n") > group_rows).isEmpty() or not runs.where(F.col("kind") == CROWDED).isEmpty():
        spans = spans.unionByName(_compare_by_window(compared(CROWDED, split.where(F.col("n") > group_rows)), length, gram))
    by_doc = spans.groupBy(*KEY).agg(F.collect_list(F.struct("first_start", "last_start")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_text else "")
    return _with(base, by_doc, "left").mapInArrow(_remove(length, with_text), schema)


def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined by key, where a null id equals a null id."""
    right = right.withColumnsRenamed({k: f"r_{k}" for k in KEY})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("part") == F.col("r_part")), how).drop(*[f"r_{k}" for k in KEY])


def _compare_by_window(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The same comparison as an aggregation over every window, for ranks with very many classes."""
    before = length - gram
    d = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(length) - (F.length("context") - F.col("left"))), F.least(F.col("left"), F.lit(before)))).alias("d")
    valid = rows.where(F.length("context") >= length)
    windows = valid.select("rank", *KEY, "pos", "left", "context", d).select("rank", *KEY, "pos", "d", F.md5(F.substring("context", F.col("left") - F.col("d") + 1, F.lit(length))).alias("window"))
    first = windows.groupBy("rank", "d", "window").agg(F.min(F.struct(*KEY, "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    start = F.col("pos") - F.col("d")
    return windows.join(first, ["rank", "d", "window"]).where(~F.struct(*KEY, "pos").eqNullSafe(F.col("first"))).select(*KEY, start.alias("first_start"), start.alias("last_start"))
