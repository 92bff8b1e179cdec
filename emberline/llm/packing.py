"""Packing documents into fixed-length sequences by bounded-space online best-fit.

Texts become token ids by a given tokenizer; a document's ids end with one separator id. Only
documents longer than a sequence are cut. A task keeps a fixed number of open bins. A bitset has
one bit for each amount of free space that some open bin has, so the best fit (the least space
that suffices) is one shift and one lowest-set-bit; when no bin may be opened any more, the
fullest one closes first. Rows stream through and memory does not grow with the data. Within one
slice of a batch the longer pieces go first.

The pieces in bins that tasks leave open with some space are packed once more, the longest first,
in as few tasks as ``REPACKED_PIECES`` allows: many tasks cost hardly more sequences than one.
That pass has a row for each such piece and no texts.

Chunks of text are tokenized once each: the tokenizer drops white space, lower-cases, and never
joins a letter with punctuation, so a text's ids are those of its chunks between white space and
between letters and plain punctuation. A bounded cache maps chunks to ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import Words, slices, utf8
from .runtime import cut_table, kept_in_worker, small_batches

#: Pieces that one task of the second pass packs.
REPACKED_PIECES = 200_000
#: The smallest number of a sequence of the second pass.
REPACKED = 1 << 62


class BinPacker:
    """Online best-fit over at most ``open_bins`` open bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.free_bits, self.n_open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of ``length``, 1 to ``capacity``."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, bin_id = self.capacity, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.free_bits |= 1 << left
            self.n_open += 1
        return bin_id, self.capacity - free

    def left_open(self) -> list[tuple[int, int]]:
        """The open bins with more than a 64th of their capacity free."""
        return [b for bins in self.by_free[self.capacity // 64 + 1 :] for b in bins]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id


class ChunkTokenizer:
    """Token ids of chunks: a flat array with a place for each of at most ``cached`` chunks."""

    #: Chunks that are joined, with a special token between them, for one call of the tokenizer.
    JOINED = 2000

    def __init__(self, path: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special]
        self.border = (special[-1][1].content, special[-1][0]) if special else None
        self.cached = cached
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.seen = np.zeros(1 << 15, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 15, dtype=np.int64)

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each chunk)."""
        if self.border is None or any(b"<|" in c for c in chunks):
            each = [e.ids for e in self.tokenizer.encode_batch([c.decode() for c in chunks], add_special_tokens=False)]
            return np.fromiter((i for e in each for i in e), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        text, border = self.border
        joined = [text.encode().join(chunks[i : i + self.JOINED]).decode() for i in range(0, len(chunks), self.JOINED)]
        ids = np.concatenate([np.array([*e.ids, border], dtype=np.uint32) for e in self.tokenizer.encode_batch(joined, add_special_tokens=False)])
        borders = np.flatnonzero(ids == border)
        return ids[ids != border], np.diff(borders, prepend=-1) - 1

    def places(self, chunks: list[bytes]) -> np.ndarray:
        """The place of each chunk; chunks that are new are tokenized first."""
        get = self.place.get
        out = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(out < 0)
        if len(new) and len(self.place) + len(new) > self.cached and self.place:
            self.forget()
            return self.places(chunks)
        if len(new):
            missing = [chunks[i] for i in new.tolist()]
            ids, counts = self.encode(missing)
            known, used = len(self.place), int(self.ends[len(self.place) - 1]) if self.place else 0
            while used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while known + len(new) > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
                self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
            self.ids[used : used + len(ids)] = ids
            self.ends[known : known + len(new)] = used + np.cumsum(counts)
            out[new] = np.arange(known, known + len(new))
            self.place.update(zip(missing, range(known, known + len(new))))
        self.seen[out] += 1
        return out

    def forget(self) -> None:
        """Keeps the chunks that were asked for again; all go if that leaves more than half of the room taken."""
        kept = [(c, p) for c, p in self.place.items() if self.seen[p] > 1]
        if 2 * len(kept) > self.cached:
            self.clear()
            return
        old = np.array([p for _, p in kept], dtype=np.int64)
        first, last = np.where(old > 0, self.ends[old - 1], 0), self.ends[old]
        ids = [self.ids[a:b].copy() for a, b in zip(first.tolist(), last.tolist())]
        self.clear()
        if not kept:
            return
        flat = np.concatenate(ids)
        self.ids = np.concatenate([flat, np.zeros(1 << 16, dtype=np.uint32)])
        self.ends = np.concatenate([np.cumsum(last - first), np.zeros(1 << 15, dtype=np.int64)])
        self.seen = np.zeros(len(self.ends), dtype=np.int32)
        self.place = {c: i for i, (c, _) in enumerate(kept)}


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Punctuation that no contraction and no special token contains.
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b'.,!?#*$%&:;()"-_+=/@~^[]{}')] = True


def chunk_breaks(data: np.ndarray) -> np.ndarray:
    """Where a chunk may end inside a word: between a letter of ASCII or Latin-1 and plain punctuation."""
    letter, mark = _LETTER[data], _MARK[data]
    ends_letter = letter.copy()
    # The second byte of a letter from U+00C0 to U+00FF; U+00D7 and U+00F7 are signs.
    ends_letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    starts_letter = letter
    starts_letter[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return np.flatnonzero((ends_letter[:-1] & mark[1:]) | (mark[:-1] & starts_letter[1:])) + 1


def token_ids(column: pa.Array, tokenizer: ChunkTokenizer, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, each with ``end_id`` at its end; offsets of the texts)."""
    data, offsets = utf8(column)
    plain = b"<|" not in data.tobytes()
    words = Words(data, offsets, lower=plain, breaks=chunk_breaks(data) if plain and len(data) else None)
    places = tokenizer.places(words.distinct) if len(words) else np.zeros(0, np.int64)
    last = tokenizer.ends[places]
    first = np.where(places > 0, tokenizer.ends[places - 1], 0)
    word_ids = words.ids if len(words) else np.zeros(0, np.int64)
    counts = (last - first)[word_ids]
    # One more id at the end of each text: words of text i move i places on.
    text_of = words.texts
    ends = np.cumsum(counts) + text_of
    out = np.full(int(counts.sum()) + len(words.bounds) - 1, end_id, dtype=np.uint32)
    step = np.repeat(ends - counts, counts) - (np.cumsum(counts) - counts).repeat(counts)
    within = np.arange(int(counts.sum()))
    out[within + step] = tokenizer.ids[within - (np.cumsum(counts) - counts).repeat(counts) + np.repeat(first[word_ids], counts)]
    total = np.concatenate([[0], np.cumsum(counts)])
    return out, total[words.bounds] + np.arange(len(words.bounds))


def _repack(length: int, open_bins: int):
    """Pieces, the longest first, with new places; a sequence has the smallest stretch of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = BinPacker(length, open_bins, REPACKED + ((context.partitionId() if context else 0) << 36))
        for batch in batches:
            places = [packer.place(n) for n in batch.column("length").to_pylist()]
            for name, values in (("sequence_id", [p[0] for p in places]), ("offset", [p[1] for p in places])):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, pa.int64()))
            yield batch

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 0,
    open_bins: int = 1024,
    cached_chunks: int = 300_000,
    with_ids: bool = False,
    stretch: Column | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Pieces of a sequence follow each other without gaps from offset 0. ``sequence_id`` is unique
    over the whole result. ``stretch``, an integer expression, numbers stretches of an order that
    is to be kept: they are packed apart, as far as their bins get full, and each piece has the
    smallest ``stretch`` of its sequence. Defined cases: a null or empty text is the end id
    alone; a null id stays null; repeated rows are packed each on its own; a null stretch counts
    as -1; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = BinPacker(length, open_bins, (context.partitionId() if context else 0) << 36)
        tokenizer = kept_in_worker((tokenizer_path, cached_chunks), lambda: ChunkTokenizer(tokenizer_path, cached_chunks))
        at = None

        def left(packer: BinPacker) -> pa.RecordBatch:
            rows = packer.left_open()
            none = pa.nulls(len(rows), pa.int64())
            arrays = [none, none.cast(pa.int32()), none, none, none, pa.array(rows, pa.int64()), none, none, pa.array([True] * len(rows), pa.bool_())]
            if with_ids:
                arrays.append(pa.nulls(len(rows), pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, ends = token_ids(part.column("text"), tokenizer, end_id)
                whole = []
                for doc, where, begin, end in zip(part.column("doc_id").to_pylist(), part.column("stretch").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    for piece, start in enumerate(range(begin, end, length)):
                        stop = min(start + length, end)
                        whole.append((where, stop - start, doc, piece, start - begin, zlib.crc32(ids[start:stop].astype("<u4").tobytes()), start))
                for where, rows in groupby(whole, key=lambda r: r[0]):
                    if at is not None and where != at:
                        yield left(packer)
                        packer = BinPacker(length, open_bins, packer.next_id)
                    at = where
                    rows = sorted(rows, key=lambda r: -r[1])
                    places = [packer.place(r[1]) for r in rows]
                    cols = list(zip(*rows))
                    arrays = [
                        pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.int32()),
                        pa.array(cols[4], pa.int64()),
                        pa.array(cols[1], pa.int64()),
                        pa.array(cols[5], pa.int64()),
                        pa.array([p[0] for p in places], pa.int64()),
                        pa.array([p[1] for p in places], pa.int64()),
                        pa.array([at] * len(rows), pa.int64()),
                        pa.array([False] * len(rows), pa.bool_()),
                    ]
                    if with_ids:
                        arrays.append(pa.array([ids[s : s + n].astype(np.int32) for n, s in zip(cols[1], cols[6])], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(arrays, names)
        if at is not None:
            yield left(packer)

    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, stretch long, open boolean" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    order = F.lit(-1) if stretch is None else F.coalesce(stretch, F.lit(-1))
    rows = cut_table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), order.cast("long").alias("stretch")).mapInArrow(run, schema))
    bins, pieces = rows.where("open").select("sequence_id"), rows.where("NOT open").drop("open")
    loose = cut_table(pieces.join(bins, "sequence_id", "left_semi"))
    tasks = max(1, -(-loose.count() // REPACKED_PIECES))
    sorted_pieces = loose.repartition(tasks, F.xxhash64("sequence_id", "offset")).sortWithinPartitions(F.desc("length"), "stretch", "doc_id", "piece", "ids_crc32")
    packed = sorted_pieces.mapInArrow(_repack(length, open_bins), loose.schema)
    if stretch is not None:
        packed = packed.withColumn("stretch", F.min("stretch").over(Window.partitionBy("sequence_id")))
    out = pieces.join(bins, "sequence_id", "left_anti").unionByName(packed)
    return out.select(*[n for n in names if n != "open" and (n != "stretch" or stretch is not None)])
