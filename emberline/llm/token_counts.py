"""Token counts of whole texts: batch encoding in Arrow functions that give back lengths only.

Batches are cut into slices of about equal bytes, and texts are split where the tokenizer never
joins what stands on both sides, so neither a call of the tokenizer nor its answer grows with the
longest text. Which places are safe depends on the tokenizer and is probed once in each worker:

* it drops white space and keeps words apart: texts are cut into chunks at all white space, and
  between letters and plain punctuation where it never joins these; each distinct chunk is
  encoded once and its length kept in a bounded cache;
* byte-level pieces that begin with their space: long texts are cut before a space after a letter
  or digit;
* sentencepiece: long texts are cut at a single space between letters or digits, which the
  prefix of the next piece stands for.

Tokens that hold white space, or take it from their neighbours, forbid cutting: such a tokenizer
gets whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, slices, utf8
from .packing import _MARK, ChunkTokenizer, chunk_breaks
from .runtime import kept_in_worker, small_batches

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Longer texts are cut for tokenizers that get running text.
PIECE_CHARS = 1 << 14
#: Text in one call of the tokenizer, in characters.
BATCH_CHARS = 1 << 19

_BEFORE_SPACE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
_SINGLE_SPACE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def pieces(text: str, boundary: re.Pattern, size: int) -> Iterator[str]:
    """``text`` cut at the first boundary after every ``size`` characters; what a boundary matches is left out."""
    start = 0
    while len(text) - start > size:
        cut = boundary.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


class RunningCounter:
    """Lengths of running text: pieces of all texts of a slice, in calls of about equal size."""

    def __init__(self, lengths: Callable[[list[str]], list[int]], boundary: re.Pattern | None, piece: int = PIECE_CHARS, batch: int = BATCH_CHARS):
        self.lengths, self.boundary, self.piece, self.batch = lengths, boundary, piece, batch

    def count(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), dtype=np.int64)
        owner: list[int] = []
        waiting: list[str] = []
        chars = 0

        def flush() -> None:
            if waiting:
                np.add.at(out, owner, self.lengths(waiting))
                owner.clear()
                waiting.clear()

        for i, text in enumerate(column.to_pylist()):
            if not text:
                continue
            for part in pieces(text, self.boundary, self.piece) if self.boundary else (text,):
                if chars + len(part) > self.batch:
                    flush()
                    chars = 0
                owner.append(i)
                waiting.append(part)
                chars += len(part)
        flush()
        return out


class ChunkCounter:
    """Lengths of texts as sums over their chunks; a chunk is encoded when it is not in the cache."""

    def __init__(self, tokenizer: ChunkTokenizer, cached: int, lower: bool, breaks: bool):
        self.tokenizer, self.cached, self.lower, self.breaks = tokenizer, cached, lower, breaks
        self.known: dict[bytes, int] = {}

    def chunk_lengths(self, chunks: list[bytes]) -> np.ndarray:
        get = self.known.get
        out = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(out < 0)
        if len(new):
            missing = [chunks[i] for i in new.tolist()]
            out[new] = self.tokenizer.encode(missing)[1]
            if len(self.known) + len(missing) > self.cached:
                self.known.clear()
            self.known.update(zip(missing[: self.cached], out[new].tolist()))
        return out

    def count(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        plain = b"<|" not in data.tobytes()  # special tokens are told by their case and may hold letters beside marks
        words = Words(data, offsets, lower=plain and self.lower, breaks=chunk_breaks(data) if plain and self.breaks and len(data) else None)
        if not len(words):
            return np.zeros(len(column), dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(self.chunk_lengths(words.distinct)[words.ids])])
        return np.diff(total[words.bounds])


def counter_of(path: str, cached: int = 300_000, piece: int = PIECE_CHARS) -> RunningCounter | ChunkCounter:
    """The counter that fits the vocabulary file: ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = model.encode(["a", "b", "a b", "z9", "z9 a"], num_threads=1)
        apart = ids[0] + ids[1] == ids[2] and ids[3] + ids[0] == ids[4]
        return RunningCounter(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], _SINGLE_SPACE if apart else None, piece)
    chunks = ChunkTokenizer(path, cached)
    tokenizer = chunks.tokenizer
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def ids_of(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    added = tokenizer.get_added_tokens_decoder().values()
    bound = any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in added)
    if not bound and not ids_of(" \t\n\v\f\r") and ids_of("a b\tz9\nb") == [i for t in ("a", "b", "z9", "b") for i in ids_of(t)]:
        marks = [chr(i) for i in np.flatnonzero(_MARK)]
        breaks = all(ids_of(f"é{m}a") == ids_of("é") + ids_of(m) + ids_of("a") for m in marks)
        lower = all(ids_of(chr(i)) == ids_of(chr(i + 32)) for i in range(65, 91)) and ids_of("AbC") == ids_of("abc")
        return ChunkCounter(chunks, cached, lower, breaks)
    with open(path, encoding="utf-8") as file:
        scheme = json.load(file).get("pre_tokenizer") or {}
    spaced = not bound and scheme.get("type") == "ByteLevel" and scheme.get("use_regex") and not scheme.get("add_prefix_space")
    return RunningCounter(lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], _BEFORE_SPACE if spaced else None, piece)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, cached_chunks: int = 300_000) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    Counts are those of the tokenizer's library over the whole text, without begin, end or added
    special tokens, truncation or padding. Defined cases: a null or empty text has no bytes and
    no tokens; a null id stays null; repeated rows are counted each on its own; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(("lengths", tokenizer_path, cached_chunks), lambda: counter_of(tokenizer_path, cached_chunks))
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                tokens = pa.array(counter.count(text), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, COUNTS)
