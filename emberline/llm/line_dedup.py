"""Removal of lines that many documents share.

1. Every document is exploded into the distinct 128-bit hashes of its normalised lines.
2. A partially aggregated count finds the hashes that enough documents hold, and the largest id
   that holds each.
3. Those hashes meet the exploded lines again; a document gets the list of its own lines that
   go (never longer than the document), the text is split once more and the rest reassembled.

A hot line costs one row per task in step 2. In step 3 both sides are tables, so Spark may
broadcast the counts when they are small or split the hot partition when not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import cut_table, small_batches

SPACES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends and with A-Z in lower case."""
    return line.strip(SPACES).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, his, los = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                for key in {k for k in map(line_key, text.split(b"\n")) if _long_enough(k, least)}:
                    h = xxhash.xxh3_128_digest(key)
                    ids.append(doc)
                    his.append(int.from_bytes(h[:8], "little", signed=True))
                    los.append(int.from_bytes(h[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64())], ["doc_id", "hi", "lo"])

    return run


def _reassemble(least: int, with_text: bool, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, gone in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if gone:
                    drop = {(x["hi"], x["lo"]) for x in gone}
                    kept = []
                    for line in lines:
                        key = line_key(line)
                        if _long_enough(key, least):
                            h = xxhash.xxh3_128_digest(key)
                            if (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)) in drop:
                                continue
                        kept.append(line)
                left = b"\n".join(kept)
                out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            cols = list(zip(*out)) if out else [[]] * 5
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(cols[4], pa.string())], [*names, "kept_text"]
            if carry:
                arrays, names = [*arrays, batch.column(3)], [*names, "carried"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_sha256`` and, if asked, ``kept_text``
    and a struct ``carried`` of the columns named in ``carry``.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least
    ``least`` code points that at least ``documents`` documents hold lose all their lines, except
    those in the largest id that holds the key. Defined cases: a null or empty text is one empty
    line; an id names one document, so rows that repeat an id are counted by row and all of those
    with the largest id keep the line; a null id never holds the kept copy; an empty table gives
    no rows; other columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)
    extra = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    # Tables: lines are hashed once, and the join below has plain exchanges, so Spark can split a hot line.
    lines = cut_table(base.select("doc_id", "text").mapInArrow(_hashes(least), "doc_id long, hi long, lo long"))
    common = lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= documents).select("hi", "lo", "holder")
    common = cut_table(common)
    gone = (
        lines.join(common, ["hi", "lo"])
        .where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))
        .withColumnRenamed("doc_id", "gone_id")
    )
    schema = StructType().add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")
    if carry:
        schema = schema.add("carried", base.schema["carried"].dataType)
    whole = base.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    return whole.select("doc_id", "text", "gone", *(["carried"] if carry else [])).mapInArrow(_reassemble(least, with_text, bool(carry)), schema)
