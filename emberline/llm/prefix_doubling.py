"""Removal of repeated strings by plain distributed prefix doubling, every byte position a row.

1. Positions are ranked by their first ``start`` bytes.
2. Spark sorts (rank, rank at the offset, position) and reranks: a position's next rank, of twice
   the length, is the first position of its class. Positions alone in their class are done, and
   whatever has such a one at the offset is alone too. The offset doubles until the next one
   would pass ``length``; the last pair overlaps so that it covers ``length`` bytes exactly.
3. In classes of ``length`` bytes all but the first position start a repeat.

It gives the rows of ``suffix_dedup.remove_repeats`` and moves a row for every byte, so it is for
small tables and for checking the other, which ranks sampled positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import slices, utf8
from .runtime import cut_table, small_batches
from .suffix_dedup import KEY, _remove, _with, gram_ranks, keyed


def _positions(start: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = utf8(part.column("text"))
                if len(data) < start:
                    continue
                rank = gram_ranks(data, start)
                text = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                at = np.flatnonzero(text[: len(rank)] == text[start - 1 :])
                take = pa.array(text[at])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("part").take(take), pa.array(at - offsets[text[at]], pa.int64()), pa.array(rank[at].view(np.int64))], [*KEY, "pos", "rank"])

    return run


def _reranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Positions that share their rank, with the first of them as the new one."""
    whole = Window.partitionBy(*by)
    first, n = F.min(F.struct(*KEY, "pos")).over(whole), F.count(F.lit(1)).over(whole)
    return pairs.withColumns({"first": first, "n": n}).where("n > 1").select(*KEY, "pos", "first", F.xxhash64("first").alias("rank"))


def remove_repeats_by_doubling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, start: int = 16, with_text: bool = False) -> DataFrame:
    """The rows of ``remove_repeats``; the same cases are defined."""
    small_batches(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    ranked = base.mapInArrow(_positions(start), "doc_id long, part int, pos long, rank long").distinct()
    live, done = cut_table(_reranked(ranked, ["rank"])), start
    while done < length:
        step = min(done, length - done)
        there = live.select(F.col("doc_id").alias("t_doc"), F.col("part").alias("t_part"), (F.col("pos") - step).alias("t_pos"), F.col("rank").alias("next"))
        same = F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("part") == F.col("t_part")) & (F.col("pos") == F.col("t_pos"))
        live, done = cut_table(_reranked(live.join(there, same).select(*KEY, "pos", "rank", "next"), ["rank", "next"])), done + step
    starts = live.where(~F.struct(*KEY, "pos").eqNullSafe(F.col("first"))).select(*KEY, F.col("pos").alias("first_start"), F.col("pos").alias("last_start"))
    by_doc = starts.groupBy(*KEY).agg(F.collect_list(F.struct("first_start", "last_start")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_text else "")
    return _with(base, by_doc, "left").mapInArrow(_remove(length, with_text), schema)
