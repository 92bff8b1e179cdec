"""Ids 0, 1, 2 … for the rows of a stream, without gap or repeat across micro-batches and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.views import response_ids
from .ledger import Ledger

#: Batches of which the range is known; a stream replays only its last one.
BATCHES_KEPT = 100


def number_batch(batch: DataFrame, batch_id: int, order: list[str], path: str, ledger: Ledger) -> None:
    """Writes ``batch`` with its ``id`` to a folder of its own.

    The first id of a batch is where the batch before ended; it is known before the batch is
    written, and the folder is written anew when the batch is replayed, so ids are the same then.
    """
    before = ledger.before(batch_id)
    first = before[1] if before else 0
    numbered = response_ids(batch, order).withColumn("id", F.col("id") + F.lit(first).cast("long"))
    target = f"{path}/batch={batch_id}"
    numbered.write.mode("overwrite").parquet(target)
    ledger.put(batch_id, first + batch.sparkSession.read.schema(numbered.schema).parquet(target).count())


def stream_response_ids(responses: DataFrame, order: list[str], path: str, state: str) -> StreamingQuery:
    """Rows of ``responses``, in the order of micro-batches and of ``order`` inside them, with ``id`` below ``path``."""
    ledger = Ledger(responses.sparkSession, f"{state}/ids", BATCHES_KEPT)
    writer = responses.writeStream.foreachBatch(lambda batch, n: number_batch(batch, n, order, path, ledger))
    return writer.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
