"""Heartbeat supervision on a stream, with the latch of each key as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import SPAN_MS, Machine, after_watermark, in_order

ALERTS = "key string, ts_ms long, severity int, kind int, reason string"


class _Latch(Machine):
    """The most programs ever seen, and whether a drop has been told; both stay for good."""

    def fresh(self) -> tuple[int, bool]:
        return 0, False

    def rows(self, key: str, state: tuple[int, bool], rows: list[tuple]) -> tuple[tuple[int, bool], list[tuple]]:
        (most, latched), out = state, []
        for ts, _, n in rows:
            if n is None or n != n:
                latched = False
                continue
            n = int(n)
            most = max(most, n)
            if most and n >= most:
                latched = False
            elif most and not latched:
                latched = True
                out.append((key, int(ts), 5, 2, "bpf-progs-zero-while-alive") if n == 0 else (key, int(ts), 3, 1, f"bpf-progs-dropped-{n}-of-{most}"))
        return (most, latched), out


def stream_lost_programs(heartbeats: DataFrame, arrival: str, late: str = "0 seconds", span_ms: int = SPAN_MS) -> DataFrame:
    """``heartbeats`` (``key, ts_ms, n_progs``) to records of drops: one until programs are back at their most.

    Heartbeats count in the order of time and ``arrival``, however they are dealt over batches, as
    long as none is more than ``late`` behind the newest. Those without key or time are none; one
    without a number ends a drop, as in batch.
    """
    rows = heartbeats.select(F.col("key").cast("string"), F.col("ts_ms").cast("long"), F.col(arrival).alias("arrival"), "n_progs")
    timed = rows.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return in_order(timed.where(after_watermark("key", "at")), "key", ["ts_ms", "arrival", "n_progs"], "ts_ms", _Latch(), ALERTS, span_ms=span_ms)
