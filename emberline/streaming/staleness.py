"""Stale heartbeats on a stream: a timer for each key, moved by heartbeats of any key and by ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.watchdog import CHECK_MS, STALE_MS
from .ordered import SPAN_MS, Machine, after_watermark, in_order

FIRED = "key string, last_ts long, fired_at long, age_ms long"


class _Silence(Machine):
    """The time of a key's last heartbeat; it goes with its alert, and the next heartbeat arms the key again."""

    def __init__(self, armed_ms: int, check_ms: int, stale_ms: int):
        self.armed_ms, self.check_ms, self.stale_ms = armed_ms, check_ms, stale_ms

    def fresh(self) -> None:
        return None

    def fires(self, last: int) -> int:
        return -(-(last + self.stale_ms - self.armed_ms) // self.check_ms) * self.check_ms + self.armed_ms

    def rows(self, key: str, state: int | None, rows: list[tuple]) -> tuple[int, list[tuple]]:
        out = []
        for (ts,) in rows:
            if state is not None and self.fires(state) < ts:
                out.append(self.alert(key, state))
            state = int(ts)
        return state, out

    def alert(self, key: str, last: int) -> tuple:
        return key, last, self.fires(last), self.fires(last) - last

    def due_ms(self, state: int | None) -> int | None:
        # A heartbeat of the very millisecond of the check still is in time.
        return None if state is None else self.fires(state) + 1

    def time(self, key: str, state: int, now_ms: int) -> tuple[None, list[tuple]]:
        return None, [self.alert(key, state)]


def stream_stale_heartbeats(heartbeats: DataFrame, ticks: DataFrame | None = None, late: str = "0 seconds", armed_ms: int = 0, check_ms: int = CHECK_MS, stale_ms: int = STALE_MS, span_ms: int = SPAN_MS) -> DataFrame:
    """``heartbeats`` (``key, ts_ms``) to the rows of ``stale_heartbeats``, once time has passed a check.

    Time is that of the newest heartbeat of any key or of the newest of ``ticks`` (a stream with
    ``ts_ms``, such as ``clock`` gives), less ``late``. With ticks every key fires when all have
    fallen silent. Heartbeats without key or time are none.
    """
    rows = heartbeats.select(F.col("key").cast("string"), F.col("ts_ms").cast("long"))
    if ticks is not None:
        rows = rows.unionByName(ticks.select(F.lit(None).cast("string").alias("key"), F.col("ts_ms").cast("long")))
    timed = rows.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    known = timed.where(after_watermark("key", "at"))
    return in_order(known, "key", ["ts_ms"], "ts_ms", _Silence(armed_ms, check_ms, stale_ms), FIRED, span_ms=span_ms)


def clock(spark, per_second: int = 1) -> DataFrame:
    """Ticks of the wall clock: they go on when no heartbeat comes."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(F.unix_millis("timestamp").alias("ts_ms"))
