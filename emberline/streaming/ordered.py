"""Keyed state that sees the rows of a stream in event-time order.

Rows wait in map state, by short spans of event time, until the watermark has passed their span;
an event-time timer then hands them over in order. A row that comes late, but before the
watermark, is therefore in its right place whatever batch and file it came in, and the result is
that of the same rows in batch. Spark leaves out rows behind the watermark. What a key keeps goes
by a timer, too, once its machine says that it is over, whether or not the key is heard of again.

Keys are dealt over groups by a digest, and Spark's state, timers and calls are those of groups: a
call costs as much as some hundred rows, so keys and spans must not multiply it.
"""

from __future__ import annotations

import contextlib
import io
import itertools
import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time that waits and is handed over together: a longer span has fewer timers and is handed over that much later.
SPAN_MS = 1000
#: Groups that keys are dealt over. State that is kept belongs to its group: the number is for good once a stream has begun.
GROUPS = 256


class Machine(ABC):
    """What happens to the rows of one key, in order. Instances carry settings, not state."""

    @abstractmethod
    def fresh(self) -> Any:
        """The state before the first row; it is pickled."""

    @abstractmethod
    def rows(self, key: Any, state: Any, rows: list[tuple]) -> tuple[Any, list[tuple]]:
        """(state after ``rows``, output rows)."""

    def due_ms(self, state: Any) -> int | None:
        """When ``time`` is to be called if nothing comes, or None."""
        return None

    def time(self, key: Any, state: Any, now_ms: int) -> tuple[Any | None, list[tuple]]:
        """(state, or None if it can go; output rows) when all rows before ``now_ms``, which is due, have been seen."""
        return state, []


class _InOrder(StatefulProcessor):
    """The machines of a group's keys. Rows are (span, key, what decides their place)."""

    def __init__(self, machine: Machine, key: str, columns: list[str], out: dict[str, str], span_ms: int):
        self.machine, self.columns, self.out, self.span_ms = machine, [key, *columns], out, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "rows binary")
        self.state = handle.getValueState("state", "due long, states binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        spans: dict[int, list[tuple]] = {}
        for frame in rows:
            spanned = frame["at_ms"] // self.span_ms
            for span, row in zip(spanned.tolist(), frame[self.columns].itertuples(index=False, name=None)):
                spans.setdefault(int(span), []).append(row)
        for span, own in spans.items():
            packed = pickle.dumps(own)
            if self.waiting.containsKey((span,)):
                packed = self.waiting.getValue((span,))[0] + packed
            else:
                self.handle.registerTimer((span + 1) * self.span_ms)
            self.waiting.updateValue((span,), (packed,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // self.span_ms * self.span_ms  # spans that end later still wait
        # The first timer of a batch hands over all spans that are over; those after it find theirs gone.
        span = expiredTimerInfo.getExpiryTimeInMs() // self.span_ms - 1
        kept = self.state.get() if self.state.exists() else None
        if not self.waiting.containsKey((span,)) and (kept is None or kept[0] is None or kept[0] > now):
            return iter(())
        states = pickle.loads(kept[1]) if kept else {}
        told = self._hand_over(states, now) + self._call(states, now)
        dues = [due for due in map(self.machine.due_ms, states.values()) if due is not None]
        due = min(dues, default=None)
        if states:
            self.state.update((due, pickle.dumps(states)))
        elif kept:
            self.state.clear()
        if due is not None:
            self.handle.registerTimer(-(-due // self.span_ms) * self.span_ms)
        return iter((self._frame(told),)) if told else iter(())

    def _hand_over(self, states: dict, now: int) -> list[tuple]:
        """The rows of all spans that are over, in order, to the machines of their keys."""
        rows: list[tuple] = []
        for span in sorted(span for (span,) in self.waiting.keys() if (span + 1) * self.span_ms <= now):
            rows += [(span, *row) for row in _unpacked(self.waiting.getValue((span,))[0])]
            self.waiting.removeKey((span,))
        out: list[tuple] = []
        rows.sort(key=lambda r: (r[1], r[0], _none_last(r[2:])))
        for key, own in itertools.groupby(rows, key=lambda r: r[1]):
            state = states[key] if key in states else self.machine.fresh()
            states[key], told = self.machine.rows(key, state, [r[2:] for r in own])
            out += told
        return out

    def _call(self, states: dict, now: int) -> list[tuple]:
        """What the machines that are due tell; states that can go are left out."""
        out: list[tuple] = []
        for key in list(states):
            due = self.machine.due_ms(states[key])
            if due is not None and due <= now:
                states[key], told = self.machine.time(key, states[key], now)
                out += told
                if states[key] is None:
                    del states[key]
        return out

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=list(self.out)).astype({c: kind for c, kind in self.out.items() if kind})

    def close(self) -> None:
        pass


def _unpacked(packed: bytes) -> Iterator[tuple]:
    """The rows of pickled lists, one behind the other."""
    stream = io.BytesIO(packed)
    while stream.tell() < len(packed):
        yield from pickle.load(stream)


def _none_last(row: tuple) -> tuple:
    return tuple((v is None or v != v, v if v is not None and v == v else 0) for v in row)


def after_watermark(column: str, at: str) -> Column:
    """Whether ``column`` and the event time ``at`` are there; rows that have a time alone still move the watermark.

    A test of ``column`` by itself would be moved before the watermark by the optimizer.
    """
    return F.when(F.col(at).isNotNull(), F.col(column)).isNotNull()


def in_order(rows: DataFrame, key: str, order: list[str], at_ms: str, machine: Machine, out: str, kinds: dict[str, str] | None = None, span_ms: int = SPAN_MS, groups: int = GROUPS) -> DataFrame:
    """What ``machine`` tells of the rows of each ``key``, handed over in the order of ``order``.

    ``rows`` has a watermark; the machine gets the columns ``order`` of a row, which decide its
    place. ``at_ms`` is its event time in milliseconds. ``out`` is the schema of what comes out,
    ``kinds`` pandas types of its columns that may be null. A task holds the rows of one of
    ``groups`` groups of keys that a micro-batch hands over.
    """
    names = {c.split()[0]: (kinds or {}).get(c.split()[0], "") for c in out.split(", ")}
    timed = rows.withColumn("at_ms", F.col(at_ms).cast("long")) if at_ms != "at_ms" else rows
    processor = _InOrder(machine, key, order, names, span_ms)
    return timed.withColumn("key_group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("key_group").transformWithStateInPandas(processor, out, "append", "EventTime")


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def start(out: DataFrame, writer: DataStreamWriter) -> StreamingQuery:
    """Starts ``writer`` with a state store that has timers; the session's own setting stays."""
    with _state_store(out.sparkSession):
        return writer.start()
