"""Rules and sequences on streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.match import match_rules
from ..operators.sequence import OUT, nanos, prepared
from ..operators.sequence_state import MOST_INSTANCES, Completed, Correlator
from ..plans.rules import RuleSnapshot
from .ordered import SPAN_MS, Machine, in_order

NANOS_PER_MS = 1_000_000


def stream_matches(events: DataFrame, snapshot: RuleSnapshot) -> DataFrame:
    """The same plan as in batch: a projection and a generator, without state."""
    return match_rules(events, snapshot)


class _Sequences(Machine):
    """The correlator of one shard; its state outlives a reload of rules, as it refers to them by id."""

    def __init__(self, snapshot: RuleSnapshot, most: int):
        self.machine = Correlator(snapshot, most)

    def fresh(self) -> tuple:
        return {}, 1

    def rows(self, key: str, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        machine, out = self.machine, []
        machine.live, machine.next_id = state
        for t, event, pos, rule_id, pid in rows:
            at = f"{t}:{event}:{pos}"
            for e in machine.on_match(rule_id, int(t), None if pd.isna(pid) else int(pid), (at,)):
                if isinstance(e, Completed):
                    out.append((key, "completed", e.root_rule, e.sequence, e.root[0], None, None, list(e.path), len(e.path), at))
                else:
                    out.append((key, "step", e.root_rule, e.sequence, e.root[0], e.step, e.matched_rule, None, None, at))
        return (machine.live, machine.next_id), out

    def due_ms(self, state: tuple) -> int:
        last = max((p.expiry for own in state[0].values() for p in own.values()), default=None)
        return 0 if last is None else last // NANOS_PER_MS + 1

    def time(self, key: str, state: tuple, now_ms: int) -> tuple[None, list[tuple]]:
        return None, []


def stream_sequences(events: DataFrame, snapshot: RuleSnapshot, late: str, most: int = MOST_INSTANCES, span_ms: int = SPAN_MS) -> DataFrame:
    """Step and completion records of the rules' sequences over a stream of ``events``, as ``correlate`` gives them in batch.

    ``late`` is how far a row may be behind the newest one, of whatever shard and whether or not
    it matches a rule. Matches go to the correlator of their shard in the order of time, event and
    evaluation once the watermark has passed them, so records come that much later. A shard's
    state goes when the watermark has passed its last limit.
    """
    c = snapshot.catalog
    t = nanos(F.col(c.order[0]), dict(events.dtypes)[c.order[0]])
    timed = events.withColumn("_at", t).withColumn("_at", F.expr("timestamp_micros(_at div 1000)")).withWatermark("_at", late)
    matched = match_rules(timed, snapshot, keep=("_at",))
    rows = prepared(matched, snapshot, keep=("_at",)).where("t IS NOT NULL").withColumn("at_ms", F.expr("t div 1000000"))
    return in_order(rows, "shard", ["t", "event", "pos", "rule_id", "pid"], "at_ms", _Sequences(snapshot, most), OUT, {"step_idx": "Int32", "steps": "Int32"}, span_ms)
