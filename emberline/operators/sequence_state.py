"""The sequence correlator as a plain state machine: the specification of the window plans.

Matches of one shard come in order of time, event and candidate position. A match of a rule that
has a sequence starts an instance; then every sequence that waits for the rule is advanced. A
step must come within its limit after the one before, the limit included; anything else leaves
the instance as it is. In the scope of a process an absent pid is equal to none: such a root
waits until it expires.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..plans.rules import Rule, RuleSnapshot

#: Live instances of one rule in one shard; beyond it the oldest goes.
MOST_INSTANCES = 256


@dataclass
class Progress:
    expiry: int
    scope_pid: int | None
    root: tuple
    step: int = 0
    hits: int = 0
    path: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Step:
    root_rule: str
    sequence: str
    instance: int
    step: int
    matched_rule: str
    root: tuple


@dataclass(frozen=True)
class Completed:
    root_rule: str
    sequence: str
    instance: int
    path: tuple[str, ...]
    root: tuple


class Correlator:
    """State of one shard. ``counted_thresholds`` is an extension: a threshold sequence waits for its count."""

    def __init__(self, snapshot: RuleSnapshot, most: int = MOST_INSTANCES, counted_thresholds: bool = False):
        self.roots: list[Rule] = snapshot.sequences
        self.starts = {r.id: r for r in self.roots}
        self.listeners: dict[str, list[Rule]] = {}
        for root in self.roots:
            for step in root.sequence.steps:
                if root not in self.listeners.setdefault(step.rule_id, []):
                    self.listeners[step.rule_id].append(root)
        self.most, self.counted = most, counted_thresholds
        self.live: dict[str, dict[int, Progress]] = {}
        self.next_id = 1

    def forget(self) -> None:
        """Back to the start, for the next shard or cell."""
        self.live, self.next_id = {}, 1

    def on_match(self, rule_id: str, now: int, pid: int | None, key: tuple = ()) -> list[Step | Completed]:
        out: list[Step | Completed] = []
        if rule_id in self.starts:
            self._start(self.starts[rule_id], now, pid, key)
        for root in self.listeners.get(rule_id, ()):
            out += self._advance(root, rule_id, now, pid)
        return out

    def _start(self, rule: Rule, now: int, pid: int | None, key: tuple) -> None:
        seq = rule.sequence
        if not seq.steps:
            return
        own = self.live.setdefault(rule.id, {})
        for i in [i for i, p in own.items() if p.expiry < now]:
            del own[i]
        while len(own) >= self.most:
            del own[min(own)]
        own[self.next_id] = Progress(now + seq.steps[0].within_ns, pid if seq.scope == "pid" else None, key)
        self.next_id += 1

    def _advance(self, root: Rule, rule_id: str, now: int, pid: int | None) -> list[Step | Completed]:
        own, seq = self.live.get(root.id), root.sequence
        if not own:
            return []
        out: list[Step | Completed] = []
        done: list[int] = []
        for i in sorted(own):
            p = own[i]
            if now > p.expiry:
                done.append(i)
                continue
            if seq.scope == "pid" and (pid is None or p.scope_pid != pid) or p.step >= len(seq.steps) or seq.steps[p.step].rule_id != rule_id:
                continue
            if self.counted and seq.kind == "threshold":
                p.hits += 1
                if p.hits < seq.threshold:
                    continue
            p.path.append(rule_id)
            out.append(Step(root.id, seq.id, i, p.step, rule_id, p.root))
            p.step += 1
            if p.step == len(seq.steps):
                out.append(Completed(root.id, seq.id, i, tuple(p.path), p.root))
                done.append(i)
            else:
                p.expiry = now + seq.steps[p.step].within_ns
        for i in done:
            del own[i]
        if not own:
            del self.live[root.id]
            if not self.live:
                self.next_id = 1
        return out
