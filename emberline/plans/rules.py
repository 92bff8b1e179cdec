"""Rules from TOML text to a checked, immutable snapshot."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import blake3_hex
from ..functions.names import SEVERITIES, ip_number
from .catalog import INT, IP, STRING, FieldCatalog, RuleError
from .conditions import Condition, compile_condition

_UNITS = {
    **dict.fromkeys(("nsec", "nsecs", "ns"), 1),
    **dict.fromkeys(("usec", "usecs", "us"), 10**3),
    **dict.fromkeys(("msec", "msecs", "ms", "millis"), 10**6),
    **dict.fromkeys(("seconds", "second", "secs", "sec", "s"), 10**9),
    **dict.fromkeys(("minutes", "minute", "mins", "min", "m"), 60 * 10**9),
    **dict.fromkeys(("hours", "hour", "hrs", "hr", "h"), 3600 * 10**9),
    **dict.fromkeys(("days", "day", "d"), 86400 * 10**9),
    **dict.fromkeys(("weeks", "week", "w"), 7 * 86400 * 10**9),
}


def duration_ns(text: str) -> int:
    """Nanoseconds of a text such as ``5s``, ``10m`` or ``1h 30m``."""
    parts = re.findall(r"(\d+)\s*([a-z]+)", text)
    if not parts or re.sub(r"(\d+)\s*([a-z]+)\s*", "", text).strip() or any(u not in _UNITS for _, u in parts):
        raise RuleError("TomlDe", f"Failed to parse TOML: invalid duration '{text}'")
    return sum(int(n) * _UNITS[u] for n, u in parts)


@dataclass(frozen=True)
class Step:
    rule_id: str
    within_ns: int


@dataclass(frozen=True)
class RuleSequence:
    id: str
    kind: str
    steps: tuple[Step, ...]
    scope: str | None = None
    threshold: int | None = None


@dataclass(frozen=True)
class ActionValue:
    """A literal, or the field of the event that the action is about."""

    type: str
    literal: Any = None
    field: str | None = None


@dataclass(frozen=True)
class Action:
    kind: str
    value: ActionValue


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    severity: str
    conditions: tuple[Condition, ...]
    hash: str
    sequence: RuleSequence | None = None
    trigger: str | None = None
    actions: tuple[Action, ...] = ()
    kinds: frozenset[str] | None = None

    def predicate(self, catalog: FieldCatalog) -> Column:
        """All conditions, cheapest first, behind the kinds that can have their fields."""
        tests = [c.column(catalog) for c in self.conditions]
        if self.kinds is not None:
            tests.insert(0, F.col(catalog.kind_column).isin(*sorted(self.kinds)) if self.kinds else F.lit(False))
        return reduce(lambda a, b: a & b, tests)


def _bound(rule: Rule) -> bool:
    return rule.kinds is not None and len(rule.kinds) > 0


@dataclass(frozen=True)
class RuleSnapshot:
    """Compiled rules in load order with the lookups that evaluation needs."""

    rules: tuple[Rule, ...]
    catalog: FieldCatalog

    def rank(self, rule: Rule) -> tuple[int, int]:
        """Evaluation order: rules bound to kinds first, then the others, each in load order."""
        return (0 if _bound(rule) else 1, self.rules.index(rule))

    @property
    def candidates(self) -> list[Rule]:
        """All rules in evaluation order."""
        return sorted(self.rules, key=lambda r: not _bound(r))

    @property
    def sequences(self) -> list[Rule]:
        return [r for r in self.rules if r.sequence]

    @property
    def listened(self) -> set[str]:
        """Rules that start or advance some sequence."""
        return {r.id for r in self.sequences} | {s.rule_id for r in self.sequences for s in r.sequence.steps}

    def by_id(self, rule_id: str) -> Rule:
        return next(r for r in self.rules if r.id == rule_id)


_ACTIONS = {"kill_process": ("pid", INT), "block_ip": ("ip", IP), "deny_exec": ("path", STRING)}


def _action(raw: dict, catalog: FieldCatalog) -> Action:
    kind = raw.get("type")
    if kind not in _ACTIONS:
        raise RuleError("TomlDe", f"Failed to parse TOML: unknown action '{kind}'")
    param, wanted = _ACTIONS[kind]
    params = raw.get("params", raw)
    if param not in params:
        raise RuleError("TomlDe", f"Failed to parse TOML: missing '{param}'")
    value = params[param]
    if isinstance(value, str) and value.startswith("$"):
        field = catalog.find(value[1:])
        if field.type != wanted:
            raise RuleError("InvalidBinding", f"Field '{field.name}' has type '{field.type}', but '{wanted}' was expected")
        return Action(kind, ActionValue(wanted, field=value[1:]))
    if wanted == INT and (not isinstance(value, int) or isinstance(value, bool)) or wanted != INT and not isinstance(value, str):
        raise RuleError("ExpectedType", f"Expected {wanted}, found {type(value).__name__}")
    if wanted == IP:
        number = ip_number(value)
        if number is None:
            raise RuleError("IpParse", f"Failed to parse the address: {value}")
        value = number
    return Action(kind, ActionValue(wanted, literal=value))


def _sequence(raw: dict) -> RuleSequence:
    steps = tuple(Step(s["rule_id"], duration_ns(s["within"])) for s in raw.get("steps", []))
    kind, threshold = raw.get("kind"), raw.get("threshold")
    seq = RuleSequence(raw["id"], kind, steps, raw.get("scope"), threshold)
    if kind not in ("rule", "event", "threshold") or seq.scope not in (None, "pid"):
        raise RuleError("TomlDe", f"Failed to parse TOML: sequence '{seq.id}'")
    if kind == "threshold":
        if threshold is None:
            raise RuleError("ThresholdKindNeedsCount", f"Sequence '{seq.id}' has kind 'threshold' but no threshold count")
        if threshold < 2:
            raise RuleError("ThresholdTooLow", f"Sequence '{seq.id}' has threshold {threshold}; must be >= 2")
        if len(steps) != 1:
            raise RuleError("ThresholdNeedsSingleStep", f"Sequence '{seq.id}' is a threshold sequence, which requires exactly one step")
    elif threshold is not None:
        raise RuleError("ThresholdOnNonThresholdKind", f"Sequence '{seq.id}' sets a threshold but is not kind 'threshold'")
    return seq


def parse_rule(text: str, catalog: FieldCatalog) -> Rule:
    """One rule of TOML text. Unknown keys are accepted; its version is the digest of the text."""
    try:
        raw = tomllib.loads(text)["rule"]
        rule_id, severity = raw["id"], raw["severity"]
        conditions_raw = [(c["field"], c["op"], c["value"]) for c in raw.get("conditions", [])]
    except (tomllib.TOMLDecodeError, KeyError, TypeError) as e:
        raise RuleError("TomlDe", f"Failed to parse TOML: {e}") from e
    if severity not in SEVERITIES:
        raise RuleError("TomlDe", f"Failed to parse TOML: unknown severity '{severity}'")
    if not conditions_raw:
        raise RuleError("RuleWithoutConditions", f"Rule '{rule_id}' has no conditions, so it would match every event")
    conditions = sorted((compile_condition(*c, catalog) for c in conditions_raw), key=lambda c: c.cost)
    sequence = _sequence(raw["sequence"]) if "sequence" in raw else None
    chain = raw.get("response_chain")
    trigger = chain.get("trigger") if chain else None
    if chain and trigger not in ("rule_match", "sequence_finished"):
        raise RuleError("TomlDe", f"Failed to parse TOML: unknown trigger '{trigger}'")
    if trigger == "sequence_finished" and not sequence:
        raise RuleError("SequenceFinishedTriggerWithoutSequence", f"Encountered a sequence_finished trigger outside of a sequence in rule '{rule_id}'")
    actions = tuple(_action(a, catalog) for a in (chain or {}).get("actions", []))
    kinds = catalog.kinds_for([c.field for c in conditions])
    return Rule(rule_id, raw.get("description", ""), severity, tuple(conditions), blake3_hex(text.encode()), sequence, trigger, actions, kinds)


def compile_rules(texts: Iterable[str], catalog: FieldCatalog, allow_empty: bool = False) -> RuleSnapshot:
    """A snapshot of rule texts in load order, or the error of the first bad one."""
    rules: Sequence[Rule] = tuple(parse_rule(t, catalog) for t in texts)
    if not rules and not allow_empty:
        raise RuleError("NoRulesInDir", "No rules found")
    ids: set[str] = set()
    sequence_ids: set[str] = set()
    for rule in rules:
        if rule.id in ids:
            raise RuleError("DuplicateRuleId", f"Duplicate rule id '{rule.id}'")
        ids.add(rule.id)
        if rule.sequence:
            if rule.sequence.id in sequence_ids:
                raise RuleError("DuplicateSequenceId", f"Duplicate sequence id '{rule.sequence.id}'")
            sequence_ids.add(rule.sequence.id)
    for rule in rules:
        if not rule.sequence:
            continue
        if not rule.sequence.steps:
            raise RuleError("SequenceWithoutSteps", f"Rule '{rule.id}' declares sequence '{rule.sequence.id}' with no steps, so it can never fire")
        for i, step in enumerate(rule.sequence.steps):
            if step.rule_id not in ids:
                raise RuleError("UnknownSequenceStepRule", f"Rule '{rule.id}': sequence '{rule.sequence.id}' step {i} references unknown rule '{step.rule_id}'")
    return RuleSnapshot(tuple(rules), catalog)
