"""Large rule sets: an index over what rules ask for picks the few rules that can match a row.

Each rule is filed under one of its conditions: a value it equals or has in a list, a piece of
text it must contain (a required piece of a pattern counts), or an interval of numbers. A batch
of rows looks its values up, one lookup a distinct value or row, whatever the number of rules:

* values are found by binary search among all that rules ask for, with lists of their rules;
* one Aho-Corasick automaton a field finds all pieces of text in one pass over a distinct text;
* intervals lie in the nodes of a tree over their sorted ends, and a number visits the nodes on
  its way to the root, which hold the rules whose intervals contain it and no others.

Only these candidates are tested on their other conditions, all pairs of a kind at once, cheap
kinds first; a text or a list is tested once for all rows that have the same value. Patterns that
may mean something else in Python are left to Spark's own matcher, for pairs that have passed all else.
Rules that no lookup can find are tested on every row, as in ``match_rules``.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..plans.catalog import STRING
from ..plans.conditions import Condition
from ..plans.regex import plain_pattern, required_piece, translate
from ..plans.rules import Rule, RuleSnapshot
from .match import match_array, with_fields

#: A value that so many rules ask for is a poor place to file a rule under.
SHARED = 64
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Lists:
    """Lists of numbers by key."""

    def __init__(self, keys: list[int], items: list[int], n_keys: int):
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.items = np.array(items, dtype=np.int64)[order]
        self.starts = np.searchsorted(np.array(keys, dtype=np.int64)[order], np.arange(n_keys + 1))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, item) of all items of all ``keys``."""
        first, n = self.starts[keys], self.starts[keys + 1] - self.starts[keys]
        place = np.repeat(np.arange(len(keys)), n)
        within = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return place, self.items[np.repeat(first, n) + within]


class Intervals:
    """Rules by intervals, both ends included; those that nothing lies in are left out."""

    def __init__(self, intervals: list[tuple[int, int, int]]):
        intervals = [i for i in intervals if i[0] <= i[1]]
        self.ends = np.unique(np.array([[low, high + 1 if high < _HIGH else high] for low, high, _ in intervals], dtype=np.int64).reshape(-1))
        self.size = 1 << max(1, int(len(self.ends) + 1).bit_length())
        keys, items = [], []
        for low, high, rule in intervals:
            a = int(np.searchsorted(self.ends, low, side="right")) + self.size
            b = (int(np.searchsorted(self.ends, high, side="right")) if high < _HIGH else len(self.ends)) + 1 + self.size
            while a < b:
                if a & 1:
                    keys.append(a)
                    items.append(rule)
                    a += 1
                if b & 1:
                    b -= 1
                    keys.append(b)
                    items.append(rule)
                a, b = a >> 1, b >> 1
        self.nodes = Lists(keys, items, 2 * self.size)

    def of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.searchsorted(self.ends, values, side="right") + self.size
        places, rules = [], []
        while node[0] if len(node) else False:
            place, rule = self.nodes.of(node)
            places.append(place)
            rules.append(rule)
            node = node >> 1
        return (np.concatenate(places), np.concatenate(rules)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _interval(conditions: list[Condition]) -> tuple[int, int]:
    low, high = _LOW, _HIGH
    for c in conditions:
        v = c.literal.value
        match c.op:
            case "gt":
                low = max(low, v + 1)
            case "gte":
                low = max(low, v)
            case "lt":
                high = min(high, v - 1)
            case "lte":
                high = min(high, v)
    return low, high


_RANGES = ("gt", "gte", "lt", "lte")


def _numbers(c: Condition) -> list[int]:
    values = c.literal.value if c.literal.many else (c.literal.value,)
    return [v for v in values if isinstance(v, int) and not isinstance(v, bool)]


class RuleIndex:
    """The rules of a snapshot that lookups can find; ``rest`` are those that they cannot."""

    def __init__(self, snapshot: RuleSnapshot):
        self.candidates = snapshot.candidates
        types = {c.field: snapshot.catalog.find(c.field).type for r in self.candidates for c in r.conditions}
        self.text = {f: t == STRING for f, t in types.items()}
        asked = Counter((c.field, v) for r in self.candidates for c in r.conditions if c.op in ("eq", "in") for v in (c.literal.value if c.literal.many else (c.literal.value,)))
        self.conditions: list[Condition] = []
        self.numbers: list[int] = []
        filed_values: dict[str, list[tuple[object, int]]] = {}
        filed_pieces: dict[str, list[tuple[str, bool, int]]] = {}
        filed_intervals: dict[str, list[tuple[int, int, int]]] = {}
        self.pieces: dict[str, dict[tuple[str, bool], int]] = {}
        self.piece_of: dict[int, int] = {}
        owners: list[int] = []
        self.rest: list[Rule] = []
        for at, rule in enumerate(self.candidates):
            if rule.kinds is not None and not rule.kinds:
                continue
            filed, used = self._file(rule, asked)
            if filed is None or any(_LOW > v or v > _HIGH for c in rule.conditions for v in _numbers(c)):
                self.rest.append(rule)
                continue
            kind, field, what = filed
            if kind == "values":
                filed_values.setdefault(field, []).extend((v, at) for v in dict.fromkeys(what))
            elif kind == "piece":
                filed_pieces.setdefault(field, []).append((*what, at))
            else:
                filed_intervals.setdefault(field, []).append((*what, at))
            for c in rule.conditions:
                if c in used:
                    continue
                n = len(self.conditions)
                self.conditions.append(c)
                owners.append(at)
                self.numbers.append(_numbers(c)[0] if not self.text[c.field] and not c.literal.many and _numbers(c) else 0)
                piece = (c.literal.value, c.op == "starts_with") if c.op in ("contains", "starts_with") and self.text[c.field] and not c.literal.many and c.literal.type == STRING else None
                if piece is not None:
                    known = self.pieces.setdefault(c.field, {})
                    self.piece_of[n] = known.setdefault(piece, len(known))
        self.values = {}
        for f, own in filed_values.items():
            keys = sorted({v for v, _ in own})
            place = {v: i for i, v in enumerate(keys)}
            lists = Lists([place[v] for v, _ in own], [r for _, r in own], len(keys))
            self.values[f] = (place, lists) if self.text[f] else (np.array(keys, dtype=np.int64), lists)
        self.by_piece = {}
        for f, own in filed_pieces.items():
            known = self.pieces.setdefault(f, {})
            ids = [known.setdefault((text, start), len(known)) for text, start, _ in own]
            self.by_piece[f] = (ids, [r for *_, r in own])
        self.by_piece = {f: Lists(*lists, len(self.pieces[f])) for f, lists in self.by_piece.items()}
        self.intervals = {f: Intervals(own) for f, own in filed_intervals.items()}
        self.automata = {f: self._automaton(known) for f, known in self.pieces.items()}
        self.tests = Lists(owners, list(range(len(owners))), len(self.candidates))
        named = [("later" if c.op == "regex" and plain_pattern(c.literal.value) is None else c.op, c.field) for c in self.conditions]
        kinds = {k: i for i, k in enumerate(dict.fromkeys(named))}
        self.kinds = list(kinds)
        self.kind_of = np.array([kinds[k] for k in named], dtype=np.int64)
        self.number = np.array(self.numbers, dtype=np.int64)
        self.fields = sorted({c.field for c in self.conditions} | set(self.values) | set(self.pieces) | set(self.intervals))

    def _file(self, rule: Rule, asked: Counter) -> tuple[tuple | None, list[Condition]]:
        """(where ``rule`` is filed, the conditions that this settles)."""
        best, settled, worst = None, [], 1 << 62
        for c in rule.conditions:
            if c.op in ("eq", "in") and c.literal.type != "bool":
                values = c.literal.value if c.literal.many else (c.literal.value,)
                shared = sum(asked[c.field, v] for v in values)
                if shared < worst:
                    best, settled, worst = ("values", c.field, values), [c], shared
        if best and worst <= SHARED:
            return best, settled
        for c in rule.conditions:
            if not self.text[c.field]:
                continue
            if c.op in ("contains", "starts_with") and c.literal.type == STRING and not c.literal.many and c.literal.value:
                return ("piece", c.field, (c.literal.value, c.op == "starts_with")), [c]
            if c.op == "regex" and (piece := required_piece(c.literal.value)):
                return ("piece", c.field, (piece, False)), []
        ranges: dict[str, list[Condition]] = {}
        for c in rule.conditions:
            if c.op in _RANGES and not self.text[c.field]:
                ranges.setdefault(c.field, []).append(c)
        bounded = {f: b - a for f, own in ranges.items() for a, b in [_interval(own)] if a > _LOW and b < _HIGH}
        if bounded or (ranges and not best):
            field = min(bounded, key=bounded.get) if bounded else next(iter(ranges))
            return ("interval", field, _interval(ranges[field])), ranges[field]
        return best, settled

    @staticmethod
    def _automaton(known: dict[tuple[str, bool], int]) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        both: dict[str, list[tuple[int, int, bool]]] = {}
        for (text, start), piece in known.items():
            both.setdefault(text, []).append((piece, len(text), start))
        for text, own in both.items():
            if text:
                automaton.add_word(text, own)
        automaton.make_automaton()
        return automaton

    def run(self, columns: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, list[list[dict] | None]]:
        """(row, place of the rule among the candidates, patterns still to be tested) of all pairs that pass."""
        batch = _Columns(self, columns)
        rows, rules = batch.candidates()
        pending: dict[int, list[int]] = {}
        # Slot by slot: the first tests of all pairs, then the second ones of those that are left.
        n_tests = self.tests.starts[1:] - self.tests.starts[:-1]
        numbers = np.arange(len(rows))
        for slot in range(int(n_tests.max(initial=0))):
            more = np.flatnonzero(n_tests[rules] > slot)
            if not len(more):
                break
            test = self.tests.items[self.tests.starts[rules[more]] + slot]
            passed = np.ones(len(rows), dtype=bool)
            kind = self.kind_of[test]
            for k in np.unique(kind).tolist():
                own = kind == k
                op, field = self.kinds[k]
                if op == "later":
                    for pair, c in zip(numbers[more[own]].tolist(), test[own].tolist()):
                        pending.setdefault(pair, []).append(c)
                    passed[more[own]] = batch.known(field, rows[more[own]])
                else:
                    passed[more[own]] = batch.test(op, field, rows[more[own]], test[own])
            rows, rules, numbers = rows[passed], rules[passed], numbers[passed]
        left: list[list[dict] | None] = [None] * len(rows)
        if pending:
            java = {c: translate(self.conditions[c].literal.value) for own in pending.values() for c in own}
            for i, (row, pair) in enumerate(zip(rows.tolist(), numbers.tolist())):
                if pair in pending:
                    left[i] = [{"value": batch.string(self.conditions[c].field, row), "pattern": java[c]} for c in pending[pair]]
        return rows, rules, left


class _Columns:
    """The fields of one batch, with what has been looked up for them."""

    def __init__(self, index: RuleIndex, columns: dict[str, pa.Array]):
        self.index, self.there, self.value, self.strings, self.codes_of, self.hits = index, {}, {}, {}, {}, {}
        for f, column in columns.items():
            self.there[f] = column.is_valid().to_numpy(zero_copy_only=False)
            if index.text[f]:
                coded = column.dictionary_encode()
                self.value[f] = np.where(self.there[f], coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), -1)
                self.strings[f] = coded.dictionary.to_pylist()
                self.codes_of[f] = {s: i for i, s in enumerate(self.strings[f])}
            else:
                self.value[f] = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for f, automaton in index.automata.items():
            codes, pieces = [], []
            empty = [p for (text, _), p in index.pieces[f].items() if not text]
            for code, s in enumerate(self.strings[f]):
                found = {p for end, own in automaton.iter(s) for p, size, start in own if not start or end + 1 == size} if len(automaton) and s else set()
                found.update(empty)
                codes += [code] * len(found)
                pieces += found
            self.hits[f] = np.array(codes, dtype=np.int64), np.array(pieces, dtype=np.int64)

    def known(self, field: str, rows: np.ndarray) -> np.ndarray:
        return self.there[field][rows]

    def string(self, field: str, row: int) -> str:
        return self.strings[field][self.value[field][row]]

    def _rows_of_codes(self, field: str) -> Lists:
        rows = np.flatnonzero(self.there[field])
        return Lists(self.value[field][rows].tolist(), rows.tolist(), len(self.strings[field]))

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        rows, rules = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def add(row: np.ndarray, rule: np.ndarray) -> None:
            rows.append(row)
            rules.append(rule)

        for f, (keys, lists) in self.index.values.items():
            if self.index.text[f]:
                coded = [(c, keys[s]) for c, s in enumerate(self.strings[f]) if s in keys]
                of_code = self._rows_of_codes(f)
                place, rule = lists.of(np.array([k for _, k in coded], dtype=np.int64))
                self._spread(of_code, np.array([c for c, _ in coded], dtype=np.int64)[place], rule, add)
            else:
                here = np.flatnonzero(self.there[f])
                at = np.minimum(np.searchsorted(keys, self.value[f][here]), len(keys) - 1)
                same = keys[at] == self.value[f][here]
                place, rule = lists.of(at[same])
                add(here[same][place], rule)
        for f, lists in self.index.by_piece.items():
            codes, pieces = self.hits[f]
            place, rule = lists.of(pieces)
            self._spread(self._rows_of_codes(f), codes[place], rule, add)
        for f, tree in self.index.intervals.items():
            here = np.flatnonzero(self.there[f])
            place, rule = tree.of(self.value[f][here])
            add(here[place], rule)
        return np.concatenate(rows), np.concatenate(rules)

    @staticmethod
    def _spread(of_code: Lists, codes: np.ndarray, rules: np.ndarray, add) -> None:
        place, row = of_code.of(codes)
        add(row, rules[place])

    def test(self, op: str, field: str, rows: np.ndarray, tests: np.ndarray) -> np.ndarray:
        """Whether ``rows`` pass the conditions ``tests``, all of one operator and field."""
        index, value, there = self.index, self.value[field][rows], self.there[field][rows]
        if op == "exists":
            return there
        if not index.text[field]:
            number = index.number[tests]
            match op:
                case "eq":
                    return there & (value == number)
                case "ne":
                    return there & (value != number)
                case "gt":
                    return there & (value > number)
                case "gte":
                    return there & (value >= number)
                case "lt":
                    return there & (value < number)
                case "lte":
                    return there & (value <= number)
                case "bit_and":
                    return there & ((value & number) != 0)
        if op in ("contains", "starts_with"):
            unique, back = np.unique(tests, return_inverse=True)
            piece = np.array([index.piece_of.get(c, -1) for c in unique.tolist()], dtype=np.int64)[back]
            codes, pieces = self.hits.get(field, (np.zeros(0, np.int64),) * 2)
            size = len(index.pieces.get(field, ())) + 1
            return there & (piece >= 0) & np.isin(value * size + piece, codes * size + pieces)
        # Each distinct pair of a value and a condition once.
        unique, back = np.unique(tests, return_inverse=True)
        values, codes = np.unique(value, return_inverse=True)
        pairs, at = np.unique(codes * len(unique) + back, return_inverse=True)
        plain = [self.strings[field][v] if v >= 0 else None for v in values.tolist()] if index.text[field] else values.tolist()
        if op == "regex":
            texts = [index.conditions[c].literal.value for c in unique.tolist()]
            distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            same = np.array([distinct[t] for t in texts], dtype=np.int64)
            pairs, at = np.unique(codes * len(distinct) + same[back], return_inverse=True)
            finds = [plain_pattern(t).search for t in distinct]
            return there & np.array([plain[p // len(finds)] is not None and finds[p % len(finds)](plain[p // len(finds)]) is not None for p in pairs.tolist()], dtype=bool)[at]
        literals = [index.conditions[c].literal for c in unique.tolist()]
        sets = [set(x.value) if x.many else {x.value} for x in literals]
        inside = np.array([plain[p // len(unique)] in sets[p % len(unique)] for p in pairs.tolist()], dtype=bool)[at]
        return there & (inside if op in ("eq", "in") else ~inside)


@lru_cache(maxsize=4)
def _index_of(key: tuple, packed: bytes) -> RuleIndex:
    return RuleIndex(pickle.loads(packed))


def match_indexed(events: DataFrame, snapshot: RuleSnapshot, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``match_rules``, by lookups instead of a test of every rule on every row."""
    c = snapshot.catalog
    index = RuleIndex(snapshot)
    base = list(dict.fromkeys([*c.order, *c.shard, c.kind_column, *keep]))
    meta = [F.expr(column).alias(f"meta_{name}") for name, column in c.meta.items()]
    slim_events, slim = with_fields(events, snapshot)
    carried = slim_events.select(*base, *meta)
    values = [slim.find(f).value(c.kind_column).cast("string" if index.text[f] else "long").alias(f"_v{i}") for i, f in enumerate(index.fields)]
    told = [StructField("rule_id", StringType()), StructField("rule_hash", StringType()), StructField("severity", StringType()), StructField("cand_pos", IntegerType())]
    found_type = StructType([*carried.schema.fields, *told])
    names, packed, key = [f.name for f in carried.schema.fields], pickle.dumps(snapshot), tuple(r.hash for r in snapshot.rules[:3]) + (len(snapshot.rules),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _index_of(key, packed)
        ids, hashes, severities = (pa.array([getattr(r, a) for r in own.candidates]) for a in ("id", "hash", "severity"))
        pending_type = pa.list_(pa.struct([("value", pa.string()), ("pattern", pa.string())]))
        for batch in batches:
            rows, rules, left = own.run({f: batch.column(f"_v{i}") for i, f in enumerate(own.fields)})
            at, rule = pa.array(rows), pa.array(rules)
            columns = [batch.column(n).take(at) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, ids.take(rule), hashes.take(rule), severities.take(rule), rule.cast(pa.int32()), pa.array(left, pending_type)], [*names, "rule_id", "rule_hash", "severity", "cand_pos", "_pending"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found_type.fields) + ", _pending array<struct<value:string,pattern:string>>"
    found = slim_events.select(*base, *meta, *values).mapInArrow(run, schema)
    found = found.where("_pending IS NULL OR forall(_pending, x -> x.value RLIKE x.pattern)").drop("_pending")
    if index.rest:
        others = slim_events.select(*base, *meta, F.explode(match_array(snapshot, index.rest, slim)).alias("m")).select(*base, *[f"meta_{n}" for n in c.meta], "m.*")
        found = found.unionByName(others)
    return found.select(*base, "rule_id", "rule_hash", "severity", "cand_pos", *[F.col(f"meta_{name}").alias(name) for name in c.meta if name not in base])
