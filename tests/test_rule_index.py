"""The index of large rule sets beside the test of every rule on every row."""

import random
import time

import pytest

from emberline.operators.match import match_rules
from emberline.operators.rule_index import Intervals, RuleIndex, match_indexed
from emberline.plans.catalog import INT, IP, STRING, Field, FieldCatalog
from emberline.plans.regex import required_piece
from emberline.plans.rules import compile_rules
from emberline.queries import bench, rule_toml, table
from emberline.rule_queries import drawn_rules

CATALOG = FieldCatalog(
    [Field("e.n", INT, "n"), Field("e.m", INT, "m + 0"), Field("e.s", STRING, "s"), Field("e.ip", IP, "ip"), Field("a.n", INT, "n", frozenset({"a"})), Field("b.s", STRING, "s", frozenset({"b"}))],
    "kind", ("n",), ("ts", "seq"), meta={"pid": "m"},
)
SCHEMA = "seq long, ts long, kind string, n long, m long, s string, ip long, rule_id string"
WORDS = ["", "a", "ab", "abc", "abcabc", "x.y", "b\nc", "ünï", "AB", "a}b", "aa"]


def drawn(rnd, i):
    def condition():
        number = rnd.choice([-3, 0, 1, 5, 7, 8, 1 << 40, -(1 << 63), (1 << 63) - 1])
        field = rnd.choice(["e.n", "e.m", "a.n"])
        text = rnd.choice(["e.s", "b.s"])
        return rnd.choice([
            (field, rnd.choice(["==", "!=", ">", ">=", "<", "<="]), number),
            (field, rnd.choice(["in", "not_in"]), rnd.sample(range(-3, 9), rnd.randint(1, 4))),
            (field, "bit_and", rnd.choice([1, 4, 6])),
            (rnd.choice([field, text, "e.ip"]), "exists", True),
            (text, rnd.choice(["==", "!=", "contains", "starts_with"]), rnd.choice(WORDS)),
            (text, rnd.choice(["in", "not_in"]), rnd.sample(WORDS, 3)),
            (text, "regex", rnd.choice(["ab", "^a.c", "b+c", "[ab]b", "a|x", r"\.y$", "(?i)ab", "c$", "ï", r"a\}b", ".", "(ab)+c"])),
            ("e.ip", rnd.choice(["==", "in"]), "10.0.0.1") if rnd.random() < 0.5 else ("e.ip", "in", ["10.0.0.1", "10.0.0.9"]),
        ])

    conditions = [condition() for _ in range(rnd.randint(1, 4))]
    conditions = [c if not (c[0] == "e.ip" and c[1] == "in" and isinstance(c[2], str)) else ("e.ip", "==", c[2]) for c in conditions]
    return rule_toml(f"r{i}", conditions, rnd.choice(["low", "high"]))


@pytest.mark.parametrize("seed", range(2))
def test_same_as_testing_every_rule(spark, seed):
    rnd = random.Random(seed)
    snapshot = compile_rules([drawn(rnd, i) for i in range(250)], CATALOG)
    maybe = lambda v: None if rnd.random() < 0.15 else v
    rows = [(i, i, maybe(rnd.choice("abc")), maybe(rnd.choice([-(1 << 63), -3, 0, 1, 2, 5, 7, 8, 1 << 40, (1 << 63) - 1])), maybe(rnd.randint(-2, 9)), maybe(rnd.choice(WORDS + ["xabcx", "zünïz"])), maybe(rnd.choice([167772161, 167772169, 5])), "clash") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = RuleIndex(snapshot)
    assert len(index.rest) < 60 and index.values and index.by_piece and index.intervals
    want, got = match_rules(df, snapshot, keep=("s",)), match_indexed(df, snapshot, keep=("s",))
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert match_indexed(df.limit(0), snapshot).count() == 0


def test_intervals():
    rnd = random.Random(3)
    low, high = -(1 << 63), (1 << 63) - 1
    own = [tuple(sorted((rnd.randint(-50, 50), rnd.randint(-50, 50)))) + (i,) for i in range(40)] + [(low, 3, 40), (-2, high, 41), (low, high, 42), (7, 6, 43), (high, high, 44)]
    import numpy as np

    tree = Intervals(own)
    values = np.array([low, *range(-60, 60), high], dtype=np.int64)
    place, rule = tree.of(values)
    got = sorted(zip(values[place].tolist(), rule.tolist()))
    assert got == sorted((v, r) for v in values.tolist() for a, b, r in own if a <= v <= b)


@pytest.mark.parametrize("pattern, piece", [(r": 4[05]\}$", ": 4"), ("ab?c", "a"), ("a{3}bc", "bc"), ("x|y", ""), ("(?i)abc", ""), (r"a[b\]c]def", "def"), ("a(b[)]c)def", "a"), (r"\x41bc", ""), ("[^]x]abc", "abc")])
def test_required_piece(pattern, piece):
    assert required_piece(pattern) == piece


def test_rules_of_one_value_are_not_tested_on_other_rows(spark):
    """Ten thousand rules take hardly longer than a hundred: pairs that are tested follow the matches."""
    events = table(spark, "/root/testdata/sf0.01", "events")
    batch = events.limit(2000).toArrow()
    import pyarrow as pa

    tested = {}
    for n in (100, 10_000):
        index = RuleIndex(drawn_rules(n))
        assert not index.rest
        k = [int(p.split(":")[1].strip(" }")) for p in batch.column("props").to_pylist()]
        columns = {"event.type": batch.column("event_type"), "event.props": batch.column("props"), "user.id": batch.column("user_id"), "event.id": batch.column("event_id"), "event.value": pa.array([int(v) for v in batch.column("value").to_pylist()]), "props.k": pa.array(k)}
        columns = {f: (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for f, c in columns.items() if f in index.fields}
        began = time.perf_counter()
        rows, _, _ = index.run(columns)
        tested[n] = len(rows), time.perf_counter() - began
    assert tested[10_000][0] > 20 * tested[100][0]
    assert tested[10_000][1] < 2.0


def test_no_rules_and_unmatchable_rules(spark):
    events = table(spark, "/root/testdata/sf0.001", "events")
    assert match_indexed(events, compile_rules([], bench(rule_toml("a", [("user.id", "==", 1)])).catalog, allow_empty=True)).count() == 0
    both = bench(rule_toml("never", [("click.value", ">", 1), ("purchase.value", ">", 1)]))
    assert match_indexed(events, both).count() == 0
