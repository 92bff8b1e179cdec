import random

import pytest

from emberline.operators.match import match_rules
from emberline.operators.sequence import correlate
from emberline.operators.sequence_state import Completed, Correlator, Step
from emberline.plans.catalog import FieldCatalog, Field, INT, STRING
from emberline.plans.rules import compile_rules
from emberline.queries import rule_toml, sequence_toml

S = 10**9
CATALOG = FieldCatalog([Field("e.name", STRING, "name"), Field("e.pid", INT, "pid")], "name", ("shard",), ("ts", "seq_no"), meta={"pid": "pid"})


def rules(steps, scope="", root="kernel-module-loader", extra=()):
    texts = [rule_toml(root, [("e.name", "==", root)], tail=sequence_toml("test", steps, scope=scope))]
    texts += [rule_toml(r, [("e.name", "==", r)]) for r in ("port-scan", "service-probe", "unrelated")]
    return compile_rules([*texts, *extra], CATALOG)


TWO = [("port-scan", "10s"), ("service-probe", "15s")]
ROOT = "kernel-module-loader"


def play(snapshot, rows, **kw):
    machine = Correlator(snapshot, **kw)
    return [machine.on_match(r, int(t * S), pid) for t, r, pid in rows], machine


def test_completes():
    out, _ = play(rules(TWO), [(0, ROOT, 1), (5, "port-scan", 1), (10, "service-probe", 1)])
    assert out[0] == [] and [type(e) for e in out[1]] == [Step] and [type(e) for e in out[2]] == [Step, Completed]
    assert out[2][1].path == ("port-scan", "service-probe")


@pytest.mark.parametrize("scope, want", [("pid", [0, 1]), ("", [1, 0])])
def test_scope(scope, want):
    out, _ = play(rules(TWO, scope), [(0, ROOT, 100), (1, "port-scan", 999), (2, "port-scan", 100)])
    assert [len(x) for x in out[1:]] == want


def test_expires_and_drains():
    out, machine = play(rules(TWO), [(0, ROOT, 1), (20, "port-scan", 1)])
    assert out[1] == [] and not machine.live and machine.next_id == 1


def test_limit_is_inclusive():
    out, _ = play(rules(TWO), [(0, ROOT, 1), (10, "port-scan", 1), (25, "service-probe", 1)])
    assert len(out[1]) == 1 and len(out[2]) == 2


def test_wrong_rule_and_order():
    out, machine = play(rules(TWO), [(0, ROOT, 1), (2, "unrelated", 1), (3, "service-probe", 1)])
    assert out[1] == out[2] == [] and machine.live


def test_concurrent_instances_and_ids():
    out, _ = play(rules(TWO), [(0, ROOT, 1), (1, ROOT, 1), (3, "port-scan", 1)])
    assert [e.instance for e in out[2]] == [1, 2]


def test_sweep_and_cap():
    _, machine = play(rules(TWO), [(11 * i, ROOT, 1) for i in range(50)])
    assert len(machine.live[ROOT]) == 1
    _, machine = play(rules(TWO), [(i / 1000, ROOT, 1) for i in range(768)])
    assert len(machine.live[ROOT]) == 256 and min(machine.live[ROOT]) == 513


def test_self_step():
    out, _ = play(rules([(ROOT, "5s"), ("port-scan", "5s")]), [(0, ROOT, 1), (1, "port-scan", 1)])
    assert [type(e) for e in out[0]] == [Step] and [type(e) for e in out[1]] == [Step, Completed]


def test_threshold_is_one_hit_unless_counted():
    snapshot = compile_rules([rule_toml(ROOT, [("e.name", "==", ROOT)], tail=sequence_toml("t", [("port-scan", "9s")], "threshold", more="threshold = 2\n")), rule_toml("port-scan", [("e.name", "==", "port-scan")])], CATALOG)
    rows = [(0, ROOT, 1), (1, "port-scan", 1), (2, "port-scan", 1)]
    assert [len(x) for x in play(snapshot, rows)[0]] == [0, 2, 0]
    assert [len(x) for x in play(snapshot, rows, counted_thresholds=True)[0]] == [0, 0, 2]


def as_rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("shard", "type", "root_rule_id", "root_order", "step_idx", "matched_rule_id", "path", "steps", "event_order").collect())))


@pytest.mark.parametrize("seed", range(3))
def test_window_plan_equals_state_machine(spark, seed):
    rnd = random.Random(seed)
    names = [ROOT, "port-scan", "service-probe"]
    both = rule_toml("either", [("e.name", "in", ["port-scan", "service-probe"])])
    snapshots = [
        rules(TWO),
        rules(TWO, "pid"),
        rules([(ROOT, "3s"), ("port-scan", "6s"), (ROOT, "6s")]),
        rules([("either", "4s"), ("port-scan", "8s"), ("port-scan", "8s")], extra=(both,)),
    ]
    data, t = [], 0
    for i in range(500):
        t += rnd.choice((0, 0, 1, 2, 5)) * S
        data.append((i, t, rnd.choice(names), rnd.randint(1, 3), rnd.randint(0, 3)))
    events = spark.createDataFrame(data, "seq_no long, ts long, name string, pid long, shard long")
    for snapshot in snapshots:
        matches = match_rules(events, snapshot)
        exact = as_rows(correlate(matches, snapshot, exact=True))
        assert exact and as_rows(correlate(matches, snapshot)) == exact


def test_crowded_shards_go_through_the_state_machine(spark):
    snapshot = rules([("port-scan", "1000s")])
    data = [(i, i * S, ROOT if i < 40 else "port-scan", 1, 0) for i in range(41)]
    events = spark.createDataFrame(data, "seq_no long, ts long, name string, pid long, shard long")
    matches = match_rules(events, snapshot)
    assert correlate(matches, snapshot, most=10).where("type = 'completed'").count() == 10
    assert correlate(matches, snapshot, most=50).where("type = 'completed'").count() == 40
