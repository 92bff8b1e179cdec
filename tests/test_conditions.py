import pytest
from pyspark.sql import functions as F

from emberline.operators.match import match_rules
from emberline.plans.catalog import RuleError, host_catalog
from emberline.plans.conditions import compile_condition
from emberline.plans.regex import translate
from emberline.plans.rules import compile_rules, duration_ns
from emberline.queries import rule_toml, sequence_toml

HOST = host_catalog()


@pytest.mark.parametrize(
    "field, op, value, ok",
    [
        ("process.pid", ">", 100, True),
        ("process.comm", "contains", "bash", True),
        ("process.comm", "regex", "^sshd", True),
        ("process.pid", "in", [1, 2], True),
        ("process.pid", "contains", "123", False),
        ("process.pid", "regex", ".*", False),
        ("process.comm", ">", 10, False),
        ("process.pid", "==", "123", False),
        ("process.comm", "==", 123, False),
        ("process.pid", "in", ["1", "2"], False),
        ("process.comm", "in", [1, 2], False),
        ("network.daddr", "==", "192.168.1.100", True),
        ("network.daddr", "in", ["192.168.1.100", "10.0.0.1"], True),
        ("network.daddr", "not_in", ["192.168.1.100"], True),
        ("network.daddr", "==", "999.999.999.999", False),
        ("network.daddr", "in", ["192.168.1.100", "not-an-ip"], False),
        ("process.comm", "==", "1.2.3.4", False),
        ("process.pid", "in", 5, False),
        ("process.pid", "in", [], False),
        ("process.pid", "in", [1, "a"], False),
        ("process.pid", "==", 1.5, False),
        ("process.pid", "exists", False, True),
        ("process.comm", "starts_with", 7, True),
        ("process.pid", "bit_and", 4, True),
        ("process.comm", "not_regex", "a", False),
        ("process.nothing", "==", 1, False),
        ("any.tamper.severity", ">=", 3, True),
        ("process.comm", "regex", "(?=a)", False),
        ("process.comm", "regex", "[", False),
    ],
)
def test_compiles(field, op, value, ok):
    if ok:
        compile_condition(field, op, value, HOST)
    else:
        with pytest.raises(RuleError):
            compile_condition(field, op, value, HOST)


def test_literal_value():
    assert compile_condition("network.daddr", "==", "192.168.1.100", HOST).literal.value == 3232235876
    assert compile_condition("process.comm", "in", ["a", "1.2.3.4", "b"], HOST).literal.value == ("a", "b")


def events(spark, *rows):
    schema = "seq_no long, kind string, ts long, cgroup_id long, mnt_ns long, pid long, tgid long, uid long, comm string, parent_comm string, filepath string, port long, family long, op long, filename string, daddr long"
    names = [c.split()[0] for c in schema.split(", ")]
    base = {"ts": 0, "cgroup_id": 0, "mnt_ns": 0, "pid": 1, "tgid": 1, "uid": 0, "comm": "bash", "parent_comm": "bash"}
    return spark.createDataFrame([tuple(({"seq_no": i} | base | r).get(n) for n in names) for i, r in enumerate(rows)], schema)


def small_host():
    """The host catalogue without fields whose columns these rows lack."""
    c = host_catalog()
    keep = {"process.pid", "process.uid", "process.tgid", "process.comm", "process.parent.comm", "process.filepath", "socket.port", "socket.op", "inode.op", "inode.filename", "network.daddr"}
    c.fields = {k: v for k, v in c.fields.items() if k in keep}
    return c


def matched(spark, conditions, *rows):
    snapshot = compile_rules([rule_toml("r", conditions)], small_host())
    return sorted(r["seq_no"] for r in match_rules(events(spark, *rows), snapshot).collect())


def test_absent_field_is_false_for_every_operator(spark):
    rows = ({"kind": "Generic"}, {"kind": "Bprm", "filepath": "/tmp/x"}, {"kind": "Bprm", "filepath": ""})
    for op, value, want in [("!=", "/bin/sh", [1, 2]), ("not_in", ["/bin/sh"], [1, 2]), ("exists", True, [1, 2]), ("exists", False, [1, 2]), ("contains", "tmp", [1]), ("starts_with", "/", [1]), ("regex", "^$", [2]), ("==", "", [2])]:
        assert matched(spark, [("process.filepath", op, value)], *rows) == want, op


def test_shared_column_belongs_to_its_kind(spark):
    rows = ({"kind": "Socket", "op": 1}, {"kind": "Inode", "op": 1})
    assert matched(spark, [("socket.op", "==", 1)], *rows) == [0]
    assert matched(spark, [("inode.op", "==", 1)], *rows) == [1]


def test_int_operators(spark):
    rows = [{"kind": "Generic", "pid": p} for p in (0, 1, 2, 3, 4)]
    for op, value, want in [(">", 2, [3, 4]), (">=", 2, [2, 3, 4]), ("<", 2, [0, 1]), ("<=", 2, [0, 1, 2]), ("bit_and", 6, [2, 3, 4]), ("not_in", [1, 2], [0, 3, 4])]:
        assert matched(spark, [("process.pid", op, value)], *rows) == want


def test_contains_is_literal(spark):
    rows = ({"kind": "Generic", "comm": "a%b"}, {"kind": "Generic", "comm": "axb"})
    assert matched(spark, [("process.comm", "contains", "%")], *rows) == [0]


@pytest.mark.parametrize("pattern, text, hit", [("c$", "abc\n", False), ("c$", "abc", True), (r"^\w+$", "été", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False), ("(?P<x>a)b", "ab", True), ("[[:digit:]]x", "7x", True)])
def test_regex_dialect(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "s string").select(F.col("s").rlike(translate(pattern))).first()[0] is hit


def test_conditions_run_cheapest_first():
    text = rule_toml("r", [("process.comm", "regex", "a"), ("process.comm", "contains", "a"), ("process.comm", "==", "a"), ("process.pid", "==", 1), ("process.pid", "in", [1]), ("process.uid", "exists", True)])
    ops = [c.op for c in compile_rules([text], HOST).rules[0].conditions]
    assert ops == ["exists", "eq", "eq", "in", "contains", "regex"]


@pytest.mark.parametrize(
    "code, texts",
    [
        ("DuplicateRuleId", [rule_toml("a", [("process.pid", "==", 1)])] * 2),
        ("RuleWithoutConditions", [rule_toml("a", [])]),
        ("SequenceWithoutSteps", [rule_toml("a", [("process.pid", "==", 1)], tail=sequence_toml("s", []))]),
        ("UnknownSequenceStepRule", [rule_toml("a", [("process.pid", "==", 1)], tail=sequence_toml("s", [("b", "5s")]))]),
        ("ThresholdKindNeedsCount", [rule_toml("a", [("process.pid", "==", 1)], tail=sequence_toml("s", [("a", "5s")], "threshold"))]),
        ("ThresholdTooLow", [rule_toml("a", [("process.pid", "==", 1)], tail=sequence_toml("s", [("a", "5s")], "threshold", more="threshold = 1\n"))]),
        ("ThresholdNeedsSingleStep", [rule_toml("a", [("process.pid", "==", 1)], tail=sequence_toml("s", [("a", "5s"), ("a", "5s")], "threshold", more="threshold = 2\n"))]),
        ("ThresholdOnNonThresholdKind", [rule_toml("a", [("process.pid", "==", 1)], tail=sequence_toml("s", [("a", "5s")], more="threshold = 2\n"))]),
        ("SequenceFinishedTriggerWithoutSequence", [rule_toml("a", [("process.pid", "==", 1)], tail='[rule.response_chain]\ntrigger = "sequence_finished"\nactions = []')]),
        ("InvalidBinding", [rule_toml("a", [("process.pid", "==", 1)], tail='[rule.response_chain]\ntrigger = "rule_match"\n[[rule.response_chain.actions]]\ntype = "block_ip"\nparams = { ip = "$process.pid" }')]),
        ("ExpectedType", [rule_toml("a", [("process.pid", "==", 1)], tail='[rule.response_chain]\ntrigger = "rule_match"\n[[rule.response_chain.actions]]\ntype = "kill_process"\nparams = { pid = "x" }')]),
        ("NoRulesInDir", []),
    ],
)
def test_rule_errors(code, texts):
    with pytest.raises(RuleError) as e:
        compile_rules(texts, HOST)
    assert e.value.code == code


def test_durations():
    assert duration_ns("5s") == 5 * 10**9 and duration_ns("1h 30m") == 5400 * 10**9 and duration_ns("250ms") == 250 * 10**6
    with pytest.raises(RuleError):
        duration_ns("soon")


def test_reload_keeps_good_rules(tmp_path):
    from emberline.sources.rules_dir import RuleDirectory

    (tmp_path / "a.toml").write_text(rule_toml("a", [("process.pid", "==", 1)]))
    rules = RuleDirectory(tmp_path, HOST)
    (tmp_path / "b.toml").write_text("not toml")
    assert [r.id for r in rules.refresh().rules] == ["a"] and rules.last_error and rules.version == 1
    (tmp_path / "b.toml").write_text(rule_toml("b", [("process.pid", "==", 2)]))
    assert [r.id for r in rules.refresh().rules] == ["a", "b"] and rules.version == 2
