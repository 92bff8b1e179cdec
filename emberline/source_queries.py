"""Registered queries of sources, sinks, log records and whole searches, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import names as N
from .functions import text as T
from .operators import budget, listing, patterns, render, retrieval, views
from .operators.match import match_rules, respond
from .operators.rule_checks import check_sets, condition_orders
from .operators.sequence import correlate
from .plans.catalog import host_catalog
from .plans.rules import compile_rules
from .queries import ADDR, MATCHES_SQL, K, case_sql, query, table
from .sources import events as E
from .sources import files as files_
from .sources import sinks
from .sources.shared import checkpoint_dir, cut
from .sources.wire import SIZES, decode_events

# --- wire records ---------------------------------------------------------------------------

_BY_KIND = ("Generic", "Socket", "Module", "InetSock", "Bprm", "BpfProgLoad", "Inode", "BpfMap", "InodeMutate", "PtraceAccessCheck")


def little(value: Column, size: int) -> Column:
    """``size`` bytes of a number, the lowest first."""
    digits = [F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)]
    return F.unhex(F.concat(*digits))


def filled(value: Column, size: int) -> Column:
    return F.rpad(value.cast("binary"), size, bytes([0]))


def wire_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed records made of the benchmark events, as they would lie in a store; every 97th is cut short."""
    u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    addr = F.pmod(u * 2654435761, F.lit(4294967296))
    name = F.concat(F.lit("n"), k.cast("string"))
    nth = F.col("event_id") % 10
    head = [little(F.col("event_id") * 1000, 8), little(u, 8), little(k, 4), little(u + 1000, 4), little(u, 4), little(u, 4), little(u + 7, 4)]
    body = {
        "Generic": [little(k, 4), little(F.lit(3), 2)],
        "Socket": [little(addr, 4), little(k, 2), little(u % 45, 2), little(k % 3, 1)],
        "Module": [filled(name, 56), little(k % 4, 1)],
        "InetSock": [little(k % 14, 4), little((k + 1) % 14, 4), little(addr, 4), little(addr + 1, 4), little(k, 2), little(k + 1, 2), little(F.when(k % 2 == 0, 6).otherwise(17), 2)],
        "Bprm": [filled(F.concat(F.lit("/bin/"), name), 128), little(F.length(name) + 5, 4)],
        "BpfProgLoad": [little(k % 40, 4), little(k % 60, 4), little(k % 16, 4), filled(F.lit("tag"), 8)],
        "Inode": [filled(name, 64), little(F.length(name), 4), little(k % 4, 1)],
        "BpfMap": [filled(name, 64), little(k, 4), little(k % 40, 4)],
        "InodeMutate": [filled(F.concat(F.lit("new-"), name), 64), filled(name, 64), little(F.length(name) + 4, 4), little(F.length(name), 4), little(k % 4, 1)],
        "PtraceAccessCheck": [little(u, 4), little(u + 1, 4), little(u + 2, 4), little(k, 4), little(k % 3, 1), filled(name, 16)],
    }
    raw = None
    for i, kind in enumerate(_BY_KIND):
        codes, size = SIZES[kind]
        whole = filled(F.concat(*head, little(F.lit(codes[0]), 1), filled(F.col("event_type"), 16), filled(F.lit("parent"), 16), little(F.lit(0), 3), *body[kind]), size)
        raw = F.when(nth == i, whole) if raw is None else raw.when(nth == i, whole)
    return cut(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 97 == 0, F.substring(raw, 1, 60)).otherwise(raw).alias("raw")))


_SWAP = "((({0}) & 255) << 24) | (((({0}) >> 8) & 255) << 16) | (((({0}) >> 16) & 255) << 8) | (({0}) >> 24)"
_WIRE_FIELDS = "name meta addr port family op module_name old_state new_state saddr daddr sport dport protocol filepath path_len prog_type attach_type flags tag filename filename_len map_name map_id map_type new_filename old_filename mutation target_pid target_tgid target_uid mode stage target_comm".split()
_WIRE_SQL = [
    "concat_ws('|', 'KILL', k)",
    f"concat_ws('|', {_SWAP.format('a')}, (k & 255) * 256 + (k >> 8), u % 45, k % 3)",
    "concat_ws('|', k % 4, 'n' || k)",
    f"concat_ws('|', {case_sql('k % 14', N.TCP_STATES)}, {case_sql('(k + 1) % 14', N.TCP_STATES)}, {_SWAP.format('a')}, {_SWAP.format('a + 1')}, k, k + 1, CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END)",
    "concat_ws('|', '/bin/n' || k, length('n' || k) + 5)",
    "concat_ws('|', k % 40, k % 60, k % 16, 'tag')",
    "concat_ws('|', k % 4, 'n' || k, length('n' || k))",
    f"concat_ws('|', 'n' || k, k, {case_sql('k % 40', N.BPF_MAP_TYPES)})",
    "concat_ws('|', 'new-n' || k, 'n' || k, k % 4)",
    "concat_ws('|', u, u + 1, u + 2, k, k % 3, 'n' || k)",
]


@query(
    f"""SELECT event_id, CASE event_id % 10 {" ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(_BY_KIND))} END AS kind, event_id * 1000 AS ts, u AS cgroup_id, k AS mnt_ns, u + 1000 AS pid, u AS ppid, u + 7 AS tgid,
  event_type AS comm, 'parent' AS parent_comm, CASE event_id % 10 {" ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(_WIRE_SQL))} END AS fields
  FROM (SELECT event_id, event_type, user_id AS u, {K} AS k, {ADDR} AS a FROM events WHERE event_id % 97 <> 0)"""
)
def wire_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all ten kinds from packed bytes, without those that are too short."""
    out = decode_events(wire_records(spark, sf_dir), keep=("event_id",))
    return out.select("event_id", "kind", "ts", "cgroup_id", "mnt_ns", "pid", "ppid", "tgid", "comm", "parent_comm", F.concat_ws("|", *[F.col(c).cast("string") for c in _WIRE_FIELDS]).alias("fields"))


_SNAKE = {"bprm_check": "Bprm", "socket_connect": "Socket", "inet_sock_set_state": "InetSock", "inode_unlink": "Inode", "inode_rename": "InodeMutate", "bpf_map": "BpfMap"}
_HOOK_AT = list(_SNAKE)


def hooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hook calls made of the benchmark events, with what the hooks look at."""
    c, k = F.col, F.get_json_object("props", "$.k").cast("long")
    hook = F.get(F.array(*[F.lit(h) for h in _HOOK_AT]), (c("event_id") % len(_HOOK_AT)).cast("int"))
    some = lambda n, text: F.when(k % n != 0, F.lit(text))
    return E.read_events(spark, f"{sf_dir}/events.parquet").select(
        "event_id", hook.alias("hook"), N.name_of(hook, _SNAKE).alias("kind"), F.when(k % 7 != 0, k).alias("addr"), (k % 3).alias("ret"), (k % 4).alias("family"), F.when(k % 2 == 0, 6).otherwise(17).alias("proto"),
        some(5, "/bin/x").alias("filepath"), some(3, "f").alias("filename"), some(3, "old").alias("old_filename"), some(4, "new").alias("new_filename"),
    )


@query(
    f"""SELECT event_id, hook FROM (SELECT event_id, {K} AS k, ['{"', '".join(_HOOK_AT)}'][event_id % {len(_HOOK_AT)} + 1] AS hook FROM events) WHERE hook <> 'bpf_map' AND CASE hook
  WHEN 'socket_connect' THEN k % 7 <> 0 AND k % 3 = 0 AND k % 4 = 2 WHEN 'inet_sock_set_state' THEN k % 2 = 0 WHEN 'bprm_check' THEN k % 5 <> 0
  WHEN 'inode_unlink' THEN k % 3 <> 0 WHEN 'inode_rename' THEN k % 3 <> 0 AND k % 4 <> 0 ELSE true END"""
)
def hook_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the hooks that are on, as far as the hooks let them through."""
    on = [h for h in E.HOOKS if h != "bpf_map"]
    return E.from_enabled_hooks(hooked(spark, sf_dir), on).where(E.hook_conditions()).select("event_id", "hook")


@query(f"SELECT event_id, (k & 1) | (CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END) | (CASE WHEN k % 5 = 0 THEN 4 ELSE 0 END) | (CASE WHEN k % 7 = 0 THEN 8 ELSE 0 END) AS flags FROM (SELECT event_id, {K} AS k FROM events)")
def packed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", E.packed_prog_flags(k % 2 == 1, k % 3 == 0, k % 5 == 0, k % 7 == 0).cast("long").alias("flags"))


def tamper_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ts"), F.when(F.col("user_id") % 9 != 0, F.col("user_id") % 8 - 1).cast("int").alias("severity"), F.when(k % 5 != 0, k % 6 - 1).cast("int").alias("kind"), F.when(k % 3 != 0, k).alias("pid"), F.when(k % 2 == 0, k * 100).alias("age_ms"), F.concat(F.lit("r"), k.cast("string")).alias("reason"))


_TAMPER = f"""SELECT event_id AS ts, CASE WHEN user_id % 9 <> 0 THEN user_id % 8 - 1 END AS severity, coalesce(CASE WHEN k % 5 <> 0 THEN k % 6 - 1 END, 0) AS kind,
  coalesce(CASE WHEN k % 3 <> 0 THEN k END, 0) AS pid, coalesce(CASE WHEN k % 2 = 0 THEN k * 100 END, 0) AS age_ms, 'r' || k AS reason FROM (SELECT *, {K} AS k FROM events)"""


@query(
    f"""SELECT ts, '[TAMPER] SRC:watchdog | SEV:' || {case_sql('severity', N.TAMPER_SEVERITIES, '?')} || ' | REASON:' || reason || CASE WHEN age_ms > 0 THEN ' | AGE_MS:' || age_ms ELSE '' END || ' | PID:' || pid AS line
  FROM ({_TAMPER}) WHERE severity BETWEEN 0 AND 5 AND kind BETWEEN 0 AND 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'click'"""
)
def tamper_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tamper messages as events, in one stream with other events, as text."""
    other = Q.host_rows(spark, sf_dir).where("comm = 'click'").withColumn("kind", F.lit("None")).withColumn("ts", F.col("event_id")).drop("event_id")
    both = E.with_tampering(other, E.tamper_events(tamper_messages(spark, sf_dir)))
    return both.select("ts", render.render_event().alias("line"))


_OTHER_KINDS = ("Module", "PtraceAccessCheck", "InodeMutate", "BpfProgLoad", "BpfMap")


@query(
    f"""SELECT event_id, CASE event_id % 5
  WHEN 0 THEN '[MODULE_' || {case_sql('k % 4', N.MODULE_OPS)} || '] ' || {Q._HEAD_SQL} || ' | MODULE:n' || k
  WHEN 1 THEN '[PTRACE_' || {case_sql('k % 3', N.PTRACE_STAGES)} || '] ' || {Q._HEAD_SQL} || ' -> TARGET_PID:' || user_id || ' | TARGET_TGID:' || (user_id + 1) || ' | TARGET_UID:' || (user_id + 2) || ' | TARGET_COMM:n' || k || ' | MODE:0x' || lower(to_hex(k))
  WHEN 2 THEN '[INODE_' || {case_sql('k % 4', N.INODE_MUTATIONS)} || '] ' || {Q._HEAD_SQL} || ' | OLD:n' || k || ' | NEW:new-n' || k
  WHEN 3 THEN '[BPF_PROG_LOAD] UID:' || user_id || ' | PID:' || (user_id + 1000) || ' | CMD:' || event_type || ' | TYPE:' || {case_sql('k % 40', N.BPF_PROG_TYPES)} || ' | ATTACH:' || {case_sql('k % 60', N.BPF_ATTACH_TYPES)} || ' | FLAGS:' || concat_ws(',', {', '.join(f"CASE WHEN (k & {b}) <> 0 THEN '{n}' END" for b, n in N.PROG_FLAGS)})
  ELSE '[BPF_MAP] UID:' || user_id || ' | PID:' || (user_id + 1000) || ' | CMD:' || event_type || ' | NAME:n' || k || ' | TYPE:' || {case_sql('k % 40', N.BPF_MAP_TYPES)} || ' | ID:' || k
  END AS line FROM (SELECT *, {K} AS k FROM events)"""
)
def event_render_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of events that ``event_render`` has not."""
    k, u = F.col("meta"), F.col("uid")
    name = F.concat(F.lit("n"), k.cast("string"))
    rows = Q.host_rows(spark, sf_dir).withColumns({
        "kind": F.get(F.array(*[F.lit(x) for x in _OTHER_KINDS]), (F.col("event_id") % 5).cast("int")), "module_name": name, "op": k % 4, "stage": (k % 3).cast("int"), "target_pid": u, "target_tgid": u + 1, "target_uid": u + 2, "target_comm": name, "mode": k,
        "mutation": (k % 4).cast("int"), "old_filename": name, "new_filename": F.concat(F.lit("new-"), name), "prog_type": (k % 40).cast("int"), "attach_type": (k % 60).cast("int"), "flags": k, "map_name": name, "map_type": N.name_of((k % 40).cast("int"), N.BPF_MAP_TYPES), "map_id": k})
    return rows.select("event_id", render.render_event().alias("line"))


@query(f"""SELECT event_id, 'host-' || event_id % 10 AS rule_id FROM (SELECT event_id, user_id AS u, {K} AS k, {ADDR} AS a FROM events WHERE event_id % 97 <> 0) WHERE CASE event_id % 10
  WHEN 1 THEN k % 3 = 1 AND (k & 255) * 256 + (k >> 8) > 100 WHEN 2 THEN starts_with('n' || k, 'n1') WHEN 3 THEN k % 2 = 0 AND k >= 20 WHEN 4 THEN contains('/bin/n' || k, '5') WHEN 5 THEN k % 16 & 4 <> 0
  WHEN 6 THEN k % 4 IN (0, 2) WHEN 7 THEN k > 50 WHEN 8 THEN k % 4 <> 1 WHEN 9 THEN k >= 90 ELSE false END""")  # fmt: skip
def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the host catalogue over decoded records."""
    rules = {
        1: [("socket.op", "==", 1), ("socket.port", ">", 100)],
        2: [("module.name", "starts_with", "n1")],
        3: [("network.protocol", "==", "TCP"), ("network.sport", ">=", 20)],
        4: [("process.filepath", "contains", "5")],
        5: [("bpf.prog.flags", "bit_and", 4)],
        6: [("inode.op", "in", [0, 2])],
        7: [("bpf.map.id", ">", 50)],
        8: [("inode.mutation.type", "not_equals", 1)],
        9: [("ptrace.mode", "gte", 90)],
    }
    c = host_catalog()
    catalog = type(c)(list(c.fields.values()), c.kind_column, ("mnt_ns", "cgroup_id"), ("event_id",), c.kinds, c.suffixes, c.meta)
    snapshot = compile_rules([Q.rule_toml(f"host-{i}", conditions) for i, conditions in rules.items()], catalog)
    return match_rules(decode_events(wire_records(spark, sf_dir), keep=("event_id",)), snapshot).select("event_id", "rule_id")


# --- rules that do not compile ----------------------------------------------------------------

_GOOD = [("event.value", ">", 1)]
_CASES = {
    "unknown field": (Q.rule_toml("r", [("no.such", "==", 1)]), "UnknownField"),
    "unknown operator": (Q.rule_toml("r", [("event.value", "like", 1)]), "UnknownOp"),
    "no conditions": (Q.rule_toml("r", []), "RuleWithoutConditions"),
    "text for a number": (Q.rule_toml("r", [("event.value", "==", "1")]), "InvalidFieldValue"),
    "number for a text": (Q.rule_toml("r", [("event.type", "==", 1)]), "InvalidFieldValue"),
    "order of texts": (Q.rule_toml("r", [("event.type", ">", 1)]), "InvalidFieldValue"),
    "texts in numbers": (Q.rule_toml("r", [("event.value", "in", ["1"])]), "InvalidFieldValue"),
    "empty set": (Q.rule_toml("r", [("event.value", "in", [])]), "InvalidFieldValue"),
    "bad address": (Q.rule_toml("r", [("net.addr", "==", "999.1.1.1")]), "InvalidFieldValue"),
    "bad regex": (Q.rule_toml("r", [("event.type", "regex", "(")]), "InvalidRegex"),
    "regex of a number": (Q.rule_toml("r", [("event.type", "regex", 1)]), "InvalidRegex"),
    "broken file": ("[rule", "TomlDe"),
    "sequence_finished alone": (Q.rule_toml("r", _GOOD, tail=Q.CHAIN % "sequence_finished"), "SequenceFinishedTriggerWithoutSequence"),
    "threshold without count": (Q.rule_toml("r", _GOOD, tail=Q.sequence_toml("s", [("r", "1s")], "threshold")), "ThresholdKindNeedsCount"),
    "threshold of one": (Q.rule_toml("r", _GOOD, tail=Q.sequence_toml("s", [("r", "1s")], "threshold", more="threshold = 1\n")), "ThresholdTooLow"),
    "threshold of two steps": (Q.rule_toml("r", _GOOD, tail=Q.sequence_toml("s", [("r", "1s"), ("r", "1s")], "threshold", more="threshold = 2\n")), "ThresholdNeedsSingleStep"),
    "threshold of a rule sequence": (Q.rule_toml("r", _GOOD, tail=Q.sequence_toml("s", [("r", "1s")], more="threshold = 2\n")), "ThresholdOnNonThresholdKind"),
    "sequence without steps": (Q.rule_toml("r", _GOOD, tail=Q.sequence_toml("s", [])), "SequenceWithoutSteps"),
    "unknown step": (Q.rule_toml("r", _GOOD, tail=Q.sequence_toml("s", [("gone", "1s")])), "UnknownSequenceStepRule"),
    "action of another type": (Q.rule_toml("r", _GOOD, tail=(Q.CHAIN % "rule_match").replace("$user.id", "$event.type")), "InvalidBinding"),
    "good": (Q.rule_toml("r", _GOOD), ""),
}
_SETS = {
    "same rule twice": ([Q.rule_toml("r", _GOOD)] * 2, "DuplicateRuleId"),
    "same sequence twice": ([Q.rule_toml(r, _GOOD, tail=Q.sequence_toml("s", [("a", "1s")])) for r in "ab"], "DuplicateSequenceId"),
    "empty set of rules": ([], "NoRulesInDir"),
}


#: Every case as a set of rules; a rule's number is that of the row's value, its text that of the row's type.
_RULE_SETS = [([text], want) for text, want in _CASES.values()] + list(_SETS.values())


def rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, texts``: a set of rules for each event, with numbers of the event in its conditions."""
    cases = F.array(*[F.array(*[F.lit(t) for t in texts]).cast("array<string>") for texts, _ in _RULE_SETS])
    chosen = F.get(cases, (F.col("event_id") % len(_RULE_SETS)).cast("int"))
    number = F.concat(F.lit("value = "), F.floor("value").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "events").select("event_id", F.transform(chosen, lambda t: F.replace(t, F.lit("value = 1\n"), number)).alias("texts"))


@query("SELECT event_id, [" + ", ".join(f"'{want}'" for _, want in _RULE_SETS) + f"][event_id % {len(_RULE_SETS)} + 1] AS code FROM events")
def compile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each event's set of rules: every case that must not compile, and a good one."""
    return check_sets(rule_sets(spark, sf_dir), Q.bench_catalog()).select("event_id", "code")


#: Conditions as they are written, with what testing them costs.
_WRITTEN = [("event.props", "regex", "a", 7), ("event.props", "contains", "a", 6), ("event.props", "starts_with", "a", 5), ("user.id", "in", [1], 3), ("event.type", "==", "x", 2), ("event.value", ">", 1, 1), ("user.id", "==", 1, 1), ("event.id", "exists", True, 0)]
_OP_NAMES = {"==": "eq", ">": "gt"}
_OPS_SQL = ", ".join(f"{{'cost': {cost}, 'op': '{_OP_NAMES.get(op, op)} {field}'}}" for field, op, _, cost in _WRITTEN)


@query(f"""SELECT event_id, string_agg(o.op, ', ' ORDER BY o.cost, nth) AS ops FROM
  (SELECT event_id, unnest(l) AS o, generate_subscripts(l, 1) AS nth FROM (SELECT event_id, list_concat(c[k + 1 :], c[: k]) AS l FROM (SELECT event_id, {K} % 8 AS k, [{_OPS_SQL}] AS c FROM events))) GROUP BY event_id""")
def condition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which each event's rule tests its conditions: cheap ones first, else as they are written."""
    turned = [[c[:3] for c in _WRITTEN[k:] + _WRITTEN[:k]] for k in range(len(_WRITTEN))]
    texts = F.array(*[F.lit(Q.rule_toml("r", conditions)) for conditions in turned])
    k = F.get_json_object("props", "$.k").cast("int")
    rules = table(spark, sf_dir, "events").select("event_id", F.get(texts, k % len(_WRITTEN)).alias("text"))
    return condition_orders(rules, Q.bench_catalog()).select("event_id", F.array_join("ops", ", ").alias("ops"))


# --- files ------------------------------------------------------------------------------------

_FILE = "CASE event_id % 8 WHEN 0 THEN 'a' || user_id || '.rs' WHEN 1 THEN 'src/x' || user_id || '.rs' WHEN 2 THEN 'src/target/x.rs' WHEN 3 THEN 'docs/x.md' WHEN 4 THEN 'docs/old/x.md' WHEN 5 THEN 'src/x.bin' WHEN 6 THEN 'other/x.rs' ELSE 'src/Makefile' END"


@query(f"SELECT event_id, event_id % 8 IN (0, 1, 3, 7) AS indexed FROM (SELECT event_id, {_FILE} AS path FROM events)")
def files_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(_FILE)
    return table(spark, sf_dir, "events").select("event_id", files_.should_index(path, [".rs", ".md"], ["Makefile"], ["target"], ["docs/old/"], ["src/", "docs/"]).alias("indexed"))


@query(f"SELECT path, count(*) AS n FROM (SELECT {_FILE} AS path FROM events) WHERE ends_with(path, '.rs') AND (starts_with(path, 'src/') OR starts_with(path, 'other/')) AND NOT contains(path, '/target/') GROUP BY path")
def files_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.expr(_FILE).alias("path"))
    return files_.find_files(rows, ".rs", ["src/", "other/"], ["target"]).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'd' || doc_id % 7 || '/f' || doc_id || '.txt' AS path, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files of a tree and read as one scan of it."""
    base = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    path = F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files_.write_files(docs.select(path.alias("path"), "text"), base)
    return files_.read_files(spark, base, "*.txt").select("path", F.length(F.regexp_replace("text", "\\n\\z", "")).cast("long").alias("n"))


# --- sinks ------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("file"), F.when(F.col("doc_id") % 3 == 0, F.lit("pattern")).otherwise(F.lit("code_chunk")).alias("type"), F.length("text").cast("long").alias("n"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE length(text) END::BIGINT AS n FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 4 = 0")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("id", "n")
    return sinks.upsert(rows.where("id % 5 <> 0"), rows.where("id % 4 = 0").withColumn("n", F.lit(-1).cast("long")))


@query("SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 50 = 7 AND doc_id % 3 <> 0) AND doc_id % 11 <> 0")
def sink_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the code chunks of one file, and without listed ids."""
    rows = points(spark, sf_dir)
    return sinks.delete_ids(sinks.delete_file(rows, "f7"), rows.where("id % 11 = 0")).select("id")


@query("SELECT 'p' || doc_id AS path, md5(text) AS hash FROM documents")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an index, saved and loaded; a state that is not there is empty."""
    base = f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    sinks.save_state(table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("hash")), base)
    return sinks.load_state(spark, base).unionByName(sinks.load_state(spark, f"{base}-none"))


@query("SELECT text AS document, 2 * count(*) AS n, 2 * count(*) AS ids FROM documents GROUP BY text")
def notes_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notes inserted twice: every one has an id of its own."""
    base = f"{checkpoint_dir(spark)}/notes-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.insert_notes(sinks.note_rows(table(spark, sf_dir, "documents")), base)
    return spark.read.parquet(base).groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("SELECT s AS step, CASE WHEN s = 'emptied' THEN 0 ELSE (SELECT count(*) FROM documents) END AS n, CASE WHEN s = 'emptied' THEN 0 ELSE (SELECT coalesce(sum(length(text)), 0) FROM documents) END::BIGINT AS chars FROM (VALUES ('filled'), ('kept'), ('emptied'), ('filled again')) t(s)")
def collection_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of all documents: created and filled, asked for again, made anew, filled again."""
    name, rows = f"points_{uuid.uuid4().hex}", table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("document"))
    schema, seen = "id bigint, document string", None
    try:
        for step, recreate, fill in (("filled", False, True), ("kept", False, False), ("emptied", True, False), ("filled again", False, True)):
            sinks.ensure_table(spark, name, schema, recreate)
            if fill:
                rows.write.insertInto(name)
            own = cut(spark.table(name).agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("document")), F.lit(0)).cast("long").alias("chars")))
            seen = own if seen is None else seen.unionByName(own)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return seen


@query(f"SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, rule_id, count(*) AS n FROM ({MATCHES_SQL}) GROUP BY ALL")
def log_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as JSON lines in one folder an hour, read back."""
    base = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    sinks.write_log(Q.ruleset_rows(spark, sf_dir).select("ts", "rule_id"), base, "ts")
    return spark.read.schema("rule_id string, hour string").json(base).groupBy("hour", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, 'INFO' AS level, json_object('event.kind', 'rule_match', 'rule.id', rule_id, 'rule.severity', severity, 'process.uid', user_id, 'process.pid', user_id, 'process.comm', event_type)::VARCHAR AS fields FROM (%s)""" % MATCHES_SQL)
def log_match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.match_records(Q.ruleset_rows(spark, sf_dir), ("event_id",))


@query(f"""{Q._THREE} SELECT root_event, 'DEBUG' AS level, '{{"event":"correlation_step"}}' AS fields FROM s1 UNION ALL SELECT root_event, 'DEBUG', '{{"event":"correlation_step"}}' FROM s2
  UNION ALL SELECT root_event, 'WARN', json_object('event.kind', 'correlation', 'correlation.root_rule_id', 'root', 'correlation.seq_id', 's', 'correlation.path', 'look->buy', 'correlation.steps', 2)::VARCHAR FROM s2""")
def log_correlation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = Q.three_step()
    out = correlate(match_rules(table(spark, sf_dir, "events"), snapshot), snapshot).withColumn("root_event", Q.event_no("root_order"))
    return listing.correlation_records(out, ("root_event",))


@query(f"""SELECT event_id, '[RESPONSE] rule=root action=kill_process:' || user_id || ',block_ip:' || {ADDR} AS alert, 'WARN' AS level,
  json_object('event.kind', 'response', 'rule.id', 'root', 'response.action', '[{{"kind":"kill_process","pid":' || user_id || '}},{{"kind":"block_ip","ip":' || {ADDR} || '}}]')::VARCHAR AS fields FROM events WHERE {Q._ROOT}""")
def response_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = Q.bench(Q.rule_toml("root", Q.CLICK, "high", Q.CHAIN % "rule_match"))
    rows = respond(match_rules(table(spark, sf_dir, "events"), snapshot, keep=("value", "props")), snapshot, "rule_match")
    return listing.response_records(rows.withColumn("alert", render.response_alert()), ("event_id", "alert"))


@query(f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'Done' ELSE 'Failed' END AS status, event_type = 'view' AS success FROM events WHERE {K} < 50""")
def failed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response whose parameter some rows lack: nothing of it counts as done there."""
    c = Q.bench_catalog()
    part = Q.FieldCatalog([*c.fields.values(), type(next(iter(c.fields.values())))("view.user", "int", "user_id", frozenset({"view"}))], c.kind_column, c.shard, c.order, meta=c.meta)
    chain = '\n[rule.response_chain]\ntrigger = "rule_match"\n[[rule.response_chain.actions]]\ntype = "kill_process"\nparams = { pid = "$view.user" }\n'
    snapshot = Q.bench(Q.rule_toml("root", [("props.k", "<", 50)], "high", chain), catalog=part)
    return respond(match_rules(table(spark, sf_dir, "events"), snapshot, keep=("value", "props")), snapshot, "rule_match").select("event_id", "status", "success")


# --- counters ---------------------------------------------------------------------------------


@query("SELECT count(*) AS rows_seen, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE lang = 'en') AS english FROM documents")
def read_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that are filled in while the table is read once."""
    df, seen = views.pipeline_stats(table(spark, sf_dir, "documents"), "stats", rows_seen=F.count(F.lit(1)), chars=F.sum("n_chars"), english=F.count_if(F.col("lang") == "en"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[k] for k in ("rows_seen", "chars", "english"))], "rows_seen long, chars long, english long")


# --- search ---------------------------------------------------------------------------------------


def search_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector, and the fields that a search can ask for."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    doc = F.col("doc_id")
    named = docs.select(
        doc.alias("id"), F.when(doc % 3 == 0, F.lit("pattern")).otherwise(F.lit("code_chunk")).alias("type"), F.concat(F.lit("ws/kernel/f"), (doc % 20).cast("string"), F.lit(".rs")).alias("file"), F.col("lang").alias("subsystem"), F.col("source").alias("crate"),
        F.when(doc % 2 == 0, F.lit("function")).otherwise(F.lit("struct")).alias("kind"), F.array(F.concat(F.lit("s"), (doc % 4).cast("string")), F.concat(F.lit("s"), (doc % 6).cast("string"))).alias("declared"), (doc % 5 == 0).alias("is_test"))
    return named.join(vectors.select(F.col("vec_id").alias("id"), "embedding"), "id")


@query("SELECT doc_id AS id FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 3 <> 0 AND contains('ws/kernel/f' || doc_id % 20 || '.rs', '/f1') AND lang = 'en' AND doc_id % 2 = 0 AND (doc_id % 4 = 0 OR doc_id % 6 = 0) AND doc_id % 5 <> 0 ORDER BY 1")
def payload_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conditions of a search at once."""
    conditions = retrieval.payload_filter("code_chunk", "/f1", "en", None, "function", ["s0"], True)
    return retrieval.scroll(search_points(spark, sf_dir), conditions).select("id")


_ALLOWED = "SELECT doc_id FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'en' AND doc_id % 5 <> 0"
_HYBRID = f"""{Q._WEIGHTS}, d AS (SELECT vec_id AS id, 0 AS leg, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({Q._SCORES}) WHERE vec_id IN ({_ALLOWED}) QUALIFY rank <= 40),
  s AS (SELECT doc_id AS id, 1 AS leg, row_number() OVER (ORDER BY sum(weight) DESC, doc_id) AS rank FROM weights WHERE term IN {Q._TERMS} AND doc_id IN ({_ALLOWED}) GROUP BY doc_id QUALIFY rank <= 40),
  f AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min(leg * 1000 + rank) AS first FROM (SELECT * FROM d UNION ALL SELECT * FROM s) GROUP BY id),
  hybrid AS (SELECT id, score, first FROM f ORDER BY f.score DESC, first LIMIT 15)"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = retrieval.payload_filter(subsystem="en", exclude_tests=True)
    weights = retrieval.term_weights(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), only=Q._TERMS)
    return retrieval.hybrid_search(search_points(spark, sf_dir), weights, Q.query_vector(spark, sf_dir), retrieval.query_terms(spark, " ".join(Q._TERMS)), 15, conditions, "id", "embedding")


@query(f"WITH {_HYBRID} SELECT id, round(score, 6) AS score FROM hybrid")
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_HYBRID}, code AS (SELECT id, 0 AS leg, row_number() OVER (ORDER BY score DESC, id) AS rank FROM hybrid), notes AS (SELECT vec_id + 1000000 AS id, 1 AS leg, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({Q._SCORES}) WHERE label = 3 QUALIFY rank <= 15)
  SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM code UNION ALL SELECT * FROM notes) GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, min(leg * 1000 + rank) LIMIT 10""")
def search_code_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections searched apart and fused once more."""
    notes = Q.dense(spark, sf_dir, (F.col("label") == 3,), 15).select((F.col("vec_id") + 1000000).alias("id"), "score")
    return retrieval.merged_search(hybrid(spark, sf_dir).select("id", "score"), notes, 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_HYBRID} SELECT id, round(score, 6) AS score FROM hybrid ORDER BY hybrid.score DESC, id LIMIT 10")
def search_without_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = hybrid(spark, sf_dir).select("id", "score")
    return retrieval.merged_search(code, code.where("id < 0"), 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT user_id, event_id, rank FROM ({Q._RANKED}) WHERE rank <= 3")
def lookup_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup shows three results whatever was asked for."""
    return budget.within_limit(Q.ranked(spark, sf_dir), "lookup").select("user_id", "event_id", "rank")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all types, made of documents."""
    doc = F.col("doc_id")
    types = F.array(*[F.lit(t) for t in ("code_chunk", "pattern", "mcp_stored", "other")])
    missing = F.when(doc % 8 != 0, F.col("source"))
    return table(spark, sf_dir, "documents").select(
        doc.alias("rank"), ((doc % 97) / 64).alias("score"), F.get(types, (doc % 4).cast("int")).alias("type"), missing.alias("file"), (doc % 9).alias("chunk_index"), F.when(doc % 3 != 0, F.lit(9)).alias("total_chunks"), F.col("lang").alias("language"), F.col("text").alias("document"),
        F.concat(F.lit("p"), doc.cast("string")).alias("pattern_name"), F.lit("why").alias("reason"), F.array(F.lit("x"), F.lit("y")).alias("tags"), F.transform(F.sequence(F.lit(0), doc % 7), lambda i: F.concat(F.lit("f:"), i.cast("string"))).alias("evidence"),
        F.when(doc % 5 != 0, F.lit("kernel")).alias("subsystem"), F.lit(None).cast("string").alias("crate"), F.when(doc % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("symbols"), F.when(doc % 3 == 0, doc).alias("line_start"), F.lit(None).cast("long").alias("line_end"), F.lit("snip").alias("snippet"), F.when(doc % 8 == 2, F.lit("{}")).alias("metadata"))


_PREVIEW = "CASE WHEN length(text) > 140 THEN substr(text, 1, 140) || '…' ELSE text END"


@query(f"""SELECT doc_id AS rank, '  ' || doc_id || '. [' || printf('%.4f', (doc_id % 97) / 64.0) || '] ' || CASE doc_id % 4
  WHEN 0 THEN CASE WHEN doc_id % 8 <> 0 THEN source ELSE '?' END || ' (chunk ' || doc_id % 9 || '/' || CASE WHEN doc_id % 3 <> 0 THEN '9' ELSE '?' END || ', ' || coalesce(lang, '?') || ')' || chr(10) || '     ' || {_PREVIEW}
  WHEN 1 THEN 'PATTERN: p' || doc_id || chr(10) || '     Reason: why' || chr(10) || '     Tags: x, y | Evidence: ' || (doc_id % 7 + 1) || ' hits'
  WHEN 2 THEN 'STORED: ' || {_PREVIEW} ELSE 'type=other' END AS line FROM documents""")
def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_rows(spark, sf_dir).select("rank", listing.listing_line().alias("line"))


@query("""SELECT doc_id AS rank, CASE doc_id % 4
  WHEN 0 THEN 'File: ' || CASE WHEN doc_id % 8 <> 0 THEN source ELSE '?' END || ' | Chunk ' || doc_id % 9 || '/' || CASE WHEN doc_id % 3 <> 0 THEN '9' ELSE '?' END || ' | ' || coalesce(lang, '?')
    || CASE WHEN doc_id % 5 <> 0 THEN chr(10) || 'Subsystem: kernel | Crate: ' ELSE '' END || chr(10) || 'Symbols: a, b' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Lines: ' || doc_id || '–?' ELSE '' END || chr(10) || 'Content:' || chr(10) || text
  WHEN 1 THEN 'Pattern: p' || doc_id || chr(10) || 'Reason: why' || chr(10) || 'Tags: x, y' || chr(10) || 'Snippet: snip' || chr(10) || 'Evidence (' || (doc_id % 7 + 1) || ' hits):' || chr(10) || array_to_string(list_transform(range(0, least(doc_id % 7 + 1, 5)), lambda i: '  - f:' || i || chr(10)), '')
  WHEN 2 THEN 'Stored Information:' || chr(10) || text || chr(10) || 'Metadata:' || chr(10) || CASE WHEN doc_id % 8 = 2 THEN '{}' ELSE '(none)' END ELSE 'Type: other' END AS block FROM documents""")
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_rows(spark, sf_dir).select("rank", listing.answer_block().alias("block"))


_L = "CASE WHEN len(l) > 0 AND l[len(l)] = '' THEN l[1 : len(l) - 1] ELSE l END"


@query(f"""SELECT doc_id, substr(array_to_string(list_concat(l[1 : 5], CASE WHEN n > 8 THEN ['// ... (' || (n - 8) || ' lines omitted)'] ELSE [] END, CASE WHEN n > 5 THEN l[greatest(n - 2, 1) : n] ELSE [] END), chr(10)), 1, 300) AS trimmed,
  substr('f' || doc_id || ':1-? [text] crate=' || coalesce(source, '?') || ' symbols=[a, b]', 1, 30) AS summary
  FROM (SELECT doc_id, source, {_L} AS l, len({_L}) AS n FROM (SELECT doc_id, source, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents))""")
def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    summary = T.metadata_summary(F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.lit(1), F.lit(None), F.lit("text"), F.col("source"), F.array(F.lit("a"), F.lit("b")), F.lit(30))
    return docs.select("doc_id", T.trim_to_signature(F.col("text"), F.lit(300)).alias("trimmed"), summary.alias("summary"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pub(crate) async fn f' || user_id || '(x: u8) -> u8' WHEN 1 THEN 'fn f' || user_id || '()' ELSE '' END AS signature FROM events")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    source = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/// doc\npub(crate) async fn "), name, F.lit("(x: u8) -> u8 {\n  1\n}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("fn "), name, F.lit("();"))).otherwise(F.lit("struct S;"))
    return table(spark, sf_dir, "events").select("event_id", T.signature(source).alias("signature"))


_DIMS = 8


def _hashed_words(texts: list[str]) -> list[list[float]]:
    """A stand-in model over whole texts: words counted by a digest, with a sign of their own."""
    import hashlib
    from functools import lru_cache

    @lru_cache(maxsize=100_000)
    def place(word: str) -> tuple[int, int]:
        digest = hashlib.md5(word.encode()).hexdigest()
        return int(digest[0], 16) % _DIMS, 1 if digest[1] in "02468ace" else -1

    out = []
    for text in texts:
        vector = [0.0] * _DIMS
        for word in text.split(" "):
            at, sign = place(word)
            vector[at] += sign
        out.append(vector)
    return out


_HASHED = f"""WITH w AS (SELECT doc_id, md5(unnest(string_split('q: ' || text, ' '))) AS d FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, (strpos('0123456789abcdef', d[1:1]) - 1) % {_DIMS} AS slot, CASE WHEN strpos('02468ace', d[2:2]) > 0 THEN 1 ELSE -1 END AS s FROM w),
  v AS (SELECT doc_id, {", ".join(f"sum(CASE WHEN slot = {i} THEN s ELSE 0 END)::DOUBLE AS x{i}" for i in range(_DIMS))} FROM p GROUP BY doc_id),
  n AS (SELECT *, greatest(sqrt({" + ".join(f"x{i} * x{i}" for i in range(_DIMS))}), 1e-12) AS norm FROM v)"""


@query(f"{_HASHED} SELECT doc_id, {', '.join(f'round(x{i} / norm, 4) AS x{i}' for i in range(_DIMS))} FROM n")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of whole texts by a model that is called on batches, made unit length."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    out = retrieval.embed(docs, _hashed_words, prefix="q: ")
    return out.select("doc_id", *[F.round(F.get("dense", F.lit(i)).cast("double"), 4).alias(f"x{i}") for i in range(_DIMS)])


@query("SELECT step_event, n FROM (SELECT event_id AS step_event, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 - 1 END AS s, row_number() OVER (ORDER BY coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 - 1 END, 2147483647), event_id) AS n FROM events)")
def correlation_view_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the order of their view: by step, completions last."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_order"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 3 - 1).cast("int")).alias("step_idx"))
    placed = rows.withColumn("place", F.coalesce("step_idx", F.lit(2147483647)))
    return views.response_ids(placed, ["place", "event_order"]).select(F.col("event_order").alias("step_event"), (F.col("id") + 1).alias("n"))


@query("SELECT 'p' || doc_id AS pattern_id FROM documents WHERE doc_id % 4 = 0")
def stale_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the last run that this one has not found."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("pattern_id"))
    return patterns.stale(rows, rows.where("doc_id % 4 <> 0")).select("pattern_id")
