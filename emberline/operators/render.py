"""Text of events, alerts and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.names import ADDRESS_FAMILIES, BPF_ATTACH_TYPES, BPF_PROG_TYPES, INODE_MUTATIONS, INODE_OPS, MODULE_OPS, PTRACE_STAGES, SOCKET_OPS, TAMPER_SEVERITIES, dotted_ip, name_of, prog_flag_names


def _text(template: str, *values: Column) -> Column:
    """``template`` with each ``{}`` replaced by a value."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:]):
        out += [F.coalesce(value.cast("string"), F.lit("")), F.lit(after)]
    return F.concat(*out)


def render_event() -> Column:
    """One line for an event of the wide host table, by its kind."""
    c = F.col
    who = (c("uid"), c("pid"), c("tgid"), c("comm"))
    head = "UID:{} | PID:{} | TGID:{} | CMD:{}"
    age = F.coalesce(c("age_ms"), F.lit(0)) > 0
    severity = name_of(c("tamper_severity"), TAMPER_SEVERITIES, "?")
    return (
        F.when(c("kind") == "Generic", _text("[{}] " + head + " | META:{}", c("name"), *who, c("meta")))
        .when(c("kind") == "Module", _text("[MODULE_{}] " + head + " | MODULE:{}", name_of(c("op"), MODULE_OPS), *who, c("module_name")))
        .when(c("kind") == "Bprm", _text("[EXEC] " + head + " | FILE:{}", *who, c("filepath")))
        .when(
            c("kind") == "PtraceAccessCheck",
            _text("[PTRACE_{}] " + head + " -> TARGET_PID:{} | TARGET_TGID:{} | TARGET_UID:{} | TARGET_COMM:{} | MODE:0x{}", name_of(c("stage"), PTRACE_STAGES), *who, c("target_pid"), c("target_tgid"), c("target_uid"), c("target_comm"), F.lower(F.hex(c("mode")))),
        )
        .when(c("kind") == "Inode", _text("[INODE_{}] " + head + " | FILE:{}", name_of(c("op"), INODE_OPS), *who, c("filename")))
        .when(c("kind") == "InodeMutate", _text("[INODE_{}] " + head + " | OLD:{} | NEW:{}", name_of(c("mutation"), INODE_MUTATIONS), *who, c("old_filename"), c("new_filename")))
        .when(c("kind") == "Socket", _text("[SOCKET_{}] {}:{} | FAMILY:{}", name_of(c("op"), SOCKET_OPS), dotted_ip(c("addr")), c("port"), name_of(c("family"), ADDRESS_FAMILIES, "UNKNOWN_FAMILY")))
        .when(c("kind") == "InetSock", _text("[INET_SOCK] {}:{} -> {}:{} | PROTO:{} | {} -> {}", dotted_ip(c("saddr")), c("sport"), dotted_ip(c("daddr")), c("dport"), c("protocol"), c("old_state"), c("new_state")))
        .when(c("kind") == "BpfProgLoad", _text("[BPF_PROG_LOAD] UID:{} | PID:{} | CMD:{} | TYPE:{} | ATTACH:{} | FLAGS:{}", c("uid"), c("pid"), c("comm"), name_of(c("prog_type"), BPF_PROG_TYPES), name_of(c("attach_type"), BPF_ATTACH_TYPES), prog_flag_names(c("flags"))))
        .when(c("kind") == "BpfMap", _text("[BPF_MAP] UID:{} | PID:{} | CMD:{} | NAME:{} | TYPE:{} | ID:{}", c("uid"), c("pid"), c("comm"), c("map_name"), c("map_type"), c("map_id")))
        .when(
            c("kind") == "Tamper",
            F.when(age, _text("[TAMPER] SRC:{} | SEV:{} | REASON:{} | AGE_MS:{} | PID:{}", c("source"), severity, c("reason"), c("age_ms"), c("pid"))).otherwise(
                _text("[TAMPER] SRC:{} | SEV:{} | REASON:{} | PID:{}", c("source"), severity, c("reason"), c("pid"))
            ),
        )
    )


def match_alert(rule_id: Column, severity: Column, pid: Column, uid: Column) -> Column:
    return _text("[RULE: {}] severity={} (PID: {}, UID: {})", rule_id, severity, pid, uid)


def correlation_alert() -> Column:
    """For rows as ``correlate`` gives them."""
    c = F.col
    step = _text("[CORRELATION] {}::{} step {}/? matched {}", c("root_rule_id"), c("seq_id"), c("step_idx") + 1, c("matched_rule_id"))
    done = _text("[CORRELATION] {}::{} completed ({} steps): {}", c("root_rule_id"), c("seq_id"), c("steps"), F.array_join("path", " → "))
    return F.when(c("type") == "step", step).otherwise(done)


def response_alert() -> Column:
    actions = F.array_join(F.transform("actions", lambda a: F.concat_ws(":", a["kind"], F.coalesce(a["pid"].cast("string"), a["ip"].cast("string"), a["path"]))), ",")
    return _text("[RESPONSE] rule={} action={}", F.col("rule_id"), actions)
