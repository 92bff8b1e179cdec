"""Fields that rules may name: their types, the event kinds that have them, their columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INT, STRING, IP = "int", "string", "ip"


class RuleError(ValueError):
    """A rule, rule set or action that cannot be compiled; ``code`` names the case."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Field:
    """``kinds`` is empty for fields that every kind has."""

    name: str
    type: str
    column: str
    kinds: frozenset[str] = frozenset()

    def value(self, kind_column: str) -> Column:
        """The field of a row: null where its kind lacks it."""
        col = F.expr(self.column)
        return F.when(F.col(kind_column).isin(*sorted(self.kinds)), col) if self.kinds else col


class FieldCatalog:
    """All fields of one kind of event table. ``suffixes`` are fields whose first name part is free."""

    def __init__(self, fields: list[Field], kind_column: str = "kind", shard: tuple[str, ...] = ("mnt_ns", "cgroup_id"), order: tuple[str, ...] = ("ts", "seq_no"), kinds: tuple[str, ...] = (), suffixes: Mapping[str, Field] | None = None, meta: Mapping[str, str] | None = None):
        self.fields = {f.name: f for f in fields}
        self.kind_column, self.shard, self.order, self.kinds = kind_column, shard, order, kinds
        self.suffixes = dict(suffixes or {})
        self.meta = dict(meta or {"uid": "uid", "pid": "pid", "comm": "comm"})

    def find(self, name: str) -> Field:
        if name in self.fields:
            return self.fields[name]
        tail = name.partition(".")[2]
        if tail in self.suffixes:
            return self.suffixes[tail]
        raise RuleError("UnknownField", f"Unknown field '{name}'")

    def kinds_for(self, names: list[str]) -> frozenset[str] | None:
        """The kinds that have all the fields; None where every kind has them."""
        sets = [f.kinds for f in map(self.find, names) if f.kinds]
        return frozenset.intersection(*sets) if sets else None


KINDS = ("Generic", "Bprm", "InetSock", "Socket", "Module", "Inode", "InodeMutate", "PtraceAccessCheck", "BpfProgLoad", "BpfMap", "Tamper")


def host_catalog() -> FieldCatalog:
    """The wide host-event table."""

    def of(kind: str, *entries: tuple[str, str, str]) -> list[Field]:
        return [Field(name, kind_type, column, frozenset({kind})) for name, kind_type, column in entries]

    fields = [
        Field("process.pid", INT, "pid"),
        Field("process.uid", INT, "uid"),
        Field("process.tgid", INT, "tgid"),
        Field("process.comm", STRING, "comm"),
        Field("process.parent.comm", STRING, "parent_comm"),
        *of("Bprm", ("process.filepath", STRING, "filepath")),
        *of("PtraceAccessCheck", ("process.target.pid", INT, "target_pid"), ("process.target.tgid", INT, "target_tgid"), ("process.target.uid", INT, "target_uid"), ("process.target.comm", STRING, "target_comm"), ("ptrace.mode", INT, "mode"), ("ptrace.stage", INT, "stage")),
        *of("InetSock", ("socket.old_state", STRING, "old_state"), ("socket.new_state", STRING, "new_state"), ("network.saddr", IP, "saddr"), ("network.daddr", IP, "daddr"), ("network.sport", INT, "sport"), ("network.dport", INT, "dport"), ("network.protocol", STRING, "protocol")),
        *of("Socket", ("socket.port", INT, "port"), ("socket.family", INT, "family"), ("socket.op", INT, "op")),
        *of("Module", ("module.name", STRING, "module_name"), ("module.op", INT, "op")),
        *of("Inode", ("inode.filename", STRING, "filename"), ("inode.op", INT, "op")),
        *of("InodeMutate", ("inode.old_filename", STRING, "old_filename"), ("inode.new_filename", STRING, "new_filename"), ("inode.mutation.type", INT, "mutation")),
        *of("BpfProgLoad", ("bpf.prog.type", INT, "prog_type"), ("bpf.prog.attach_type", INT, "attach_type"), ("bpf.prog.flags", INT, "flags")),
        *of("BpfMap", ("bpf.map.name", STRING, "map_name"), ("bpf.map.type", STRING, "map_type"), ("bpf.map.id", INT, "map_id")),
    ]
    tamper = of("Tamper", ("tamper.reason", STRING, "reason"), ("tamper.severity", INT, "tamper_severity"), ("tamper.kind", INT, "tamper_kind"))
    return FieldCatalog(fields, kinds=KINDS, suffixes={f.name: f for f in tamper})


def bench_catalog() -> FieldCatalog:
    """The synthetic ``events`` table, each event type standing for a kind."""
    fields = [
        Field("event.id", INT, "event_id"),
        Field("user.id", INT, "user_id"),
        Field("event.value", INT, "cast(floor(value) as bigint)"),
        Field("props.k", INT, "cast(get_json_object(props, '$.k') as bigint)"),
        Field("event.type", STRING, "event_type"),
        Field("event.props", STRING, "props"),
        Field("net.addr", IP, "pmod(user_id * 2654435761, 4294967296)"),
        Field("click.value", INT, "cast(floor(value) as bigint)", frozenset({"click"})),
        Field("purchase.value", INT, "cast(floor(value) as bigint)", frozenset({"purchase"})),
    ]
    return FieldCatalog(fields, "event_type", ("user_id",), ("ts", "event_id"), meta={"uid": "user_id", "pid": "user_id", "comm": "event_type"})


def document_catalog() -> FieldCatalog:
    """``documents`` left-joined with ``labels``: fields that are absent on most rows."""
    fields = [
        Field("doc.id", INT, "doc_id"),
        Field("doc.lang", STRING, "lang"),
        Field("doc.source", STRING, "source"),
        Field("doc.chars", INT, "n_chars"),
        Field("doc.text", STRING, "text"),
        Field("label.quality", INT, "cast(quality as bigint)"),
        Field("label.toxic", INT, "cast(toxic as bigint)"),
    ]
    return FieldCatalog(fields, "lang", ("source",), ("doc_id",), meta={"uid": "doc_id", "pid": "doc_id", "comm": "source"})
