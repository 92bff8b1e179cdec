"""Decoding of packed event records into the wide host-event table.

Fields are cut out of the binary column at fixed places with built-in functions, so decoding is
a projection of the scan. Records that are too short or of an unknown type are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import BPF_MAP_TYPES, EVENT_TYPES, PROTOCOLS, TCP_STATES, name_of, swap_bytes, swap_port
from ..functions.text import until_nul

# Places of the packed little-endian record. The header takes 72 bytes.
HEADER = {"ts": (0, 8), "cgroup_id": (8, 8), "mnt_ns": (16, 4), "pid": (20, 4), "ppid": (24, 4), "uid": (28, 4), "tgid": (32, 4)}
HEADER_TEXT = {"comm": (37, 16), "parent_comm": (53, 16)}
TYPE_AT, HEADER_BYTES = 36, 72
#: Kind: (type codes, bytes of the whole record).
SIZES = {
    "Generic": ((1, 4), 80), "Socket": ((3,), 88), "Module": ((5,), 136), "InetSock": ((6,), 96), "Bprm": ((8,), 208),
    "BpfProgLoad": ((9,), 96), "Inode": ((10,), 144), "BpfMap": ((11,), 144), "InodeMutate": ((12,), 216), "PtraceAccessCheck": ((13,), 112),
}


def number(raw: Column, at: int, size: int) -> Column:
    """An unsigned little-endian number."""
    digits = F.concat(*[F.hex(F.substring(raw, at + i + 1, 1)) for i in range(size - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long")


def text(raw: Column, at: int, size: int) -> Column:
    return until_nul(F.substring(raw, at + 1, size))


def signed32(value: Column) -> Column:
    return F.when(value >= 2**31, value - 2**32).otherwise(value)


def decode_events(records: DataFrame, raw_col: str = "raw", keep: tuple[str, ...] = ("seq_no",), raw_compat: bool = False) -> DataFrame:
    """The wide event table of binary records.

    Addresses and ports come out in host numeric order and the target's own command name is used;
    ``raw_compat`` keeps them as they were read and takes the caller's command name instead.
    """
    raw = F.col(raw_col)
    code = number(raw, TYPE_AT, 1)
    kind = None
    for name, (codes, size) in SIZES.items():
        test = code.isin(*codes) & (F.length(raw) >= size)
        kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))
    known = records.where(F.length(raw) >= HEADER_BYTES).withColumn("kind", kind).withColumn("_code", code).where(F.col("kind").isNotNull())

    def of(kinds: str, value: Column) -> Column:
        return F.when(F.col("kind").isin(*kinds.split()), value)

    def u(at: int, size: int) -> Column:
        return number(raw, at, size)

    ip = (lambda c: c) if raw_compat else swap_bytes
    port = (lambda c: c) if raw_compat else swap_port
    columns = {
        **{n: u(*place) for n, place in HEADER.items()},
        **{n: text(raw, *place) for n, place in HEADER_TEXT.items()},
        "name": of("Generic", name_of(F.col("_code").cast("int"), EVENT_TYPES)),
        "meta": of("Generic", u(72, 4)),
        "meta_type": of("Generic", u(76, 2)),
        "addr": of("Socket", ip(u(72, 4))),
        "port": of("Socket", port(u(76, 2))),
        "family": of("Socket", u(78, 2)),
        "op": F.when(F.col("kind") == "Socket", u(80, 1)).when(F.col("kind") == "Module", u(128, 1)).when(F.col("kind") == "Inode", u(140, 1)),
        "module_name": of("Module", text(raw, 72, 56)),
        "old_state": of("InetSock", name_of(signed32(u(72, 4)).cast("int"), TCP_STATES)),
        "new_state": of("InetSock", name_of(signed32(u(76, 4)).cast("int"), TCP_STATES)),
        "saddr": of("InetSock", ip(u(80, 4))),
        "daddr": of("InetSock", ip(u(84, 4))),
        "sport": of("InetSock", u(88, 2)),
        "dport": of("InetSock", u(90, 2)),
        "protocol": of("InetSock", name_of(u(92, 2).cast("int"), PROTOCOLS)),
        "filepath": of("Bprm", until_nul(F.substring(raw, F.lit(73), F.least(u(200, 4), F.lit(128)).cast("int")))),
        "path_len": of("Bprm", u(200, 4)),
        "prog_type": of("BpfProgLoad", u(72, 4)),
        "attach_type": of("BpfProgLoad", u(76, 4)),
        "flags": of("BpfProgLoad", u(80, 4)),
        "tag": of("BpfProgLoad", text(raw, 84, 8)),
        "filename": of("Inode", text(raw, 72, 64)),
        "filename_len": of("Inode", u(136, 4)),
        "map_name": of("BpfMap", text(raw, 72, 64)),
        "map_id": of("BpfMap", u(136, 4)),
        "map_type": of("BpfMap", name_of(u(140, 4).cast("int"), BPF_MAP_TYPES)),
        "new_filename": of("InodeMutate", text(raw, 72, 64)),
        "old_filename": of("InodeMutate", text(raw, 136, 64)),
        "new_filename_len": of("InodeMutate", u(200, 4)),
        "old_filename_len": of("InodeMutate", u(204, 4)),
        "mutation": of("InodeMutate", u(208, 1)),
        "target_pid": of("PtraceAccessCheck", u(72, 4)),
        "target_tgid": of("PtraceAccessCheck", u(76, 4)),
        "target_uid": of("PtraceAccessCheck", u(80, 4)),
        "mode": of("PtraceAccessCheck", u(84, 4)),
        "stage": of("PtraceAccessCheck", u(88, 1)),
        "target_comm": of("PtraceAccessCheck", text(raw, *HEADER_TEXT["comm"]) if raw_compat else text(raw, 89, 16)),
    }
    return known.select(*[c for c in keep if c in records.columns], "kind", *[c.alias(n) for n, c in columns.items()])
