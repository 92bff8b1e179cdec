"""Event sources: files in batch or as streams, hook filters, tamper messages, unions of sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Kernel hooks that can be switched on and off, and the kind of rows each gives.
HOOKS = {
    "bprm_check": "Bprm", "socket_connect": "Socket", "socket_bind": "Socket", "inet_sock_set_state": "InetSock",
    "inode_unlink": "Inode", "inode_mkdir": "Inode", "inode_rmdir": "Inode", "inode_rename": "InodeMutate", "inode_link": "InodeMutate", "inode_symlink": "InodeMutate",
    "bpf_prog_load": "BpfProgLoad", "bpf_map": "BpfMap", "module_init": "Module", "task_kill": "Generic", "ptrace_enter": "Generic", "ptrace_access_check": "PtraceAccessCheck", "xdp_blocklist": "Packet",
}
AF_INET, IPPROTO_TCP = 2, 6


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, stream: bool = False) -> DataFrame:
    """Events of a folder, at once or as they come."""
    reader = (spark.readStream if stream else spark.read).format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def hook_table(spark: SparkSession, disabled: Iterable[str] = ()) -> DataFrame:
    off = set(disabled)
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("hook"), F.lit(k).alias("kind"), F.lit(h not in off).alias("enabled")) for h, k in HOOKS.items()])))


def from_enabled_hooks(events: DataFrame, enabled: Iterable[str], column: str = "hook") -> DataFrame:
    return events.where(F.col(column).isin(*enabled))


def hook_conditions() -> Column:
    """What hooks let through: sockets of IPv4 that succeeded, TCP state changes, names that could be read."""
    c = F.col
    socket = c("addr").isNotNull() & (c("ret") == 0) & (c("family") == AF_INET)
    return (
        F.when(c("kind") == "Socket", socket)
        .when(c("kind") == "InetSock", c("proto") == IPPROTO_TCP)
        .when(c("kind") == "Bprm", c("filepath").isNotNull())
        .when(c("kind") == "Inode", c("filename").isNotNull())
        .when(c("kind") == "InodeMutate", c("old_filename").isNotNull() & c("new_filename").isNotNull())
        .otherwise(F.lit(True))
    )


def packed_prog_flags(jited: Column, sleepable: Column, gpl: Column, kprobe_override: Column) -> Column:
    out = F.lit(0)
    for i, bit in enumerate((jited, sleepable, gpl, kprobe_override)):
        out = out.bitwiseOR(F.when(bit, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def tamper_events(messages: DataFrame, source: str = "watchdog") -> DataFrame:
    """Host events of watchdog messages; without a severity of 0 to 5 or with a kind outside 0 to 3 they are dropped."""
    kind = F.coalesce(F.col("kind"), F.lit(0))
    ok = messages.where(F.col("severity").between(0, 5) & kind.between(0, 3))
    zero = F.lit(0).cast("long")
    return ok.select(
        F.lit("Tamper").alias("kind"),
        F.col("ts"),
        *[zero.alias(c) for c in ("cgroup_id", "mnt_ns", "ppid", "uid", "tgid")],
        F.coalesce(F.col("pid").cast("long"), zero).alias("pid"),
        F.lit(source).alias("comm"),
        F.col("severity").cast("long").alias("tamper_severity"),
        kind.cast("long").alias("tamper_kind"),
        "reason",
        F.coalesce(F.col("age_ms").cast("long"), zero).alias("age_ms"),
        F.lit(source).alias("source"),
    )


def with_tampering(events: DataFrame, tampering: DataFrame) -> DataFrame:
    """Both sources as one stream of events."""
    return events.unionByName(tampering, allowMissingColumns=True)
