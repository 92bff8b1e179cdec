"""Names of kernel codes, address helpers and severities as Spark columns."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kernel's own numbering, in order from 0 unless numbered.
EVENT_TYPES = {1: "KILL", 2: "IO_URING", 3: "SOCKET", 4: "COMMIT_CREDS", 5: "MODULE", 6: "INET_SOCK_SET_STATE", 7: "ENTER_PTRACE", 8: "BPRM_CHECK_SEC", 9: "BPF_PROG_LOAD", 10: "INODE", 11: "BPF_MAP", 12: "INODE_MUTATE", 13: "PTRACE_ACCESS_CHECK"}
TCP_STATES = dict(enumerate("TCP_ESTABLISHED TCP_SYN_SENT TCP_SYN_RECV TCP_FIN_WAIT1 TCP_FIN_WAIT2 TCP_TIME_WAIT TCP_CLOSE TCP_CLOSE_WAIT TCP_LAST_ACK TCP_LISTEN TCP_CLOSING".split(), 1))
PROTOCOLS = {6: "TCP", 17: "UDP"}
BPF_MAP_TYPES = dict(
    enumerate(
        "UNSPEC HASH ARRAY PROG_ARRAY PERF_EVENT_ARRAY PERCPU_HASH PERCPU_ARRAY STACK_TRACE CGROUP_ARRAY LRU_HASH LRU_PERCPU_HASH LPM_TRIE ARRAY_OF_MAPS HASH_OF_MAPS DEVMAP SOCKMAP CPUMAP XSKMAP SOCKHASH CGROUP_STORAGE REUSEPORT_SOCKARRAY PERCPU_CGROUP_STORAGE QUEUE STACK SK_STORAGE DEVMAP_HASH STRUCT_OPS RINGBUF INODE_STORAGE TASK_STORAGE BLOOM_FILTER USER_RINGBUF CGRP_STORAGE ARENA".split()
    )
)
BPF_PROG_TYPES = dict(
    enumerate(
        "UNSPEC SOCKET_FILTER KPROBE SCHED_CLS SCHED_ACT TRACEPOINT XDP PERF_EVENT CGROUP_SKB CGROUP_SOCK LWT_IN LWT_OUT LWT_XMIT SOCK_OPS SK_SKB CGROUP_DEVICE SK_MSG RAW_TRACEPOINT CGROUP_SOCK_ADDR LWT_SEG6LOCAL LIRC_MODE2 SK_REUSEPORT FLOW_DISSECTOR CGROUP_SYSCTL RAW_TRACEPOINT_WRITABLE CGROUP_SOCKOPT TRACING STRUCT_OPS EXT LSM SK_LOOKUP SYSCALL NETFILTER".split()
    )
)
BPF_ATTACH_TYPES = dict(
    enumerate(
        "CGROUP_INET_INGRESS CGROUP_INET_EGRESS CGROUP_INET_SOCK_CREATE CGROUP_SOCK_OPS SK_SKB_STREAM_PARSER SK_SKB_STREAM_VERDICT CGROUP_DEVICE SK_MSG_VERDICT CGROUP_INET4_BIND CGROUP_INET6_BIND CGROUP_INET4_CONNECT CGROUP_INET6_CONNECT CGROUP_INET4_POST_BIND CGROUP_INET6_POST_BIND CGROUP_UDP4_SENDMSG CGROUP_UDP6_SENDMSG LIRC_MODE2 FLOW_DISSECTOR CGROUP_SYSCTL CGROUP_UDP4_RECVMSG CGROUP_UDP6_RECVMSG CGROUP_GETSOCKOPT CGROUP_SETSOCKOPT TRACE_RAW_TP TRACE_FENTRY TRACE_FEXIT MODIFY_RETURN LSM_MAC TRACE_ITER CGROUP_INET4_GETPEERNAME CGROUP_INET6_GETPEERNAME CGROUP_INET4_GETSOCKNAME CGROUP_INET6_GETSOCKNAME XDP_DEVMAP CGROUP_INET_SOCK_RELEASE XDP_CPUMAP SK_LOOKUP XDP SK_SKB_VERDICT SK_REUSEPORT_SELECT SK_REUSEPORT_SELECT_OR_MIGRATE PERF_EVENT TRACE_KPROBE_MULTI LSM_CGROUP STRUCT_OPS NETFILTER TCX_INGRESS TCX_EGRESS TRACE_UPROBE_MULTI CGROUP_UNIX_CONNECT CGROUP_UNIX_SENDMSG CGROUP_UNIX_RECVMSG CGROUP_UNIX_GETPEERNAME CGROUP_UNIX_GETSOCKNAME NETKIT_PRIMARY NETKIT_PEER TRACE_KPROBE_SESSION TRACE_UPROBE_SESSION".split()
    )
)
ADDRESS_FAMILIES = dict(
    enumerate(
        "AF_UNSPEC AF_UNIX AF_INET AF_AX25 AF_IPX AF_APPLETALK AF_NETROM AF_BRIDGE AF_ATMPVC AF_X25 AF_INET6 AF_ROSE AF_DECnet AF_NETBEUI AF_SECURITY AF_KEY AF_NETLINK AF_PACKET AF_ASH AF_ECONET AF_ATMSVC AF_RDS AF_SNA AF_IRDA AF_PPPOX AF_WANPIPE AF_LLC AF_IB AF_MPLS AF_CAN AF_TIPC AF_BLUETOOTH AF_IUCV AF_RXRPC AF_ISDN AF_PHONET AF_IEEE802154 AF_CAIF AF_ALG AF_NFC AF_XDP".split()
    )
)
MODULE_OPS = {0: "INIT", 1: "DELETE", 2: "REQUEST"}
INODE_OPS = {0: "UNLINK", 1: "MKDIR", 2: "RMDIR"}
INODE_MUTATIONS = {0: "RENAME", 1: "LINK", 2: "SYMLINK"}
PTRACE_STAGES = {0: "REQUEST", 1: "DECISION"}
SOCKET_OPS = {0: "BIND", 1: "CONNECT"}
PROG_FLAGS = ((1, "JIT"), (2, "SLEEPABLE"), (4, "GPL"), (8, "KPROBE_OVR"))
SEVERITIES = ("info", "very-low", "low", "medium", "high", "critical")
LOG_LEVELS = {"critical": "ERROR", "high": "WARN", "medium": "WARN", "low": "INFO", "very-low": "DEBUG", "info": "DEBUG"}
TAMPER_SEVERITIES = {0: "INFO", 1: "VERY_LOW", 2: "LOW", 3: "MEDIUM", 4: "HIGH", 5: "CRITICAL"}


def name_of(code: Column, names: dict, default: str = "UNKNOWN") -> Column:
    """The name of a code, ``default`` for unknown ones; null stays null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code), F.lit(default)))


def prog_flag_names(flags: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in PROG_FLAGS])), ",")


def dotted_ip(address: Column) -> Column:
    """Dotted form of an address in host numeric order."""
    return F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def swap_bytes(address: Column) -> Column:
    """A 32-bit number with its bytes in the other order: for addresses read without conversion."""
    parts = [F.call_function("shiftleft", F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("long"), F.lit(24 - s)) for s in (0, 8, 16, 24)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def swap_port(port: Column) -> Column:
    return (port.bitwiseAND(F.lit(255)) * 256 + F.shiftright(port, 8)).cast("long")


def parse_ip(text: Column) -> Column:
    """The number of a strict dotted address, else null: four decimals up to 255 without leading zeros."""
    part = "(0|[1-9][0-9]{0,2})"
    parts = F.split(text, "\\.")
    numbers = F.transform(parts, lambda p: p.cast("long"))
    good = text.rlike(f"\\A{part}\\.{part}\\.{part}\\.{part}\\z") & F.forall(numbers, lambda n: n <= 255)
    return F.when(good, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a * 256 + n))


def ip_number(text: str) -> int | None:
    try:
        return int(ipaddress.IPv4Address(text))
    except ValueError:
        return None


def severity_index(severity: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in enumerate(SEVERITIES)) for x in pair]), severity)


def log_level(severity: Column) -> Column:
    """The level of a rule's severity; records without one are warnings."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LOG_LEVELS.items() for x in pair]), severity), F.lit("WARN"))
