"""Mining of code patterns with evidence and documentation snippets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_uuid
from ..functions.text import lines_of
from ..sources.files import in_scope
from .views import last_rows


@dataclass(frozen=True)
class PatternSpec:
    name: str
    code_regex: str
    doc_regex: str
    reason: str
    tags: tuple[str, ...]
    scopes: tuple[str, ...]


def with_lines(files: DataFrame) -> DataFrame:
    return files.select("path", lines_of(F.coalesce("text", F.lit(""))).alias("lines"))


def evidence(files: DataFrame, regex: str) -> DataFrame:
    """``path, line_start, line_end, code_snippet, context`` of each matching line.

    The context is the earliest comment or function head of the three lines before.
    """
    rows = with_lines(files).select("path", "lines", F.posexplode("lines").alias("i", "line")).where(F.col("line").rlike(regex))
    return rows.select("path", (F.col("i") + 1).alias("line_start"), (F.col("i") + 1).alias("line_end"), F.trim("line").alias("code_snippet"), _context().alias("context"))


def _context() -> Column:
    before = F.transform(F.slice("lines", F.greatest(F.col("i") - 2, F.lit(1)), F.least(F.col("i"), F.lit(3))), lambda x: F.trim(x))
    heads = F.filter(before, lambda x: F.startswith(x, F.lit("//")) | F.startswith(x, F.lit("fn ")))
    return F.coalesce(F.get(heads, F.lit(0)), F.lit(""))


def _around(i: Column) -> Column:
    """A line with two on either side."""
    window = F.slice("lines", F.greatest(i - 1, F.lit(1)), i + 3 - F.greatest(i - 2, F.lit(0)))
    return F.trim(F.array_join(window, "\n"))


def _any_line(regex: str) -> Column:
    return F.exists("lines", lambda x: x.rlike(f"(?i){regex}"))


def _first_snippet(regex: str) -> Column:
    return _around(F.array_position(F.transform("lines", lambda x: x.rlike(f"(?i){regex}")), True).cast("int") - 1)


def snippets(files: DataFrame, regex: str, most: int = 3) -> DataFrame:
    """``path, n, snippet``: up to ``most`` matches of a file with two lines on either side, any case."""
    numbered = with_lines(files).withColumn("hits", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(f"(?i){regex}"), i)), lambda i: i.isNotNull()))
    found = numbered.select("path", "lines", F.posexplode(F.slice("hits", F.lit(1), F.lit(most))).alias("n", "i"))
    return found.select("path", "n", _around(F.col("i")).alias("snippet"))


def mined_evidence(code: DataFrame, specs: Sequence[PatternSpec]) -> DataFrame:
    """``pattern_name, path, line_start, line_end, code_snippet, context`` of each line that a pattern in scope matches.

    One scan for all patterns and no shuffle; the evidence of a pattern is rows, however many there are.
    """
    lines = with_lines(code).select("path", "lines", F.posexplode("lines").alias("i", "line"))
    which = F.array_compact(F.array(*[F.when(in_scope(F.col("path"), s.scopes) & F.col("line").rlike(s.code_regex), F.lit(s.name)) for s in specs]))
    hits = lines.withColumn("which", which).where(F.size("which") > 0)
    place = (F.col("i") + 1).alias("line_start"), (F.col("i") + 1).alias("line_end")
    return hits.select(F.explode("which").alias("pattern_name"), "path", *place, F.trim("line").alias("code_snippet"), _context().alias("context"))


def evidence_lists(found: DataFrame, most: int) -> DataFrame:
    """``pattern_name, evidence``: the first ``most`` rows of ``mined_evidence`` of each pattern, in file order."""
    first = last_rows(found, [F.col("pattern_name")], ["path", "line_start"], most, first=True)
    proof = F.struct("path", "line_start", "line_end", "code_snippet", "context")
    return first.groupBy("pattern_name").agg(F.array_sort(F.collect_list(proof)).alias("evidence"))


def mine(code: DataFrame, docs: DataFrame, specs: Sequence[PatternSpec]) -> DataFrame:
    """One row per pattern: its id, origin, confidence, and how much evidence ``mined_evidence`` has of it.

    Each table is scanned once for all patterns; counts and origins are combined before they are shuffled.
    """
    spark = code.sparkSession
    names = F.array(*[F.struct(F.lit(s.name).alias("pattern_name"), F.lit(s.reason).alias("reason"), F.array(*[F.lit(t) for t in s.tags]).cast("array<string>").alias("tags"), F.array(*[F.lit(x) for x in s.scopes]).cast("array<string>").alias("scope_paths")) for s in specs])
    table = spark.range(1).select(F.inline(names))
    found = mined_evidence(code, specs).groupBy("pattern_name").agg(F.count(F.lit(1)).alias("n_evidence"))
    firsts = F.array_compact(
        F.array(*[F.when(in_scope(F.col("path"), s.scopes) & _any_line(s.doc_regex), F.struct(F.lit(s.name).alias("pattern_name"), _first_snippet(s.doc_regex).alias("snippet"))) for s in specs])
    )
    origins = with_lines(docs).select("path", F.inline(firsts)).groupBy("pattern_name").agg(F.min_by(F.struct("path", "snippet"), F.col("path")).alias("origin"))
    row = table.join(F.broadcast(found), "pattern_name", "left").join(F.broadcast(origins), "pattern_name", "left")  # a row per pattern each
    scopes = F.array_join(F.array_sort(F.array_distinct("scope_paths")), ",")
    key = F.concat(F.col("pattern_name"), F.lit("::"), F.coalesce("origin.path", F.lit("none")), F.lit("::"), scopes)
    return row.select(
        stable_uuid("pattern", key).alias("pattern_id"),
        "pattern_name",
        "reason",
        "tags",
        "scope_paths",
        F.coalesce("origin.path", F.lit("")).alias("origin_path"),
        F.coalesce("origin.snippet", F.lit("")).alias("snippet"),
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
        F.when(F.col("n_evidence") > 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("confidence"),
    )


def stale(previous: DataFrame, current: DataFrame, key: str = "pattern_id") -> DataFrame:
    return previous.join(current.select(key), key, "left_anti")


# Name, pattern in code, pattern in documents, reason, tags, scopes. {root} stands for the folder of the
# workspace's source tree, {ROOT} for its name in capitals.
BUILT_IN = (
    ("Determinism via BTreeMap", r"\bBTreeMap\s*<", r"\bdeterminism\b|\bBTreeMap\b", "Deterministic iteration/serialization for auditability.", ("determinism", "collections"), ("{root}/crucibles", "{root}/kernel", "{root}/runtime")),
    ("no_std imports", r"\buse\s+(alloc|core)::", r"\bno_std\b|\balloc\b|\bcore\b", "no_std compatibility for kernel/runtime crates.", ("no_std",), ("{root}/crucibles", "{root}/runtime", "{root}/kernel")),
    ("Feature gate std", r"#\s*\[\s*cfg\(feature\s*=\s*\"std\"\)\s*]", r"\bfeature gate\b|\bcfg\(feature *= *\"std\"", "Conditional compilation boundary for std-only code.", ("feature-gate",), ("{root}/crucibles", "{root}/runtime")),
    ("Spin mutex", r"\bspin::Mutex\b", r"\bspin::Mutex\b|\bthread safety\b", "Spinlock for no_std synchronization.", ("sync", "no_std"), ("{root}/crucibles", "{root}/runtime", "{root}/kernel")),
    ("Schema versioning", r"\bschema_version\b", r"\bschema version\b", "Forward/backward compatibility contract.", ("versioning",), ("{root}/crucibles", "{root}/runtime", "{root}/kernel")),
    ("Domain separation", r"Temper\.[A-Za-z0-9_.-]+", r"\bdomain separation\b|Temper\.", "Prevents cross-protocol key reuse.", ("crypto", "domain-separation"), ("{root}/runtime/temper",)),
    ("Content-addressed IDs (BLA3)", r"\bBLAKE3\b|\bObjectId\b", r"\bcontent-addressed\b|\bBLAKE3\b", "Deterministic IDs for integrity/audit.", ("integrity",), ("{root}/kernel/ledgerfs", "{root}/crucibles/fs-cbl")),
    ("Setup/Exec/Check test structure", r"Setup:?|Exec:?|Check:?", r"\bSetup/Exec/Check\b|\btest structure\b", "Consistent test documentation and flow.", ("testing",), ("tests", "{root}")),
    ("Capability gates", r"\bAUDIT_CBL_CAP\b|\bCapabilityId\b", r"\bcapability\b|\bAUDIT_CBL_CAP\b", "Least-privilege capability enforcement.", ("capability", "security"), ("{root}/crucibles", "{root}/kernel/forge")),
    ("Batch IPC op codes", r"\bBatch[A-Za-z]+|IPC\b", r"\bIPC\b|\bbatch ops\b", "Deterministic IPC batching patterns.", ("ipc", "performance"), ("{root}/crucibles/fs-cbl",)),
    ("Boot phase breadcrumbs", r'console_write\(b"(INIT:[A-Z_]+)', r"INIT:START|INIT:TLS_OK|INIT:HEAP_OK|INIT:MANIFEST|INIT:ENGINE_RUN", "Boot sequence progress markers — if missing from serial, boot halted before this point.", ("boot", "debug", "serial"), ("{root}/kernel/forge-init", "{root}/kernel/forge-boot")),
    ("LedgerFS on-disk layout", r"SUPERBLOCK_MAGIC|PART_TYPE_{ROOT}_LFS|0xC0|SECTORS_PER_BLOCK|BLOCK_SIZE", r"LedgerFS|superblock|partition.*0xC0|block.*4096", "LedgerFS disk format constants — needed for partition probing and superblock verification.", ("ledgerfs", "boot", "disk"), ("{root}/kernel/forge-boot", "{root}/kernel/ledgerfs", "{root}/kernel/forge-builder")),
    ("Service lifecycle states", r"ServiceStatus::(Idle|Starting|Running|Failed|Crashed|Unavailable)", r"service.*lifecycle|Idle.*Starting.*Running|forge-rc.*supervisor", "Service state machine transitions — diagnose why services aren't reaching Running.", ("services", "forge-rc", "lifecycle"), ("{root}/kernel/forge-rc", "{root}/kernel/forge-init")),
    ("Kernel syscall interface", r"(?:process_create|process_yield|ipc_recv|ipc_send|console_write|file_open)\s*\(", r"syscall|ProcessCreate|IpcRecv|process_create", "Userspace → kernel syscall boundary.", ("syscall", "kernel", "ipc"), ("{root}/kernel",)),
    ("ATA PIO disk I/O", r"ata_pio_read|ata_pio_write|port::inb|port::outb.*0x1F", r"ATA.*PIO|sector.*read|disk.*I/O", "Raw disk I/O — the only way the kernel reads LedgerFS before drivers are loaded.", ("disk", "ata", "boot", "hardware"), ("{root}/kernel/forge-boot", "{root}/kernel/forge-drivers")),
    ("MBR partition table", r"MBR_PARTITION_TABLE_OFFSET|0x55AA|partition.*entry|PART_TYPE", r"MBR|partition.*table|boot.*signature", "MBR parsing — if partition probing fails, boot halts.", ("boot", "mbr", "partition"), ("{root}/kernel/forge-boot", "{root}/kernel/forge-builder")),
    ("ELF loading and process creation", r"process_create\(|elf.*parse|elf.*load|\.elf\b", r"ELF.*binary|process.*create|spawn.*service", "How service binaries are loaded from disk into new processes.", ("elf", "process", "spawn"), ("{root}/kernel/forge-init", "{root}/kernel/forge-rc", "{root}/kernel/forge-boot")),
    ("Serial port debug output", r"SerialPort::new|serial_panic|sp\.init\(\)|writeln!\(sp", r"serial.*port|0x3F8|serial.*panic|serial.*debug", "Serial output is the primary debug channel.", ("debug", "serial", "boot"), ("{root}/kernel/forge-boot", "{root}/kernel/forge-init")),
    ("Forge-rc service manifest and boot order", r"boot_order|build_manifest|register_from_rcf|set_spawner|ServiceEngine", r"manifest|boot.*order|service.*engine|forge-rc", "How services are registered and ordered for boot.", ("services", "manifest", "boot-order"), ("{root}/kernel/forge-rc", "{root}/kernel/forge-init")),
    ("Cryptographic verification (ML-DSA / SLH-DSA / BLAKE3)", r"mldsa|slhdsa|ML-DSA|SLH-DSA|verify_root_seal|verify_signature|blake3::hash", r"ML-DSA|SLH-DSA|root.*seal|signature.*verification|post-quantum", "Cryptographic verification in the boot chain. Failure = halt (fail-closed).", ("crypto", "verification", "boot", "pqc"), ("{root}/kernel/forge-boot", "{root}/runtime/temper", "{root}/crypto")),
)


def built_in(root: str) -> list[PatternSpec]:
    """The built-in table for a workspace whose source tree is the folder ``root``."""

    def put(text: str) -> str:
        return text.replace("{root}", root).replace("{ROOT}", root.upper())

    return [PatternSpec(name, put(code), put(docs), reason, tags, tuple(put(s) for s in scopes)) for name, code, docs, reason, tags, scopes in BUILT_IN]
