"""Path, container and source-text helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories of a workspace whose next path part is a package.
PACKAGE_ROOTS = ("kernel", "runtime", "crucibles", "crypto", "tools")


def until_nul(raw: Column) -> Column:
    """Text of a fixed-width byte field: up to its first NUL, invalid bytes replaced."""
    text = F.decode(raw, "UTF-8")
    return F.substring_index(text, chr(0), 1)


def deny_key(path: Column, width: int = 128) -> Column:
    """The first ``width`` bytes of a path, padded with zero bytes."""
    raw = F.substring(path.cast("binary"), 1, width)
    return F.rpad(raw, width, bytes([0]))


def container_id(path: Column) -> Column:
    """From a cgroup path: the first part named ``docker-<id>.scope``, or of 32 or more hex digits."""
    parts = F.split(path, "/")
    found = F.filter(parts, lambda p: F.startswith(p, F.lit("docker-")) | p.rlike("\\A[0-9a-fA-F]{32,}\\z"))
    return F.regexp_replace(F.regexp_replace(F.get(found, F.lit(0)), "\\Adocker-", ""), "\\.scope\\z", "")


def container_runtime(path: Column) -> Column:
    """The runtime that a cgroup path tells of, by the first word found."""
    out = None
    for folder, prefix, name in (("/docker/", "docker-", "docker"), ("/kubepods/", "k8s", "k8s"), ("/containerd/", "containerd-", "containerd"), ("/crio/", "crio-", "crio")):
        test = F.contains(path, F.lit(folder)) | F.contains(path, F.lit(prefix))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def subsystem(path: Column, root: str) -> Column:
    """The subsystem of a workspace path: the first prefix that fits, else empty."""
    prefixes = [(f"{root}/kernel/", "kernel"), (f"{root}/runtime/", "runtime"), (f"{root}/crucibles/", "crucibles"), (f"{root}/crypto/", "crypto"), ("tools/", "tools"), ("tests/", "tests"), ("docs/", "docs"), ("library/", "library")]
    out = None
    for prefix, name in prefixes:
        test = F.startswith(path, F.lit(prefix))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(""))


def package_name(path: Column) -> Column:
    """The path part after the first package root that has one, else empty."""
    parts = F.split(path, "/")
    after = F.transform(parts, lambda p, i: F.when(p.isin(*PACKAGE_ROOTS) & (i + 1 < F.size(parts)), F.get(parts, i + 1)))
    return F.coalesce(F.get(F.array_compact(after), F.lit(0)), F.lit(""))


def module_path(path: Column) -> Column:
    """``package::module`` of a Rust source file, from what follows ``src``."""
    parts = F.split(path, "/")
    package = F.replace(package_name(path), F.lit("-"), F.lit("_"))
    at = F.array_position(parts, "src").cast("int")
    rest = F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0)))
    last = F.get(rest, F.size(rest) - 1)
    head = F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))
    named = F.when(last.isin("lib.rs", "main.rs"), head).otherwise(F.concat(head, F.array(F.regexp_replace(last, "\\.rs\\z", ""))))
    modules = F.when((at == 0) | (F.size(rest) == 0), F.array().cast("array<string>")).otherwise(named)
    full = F.array_join(F.concat(F.array(package), F.transform(modules, lambda m: F.replace(m, F.lit("-"), F.lit("_")))), "::")
    return F.when(F.endswith(path, F.lit(".rs")) & (package != ""), full).otherwise(F.lit(""))


def lines_of(text: Column) -> Column:
    """Lines without their ends; a last empty line does not count."""
    lines = F.split(text, "\r\n|\n|\r", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def trim_to_signature(text: Column, budget: Column, head: int = 5, tail: int = 3) -> Column:
    """The first and last lines with a note of how many are left out, cut at ``budget`` characters."""
    lines = lines_of(text)
    n = F.size(lines)
    first = F.slice(lines, F.lit(1), F.least(n, F.lit(head)))
    last = F.when(n > head, F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail))).otherwise(F.array().cast("array<string>"))
    omitted = n - F.size(first) - F.size(last)
    note = F.when(omitted > 0, F.array(F.format_string("// ... (%d lines omitted)", omitted))).otherwise(F.array().cast("array<string>"))
    return F.substr(F.array_join(F.concat(first, note, last), "\n"), F.lit(1), budget)


def metadata_summary(file: Column, start: Column, end: Column, kind: Column, package: Column, symbols: Column, budget: Column) -> Column:
    def known(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("?"))

    text = F.concat(known(file), F.lit(":"), known(start), F.lit("-"), known(end), F.lit(" ["), known(kind), F.lit("] crate="), known(package), F.lit(" symbols=["), F.coalesce(F.array_join(symbols, ", "), F.lit("")), F.lit("]"))
    return F.substr(text, F.lit(1), budget)


def signature(document: Column) -> Column:
    """The first function head of a source text, up to its body or end."""
    return F.trim(F.regexp_extract(document, "(?:pub(?:\\([^)]*\\))?\\s+)?(?:async\\s+)?(?:unsafe\\s+)?fn\\s+\\w+[^{;]*", 0))


def preview(text: Column, width: int = 140) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


QUESTION_WORDS = ("how", "what", "why", "when", "where", "which", "who", "does", "is", "are")
BROWSING_KINDS = ("struct", "enum", "trait", "impl", "module")


def query_intent(query: Column, kind: Column) -> Column:
    """``lookup`` or ``exploration`` for a query and its kind filter."""
    trimmed = F.trim(F.regexp_replace(query, "(?U)\\s+", " "))
    words = F.filter(F.split(trimmed, " "), lambda w: w != "")
    n = F.size(words)
    first = F.regexp_replace(F.lower(F.coalesce(F.get(words, F.lit(0)), F.lit(""))), "\\?+\\z", "")
    return (
        F.when(F.coalesce(F.lower(kind).isin(*BROWSING_KINDS), F.lit(False)), F.lit("exploration"))
        .when(n <= 3, F.lit("lookup"))
        .when(first.isin(*QUESTION_WORDS), F.lit("exploration"))
        .when(n > 8, F.lit("exploration"))
        .otherwise(F.lit("lookup"))
    )
