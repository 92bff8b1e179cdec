"""The text of search results, by type of point; and the log records of engine events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview

UNKNOWN = "?"


def _or(name: str, default: str = UNKNOWN) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def listing_line(rank: str = "rank", score: str = "score") -> Column:
    """One entry of a result list; absent fields are question marks. Fixed layout."""
    c = F.col
    head = F.concat(F.lit("  "), c(rank).cast("string"), F.lit(". ["), F.format_string("%.4f", F.bround(c(score), 4)), F.lit("] "))
    document = F.coalesce(preview(c("document")), F.lit(""))
    chunk = F.concat(_or("file"), F.lit(" (chunk "), _or("chunk_index"), F.lit("/"), _or("total_chunks"), F.lit(", "), _or("language"), F.lit(")\n     "), document)
    hits = F.size(F.coalesce("evidence", F.array().cast("array<string>"))).cast("string")
    pattern = F.concat(F.lit("PATTERN: "), _or("pattern_name"), F.lit("\n     Reason: "), _or("reason", ""), F.lit("\n     Tags: "), F.coalesce(F.array_join("tags", ", "), F.lit("")), F.lit(" | Evidence: "), hits, F.lit(" hits"))
    body = F.when(c("type") == "code_chunk", chunk).when(c("type") == "pattern", pattern).when(c("type") == "mcp_stored", F.concat(F.lit("STORED: "), document))
    return F.concat(head, body.otherwise(F.concat(F.lit("type="), _or("type"))))


def listing(rows: DataFrame, rank: str = "rank") -> str:
    """The whole list; ``rows`` are the few results of one search."""
    lines = [r[0] for r in rows.orderBy(rank).select(listing_line(rank)).collect()]
    return "\n\n".join(lines) if lines else "  (no results)"


def answer_block() -> Column:
    """The text of a result before its tier cuts it: what the point is, line by line. Fixed layout."""
    c = F.col
    no_strings = F.array().cast("array<string>")
    symbols = F.coalesce("symbols", no_strings)
    head = F.concat(F.lit("File: "), _or("file"), F.lit(" | Chunk "), _or("chunk_index"), F.lit("/"), _or("total_chunks"), F.lit(" | "), _or("language"))
    placed = (_or("subsystem", "") != "") | (_or("crate", "") != "")
    lines = F.array(
        head,
        F.when(placed, F.concat(F.lit("Subsystem: "), _or("subsystem", ""), F.lit(" | Crate: "), _or("crate", ""))),
        F.when(F.size(symbols) > 0, F.concat(F.lit("Symbols: "), F.array_join(symbols, ", "))),
        F.when(c("line_start").isNotNull() | c("line_end").isNotNull(), F.concat(F.lit("Lines: "), _or("line_start"), F.lit("–"), _or("line_end"))),
        F.concat(F.lit("Content:\n"), _or("document", "")),
    )
    evidence = F.coalesce("evidence", no_strings)
    shown = F.array_join(F.transform(F.slice(evidence, 1, 5), lambda e: F.concat(F.lit("  - "), e, F.lit("\n"))), "")
    pattern = F.concat(F.lit("Pattern: "), _or("pattern_name"), F.lit("\nReason: "), _or("reason", ""), F.lit("\nTags: "), F.coalesce(F.array_join("tags", ", "), F.lit("")), F.lit("\nSnippet: "), _or("snippet", ""), F.lit("\nEvidence ("), F.size(evidence).cast("string"), F.lit(" hits):\n"), shown)
    stored = F.concat(F.lit("Stored Information:\n"), _or("document", ""), F.lit("\nMetadata:\n"), _or("metadata", "(none)"))
    other = F.concat(F.lit("Type: "), _or("type", "unknown"))
    return F.when(c("type") == "code_chunk", F.array_join(F.array_compact(lines), "\n")).when(c("type") == "pattern", pattern).when(c("type") == "mcp_stored", stored).otherwise(other)


def match_records(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``level, fields`` of rule matches: a JSON object with the names that log readers know. Fixed names."""
    fields = F.struct(F.lit("rule_match").alias("event.kind"), F.col("rule_id").alias("rule.id"), F.col("severity").alias("rule.severity"), F.col("uid").alias("process.uid"), F.col("pid").alias("process.pid"), F.col("comm").alias("process.comm"))
    return matches.select(*keep, F.lit("INFO").alias("level"), F.to_json(fields).alias("fields"))


def correlation_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of ``correlate``: a step is a debug record without fields, a completion a warning."""
    done = F.struct(F.lit("correlation").alias("event.kind"), F.col("root_rule_id").alias("correlation.root_rule_id"), F.col("seq_id").alias("correlation.seq_id"), F.array_join("path", "->").alias("correlation.path"), F.col("steps").alias("correlation.steps"))
    step = F.struct(F.lit("correlation_step").alias("event"))
    is_step = F.col("type") == "step"
    return records.select(*keep, F.when(is_step, F.lit("DEBUG")).otherwise(F.lit("WARN")).alias("level"), F.when(is_step, F.to_json(step)).otherwise(F.to_json(done)).alias("fields"))


def response_records(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``respond``, each a warning with its actions."""
    fields = F.struct(F.lit("response").alias("event.kind"), F.col("rule_id").alias("rule.id"), F.to_json("actions").alias("response.action"))
    return responses.select(*keep, F.lit("WARN").alias("level"), F.to_json(fields).alias("fields"))


