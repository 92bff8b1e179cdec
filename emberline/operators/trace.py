"""Definitions, callers and callees of symbols, and bounded walks over the call graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature
from ..sources.shared import cut

MOST_DEPTH, DEFS, CALLS, FOLLOWED, CALLERS, CALLER_SYMBOLS = 4, 3, 10, 5, 5, 3
#: Rows of one column that a join sends to all tasks.
MOST_SENT = 1_000_000


def definitions_of(points: DataFrame, symbol: str, subsystem: str | None = None, key: str = "id") -> DataFrame:
    rows = points.where(F.array_contains("symbols", symbol))
    return (rows.where(F.col("subsystem") == subsystem) if subsystem else rows).orderBy(key)


def callers_of(points: DataFrame, symbol: str, subsystem: str | None = None, key: str = "id") -> DataFrame:
    rows = points.where(F.array_contains("calls", symbol))
    return (rows.where(F.col("subsystem") == subsystem) if subsystem else rows).orderBy(key)


def call_edges(points: DataFrame, key: str = "id") -> DataFrame:
    """``caller, callee, symbol``: chunks joined over what one calls and the other defines."""
    calls = points.select(F.col(key).alias("caller"), F.explode(F.array_distinct("calls")).alias("symbol"))
    defs = points.select(F.col(key).alias("callee"), F.explode(F.array_distinct("symbols")).alias("symbol"))
    return calls.join(defs, "symbol").select("caller", "callee", "symbol")


def reachable(edges: DataFrame, start: DataFrame, depth: int, source: str = "caller", target: str = "callee") -> DataFrame:
    """``node, depth``: what is reached from ``start`` (column ``node``) within ``depth`` steps, at its first depth.

    One join per level; what was seen before is dropped, so cycles end.
    """
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, min(max(depth, 1), MOST_DEPTH) + 1):
        step = front.select(F.col("node").alias(source)).join(edges.select(source, target), source).select(F.col(target).alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def reachable_points(points: DataFrame, start: DataFrame, depth: int, callers: bool = False, key: str = "id") -> DataFrame:
    """The rows of ``reachable`` over ``call_edges(points)``, without its edges.

    A level goes from chunks to the distinct symbols that they call (or define), and from those to the chunks that
    define (or call) them: a symbol with many definitions and many calls makes rows in proportion to their sum, not product.
    """
    outward, inward = ("symbols", "calls") if callers else ("calls", "symbols")
    # Definitions are short and read at every level; calls are as long as texts.
    defined = cut(points.select(key, "symbols"))
    there, whence = (points, defined) if callers else (defined, points)
    front = cut(defined.join(start.select(F.col("node").alias(key)), key, "left_semi").select(F.col(key).alias("node")).distinct())
    levels, known = front.withColumn("depth", F.lit(0)), None
    there = there.select(F.col(key).alias("node"), F.explode(F.array_distinct(inward)).alias("symbol"))
    for d in range(1, min(max(depth, 1), MOST_DEPTH) + 1):
        here = whence.select(key, outward).join(_few(front.select(F.col("node").alias(key))), key, "left_semi")
        symbols = here.select(F.explode(outward).alias("symbol")).distinct()
        # What was met before is at its first depth already, and so is all that follows from it.
        symbols = cut(symbols.join(known, "symbol", "left_anti") if known is not None else symbols)
        if symbols.isEmpty():
            break
        known = symbols if known is None else known.unionByName(symbols)
        found = there.join(_few(symbols), "symbol", "left_semi").select("node").distinct()
        front = cut(found.join(levels.select("node"), "node", "left_anti"))
        levels = levels.unionByName(front.withColumn("depth", F.lit(d)))
    return levels


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, which are stored, for a join: sent to all tasks if they are few, so that the other side is not shuffled."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


class Tracer:
    """The ordered, capped walk for one symbol. Each visit reads at most a handful of rows; a walk is a few dozen."""

    def __init__(self, points: DataFrame, subsystem: str | None = None, key: str = "id"):
        self.points, self.subsystem, self.key = points, subsystem, key
        self.visited: set = set()

    def _rows(self, df: DataFrame, most: int) -> list:
        return df.select(self.key, "file", "line_start", "line_end", "kind", "symbols", "calls", signature(F.col("text")).alias("sig"), F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("head")).limit(most).collect()

    def callees(self, symbol: str, depth: int) -> list[dict]:
        out: list[dict] = []
        if depth == 0:
            return out
        for row in self._rows(definitions_of(self.points, symbol, self.subsystem, self.key), DEFS):
            if row[self.key] in self.visited:
                continue
            self.visited.add(row[self.key])
            out.append(row.asDict())
            if depth > 1:
                for name in list(dict.fromkeys(row["calls"] or []))[:CALLS][:FOLLOWED]:
                    out += self.callees(name, depth - 1)
        return out

    def callers(self, symbol: str, depth: int) -> list[dict]:
        out: list[dict] = []
        if depth == 0:
            return out
        for row in self._rows(callers_of(self.points, symbol, self.subsystem, self.key), CALLERS):
            if row[self.key] in self.visited:
                continue
            self.visited.add(row[self.key])
            out.append(row.asDict())
            if depth > 1:
                for name in (row["symbols"] or [])[:CALLER_SYMBOLS]:
                    out += self.callers(name, depth - 1)
        return out


def _branches(points: DataFrame, callers: bool, key: str) -> tuple[DataFrame, DataFrame]:
    """(symbol, rank, node of its first chunks; node, names of the symbols that are followed from a chunk, in order)."""
    met, followed, most = ("calls", "symbols", CALLERS) if callers else ("symbols", "calls", DEFS)
    names = F.slice("symbols", 1, CALLER_SYMBOLS) if callers else F.slice(F.array_distinct("calls"), 1, min(CALLS, FOLLOWED))
    there = points.select(F.col(key).alias("node"), F.explode(F.array_distinct(met)).alias("symbol"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("node"))
    first = there.withColumn("rank", rank).where(F.col("rank") <= most)
    return cut(first), cut(points.where(F.size(followed) > 0).select(F.col(key).alias("node"), names.alias("names")))


def _first_visits(rows: pd.DataFrame) -> pd.DataFrame:
    """The walk through the tree of one start: a chunk counts where it is met first, and nothing is followed elsewhere."""
    visited, out, cut_off = set(), [], None
    for path, node, depth, start, side in rows.sort_values(["side", "path"])[["path", "node", "depth", "start", "side"]].itertuples(index=False, name=None):
        if cut_off is not None and cut_off[0] == side and path.startswith(cut_off[1]):
            continue
        if node in visited:
            cut_off = side, path
            continue
        visited.add(node)
        out.append((start, len(out) + 1, node, depth, "callers" if side else "callees"))
    return pd.DataFrame(out, columns=["start", "nth", "node", "depth", "direction"])


def trace_many(points: DataFrame, starts: DataFrame, depth: int = 2, direction: str = "both", key: str = "id") -> DataFrame:
    """The walks of ``Tracer`` for many symbols in one job: ``start, nth, node, depth, direction``.

    ``starts``: ``start, symbol``. Each level is a join of the rows in hand with the first
    definitions (or callers) of the symbols that they follow. A row carries its place in the walk
    as a text that sorts as the walk goes, so the walk is told from its tree by one sorted pass
    that leaves out what was met before. Caps bound a tree: fifteen branches a chunk, four levels.
    """
    depth, levels = min(max(depth, 1), MOST_DEPTH), None
    for side, name in enumerate(("callees", "callers")):
        if direction not in (name, "both"):
            continue
        first, follow = _branches(points, bool(side), key)
        asked = starts.select("start", "symbol", F.lit("").alias("path"))
        for d in range(1, depth + 1):
            # One sign for the rank, so that places sort; ranks and branches are single digits.
            step = asked.join(first, "symbol").select("start", "node", F.concat("path", F.col("rank").cast("string")).alias("path"))
            step = cut(step)
            own = step.withColumn("depth", F.lit(d)).withColumn("side", F.lit(side))
            levels = own if levels is None else levels.unionByName(own)
            asked = step.join(follow, "node").select("start", "path", F.posexplode("names").alias("branch", "symbol")).select("start", "symbol", F.concat("path", F.col("branch").cast("string")).alias("path"))
    kinds = dict(levels.dtypes)
    return levels.groupBy("start").applyInPandas(_first_visits, f"start {kinds['start']}, nth int, node {kinds['node']}, depth int, direction string")


def trace(points: DataFrame, symbol: str, direction: str = "both", depth: int = 2, subsystem: str | None = None, cap: int = 12000, key: str = "id") -> str:
    """The walk as text; both directions share what was visited."""
    depth = min(max(depth, 1), MOST_DEPTH)
    tracer = Tracer(points, subsystem, key)
    lines = [f"═══ TRACE: {symbol!r} (direction={direction}, depth={depth}) ═══"]
    first = tracer._rows(definitions_of(points, symbol, subsystem, key), 1)
    if first:
        r = first[0]
        lines += ["\n── DEFINITION ──", f"File: {r['file']}", f"Lines: {r['line_start']}-{r['line_end']}", f"Kind: {r['kind']}"]
        lines += [f"Signature: {r['sig']}"] if r["sig"] else []
    else:
        lines.append(f"\n[No definition found for {symbol!r}]")
    for name, title, walk in (("callees", "CALLEES (functions this calls)", tracer.callees), ("callers", "CALLERS (functions that call this)", tracer.callers)):
        if direction in (name, "both"):
            lines.append(f"\n── {title} ──")
            found = walk(symbol, depth)
            for i, r in enumerate(found, 1):
                lines += [f"  {i}. {r['symbols'][0] if r['symbols'] else '(unnamed)'}", f"     File: {r['file']}:{r['line_start']}-{r['line_end']}", f"     Kind: {r['kind']}"]
                lines += [f"     Signature: {r['sig']}"] if r["sig"] else [f"     Snippet: {r['head']}"] if r["head"] else []
            if not found:
                lines.append("  (none found)")
    text = "\n".join(lines)
    if len(text) > cap:
        text = text[:cap].rstrip() + "\n\n[Truncated: response exceeded size limit. Try reducing depth or adding a subsystem filter.]"
    return text
