"""Cutting ranked results to what is worth showing: score cliffs, tiers, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import metadata_summary, trim_to_signature

TIERS = ("full", "trimmed", "metadata")
#: Total characters, result limit, share of each tier.
PRESETS = {
    "lookup": (6000, 3, (0.90, 0.10, 0.00)),
    "exploration": (12000, None, (0.60, 0.25, 0.15)),
    "trace": (16000, None, (0.50, 0.30, 0.20)),
}


def before_cliff(ranked: DataFrame, group: list[str], rank: str = "rank", score: str = "score", drop: float = 0.35) -> DataFrame:
    """Rows above the first fall of more than ``drop`` of the score before; two zeros in a row are a fall."""
    order = Window.partitionBy(*group).orderBy(rank)
    before = F.lag(score).over(order)
    now = F.col(score)
    fall = F.when(before == 0, now == 0).otherwise((before - now) / F.when(before != 0, before) > drop)
    cliff = F.min(F.when(F.col("_fall"), F.col(rank))).over(Window.partitionBy(*group))
    marked = ranked.withColumn("_fall", F.coalesce(fall, F.lit(False))).withColumn("_cliff", cliff)
    return marked.where(F.col("_cliff").isNull() | (F.col(rank) < F.col("_cliff"))).drop("_fall", "_cliff")


def within_limit(ranked: DataFrame, preset: str = "exploration", rank: str = "rank") -> DataFrame:
    """What is left of ranked results when the preset has a limit of its own; applied after the cliff."""
    limit = PRESETS[preset][1]
    return ranked if limit is None else ranked.where(F.col(rank) <= limit)


def tier_budgets(ranked: DataFrame, group: list[str], preset: str = "exploration", total: int | None = None, shares: tuple[float, float, float] | None = None, rank: str = "rank", score: str = "score") -> DataFrame:
    """``ranked`` with ``tier`` and ``budget``: by the ratio to the best score, the shares of empty tiers passed on."""
    default_total, _, default_shares = PRESETS[preset]
    shares = shares or default_shares
    budgets = [int((total or default_total) * s) for s in shares]
    whole = Window.partitionBy(*group)
    best = F.first(score).over(whole.orderBy(rank))
    rows = ranked.withColumn("_ratio", F.col(score) / F.when(best > 0, best).otherwise(F.lit(1.0)))
    rows = rows.withColumn("tier", F.when(F.col("_ratio") >= 0.85, TIERS[0]).when(F.col("_ratio") >= 0.55, TIERS[1]).otherwise(TIERS[2]))
    n = [F.sum((F.col("tier") == t).cast("int")).over(whole) for t in TIERS]
    rows = rows.withColumns({f"_n{i}": c for i, c in enumerate(n)})
    counts = [F.col(f"_n{i}") for i in range(3)]

    def each(i: int):
        return F.floor(F.lit(budgets[i]) / F.when(counts[i] > 0, counts[i]))

    def passed_on(to: int, empty: int):
        """What tier ``to`` gets of an empty tier: the first tier that has rows takes all of it."""
        heirs = [t for t in range(3) if t != empty]
        first = F.when(counts[heirs[0]] > 0, F.lit(heirs[0])).otherwise(F.lit(heirs[1]))
        return F.when((counts[empty] == 0) & (first == to), F.floor(F.lit(budgets[empty]) / F.when(counts[to] > 0, counts[to]))).otherwise(F.lit(0))

    per = [F.coalesce(each(i), F.lit(0)) + sum((passed_on(i, e) for e in range(3) if e != i), F.lit(0)) for i in range(3)]
    budget = F.when(F.col("tier") == TIERS[0], per[0]).when(F.col("tier") == TIERS[1], per[1]).otherwise(per[2])
    return rows.withColumn("budget", budget.cast("int")).drop("_ratio", "_n0", "_n1", "_n2")


def tier_texts(rows: DataFrame, content: str = "content") -> DataFrame:
    """``output`` of each row by its tier: whole, its head and tail, or only what it is."""
    c = F.col
    full = F.when(c("budget") > 0, F.substr(c(content), F.lit(1), c("budget"))).otherwise(c(content))
    summary = metadata_summary(c("file"), c("line_start"), c("line_end"), c("kind"), c("crate"), c("symbols"), c("budget"))
    return rows.withColumn("output", F.when(c("tier") == TIERS[0], full).when(c("tier") == TIERS[1], trim_to_signature(c(content), c("budget"))).otherwise(summary))


def hard_cap(response: str, cap: int, total: int) -> str:
    """A response cut at the last whole result that fits."""
    mark = "--- Result "
    if len(response) <= cap:
        return response
    at = response.rfind(mark, 0, cap)
    cut = response[:at].rstrip() if at > 0 else response[:cap]
    return f"{cut}\n\n[Truncated: showing {cut.count(mark)} of {total} results. Use filters (crate=, kind=, subsystem=) or increase max_response_chars to narrow results.]"


def capped(response: Column, cap: int, total: Column) -> Column:
    """``hard_cap`` for a column of responses."""
    mark = F.lit("--- Result ")
    head = F.substr(response, F.lit(1), F.lit(cap))
    before = F.length(head) - F.length(F.substring_index(head, "--- Result ", -1)) - F.length(mark)
    kept = F.when(before > 0, F.regexp_replace(F.substr(head, F.lit(1), before), "(?U)\\s+\\z", "")).otherwise(head)
    n = ((F.length(kept) - F.length(F.replace(kept, mark, F.lit("")))) / F.length(mark)).cast("int")
    note = F.format_string("\n\n[Truncated: showing %d of %d results. Use filters (crate=, kind=, subsystem=) or increase max_response_chars to narrow results.]", n, total)
    return F.when(F.length(response) <= cap, response).otherwise(F.concat(kept, note))


def format_results(rows: DataFrame, cap: int = 12000) -> str:
    """The text of a search answer; ``rows`` are the few that are left after cliff and limit."""
    items = rows.orderBy("rank").select("score", "tier", "output").collect()
    parts = [f"--- Result {i} (score {r['score']:.4f}, {r['tier']}) ---\n{r['output']}" for i, r in enumerate(items, 1)]
    return hard_cap("\n\n".join(parts), cap, len(items))
