"""Sequence correlation in batch: window plans, with the state machine where its instance cap can bind.

A sequence is over within the sum of its limits, so rows are dealt by shard and slab of time, and
the rows near the start of a slab are also copied into the slab before: every instance lies whole
in the cell that its root is in, and a hot shard is as many cells as its time has slabs. All
plans share that one shuffle.

The next step of an instance is the nearest later match of the expected rule, so each step needs
one pointer per row: the last value, in descending order, over the rows before. The pointer of a
step carries the pointer of the following one, so the sequences of one scope take one sort by
cell and one window pass per step, without joins. Cells in which some rule could have more than
``most`` live instances are streamed in order through the state machine instead. An instance is
evicted only for those that start after it, so a cell is enough for that, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import Rule, RuleSnapshot
from ..sources.shared import cut
from .sequence_state import MOST_INSTANCES, Completed, Correlator

OUT = "shard string, type string, root_rule_id string, seq_id string, root_order string, step_idx int, matched_rule_id string, path array<string>, steps int, event_order string"


#: Length of a slab of time in lengths of the longest sequence: one row in that many has a copy in the slab before.
SLAB = 4
#: Sequences whose pointers are columns of one window pass; bounds the width of its rows.
SEQUENCES_PER_PASS = 16


def utc_micros(ts: Column) -> Column:
    """Microseconds of a time without zone, read as UTC whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def nanos(column: Column, kind: str) -> Column:
    if kind == "timestamp_ntz":
        return utc_micros(column) * 1000
    return F.unix_micros(column) * 1000 if kind == "timestamp" else column.cast("long")


def prepared(matches: DataFrame, snapshot: RuleSnapshot, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only matches that start or advance a sequence, with one key for shard, time, order and pid; ``keep`` adds columns."""
    c = snapshot.catalog
    kind = dict(matches.dtypes)[c.order[0]]
    pid = c.meta.get("pid", "pid")
    listened = sorted(snapshot.listened)
    return matches.where(F.col("rule_id").isin(*listened) if listened else F.lit(False)).select(
        F.concat_ws("/", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in c.shard]).alias("shard"),
        nanos(F.col(c.order[0]), kind).alias("t"),
        F.col(c.order[-1]).cast("long").alias("event"),
        F.col("cand_pos").alias("pos"),
        "rule_id",
        F.col("pid" if "pid" in matches.columns else pid).cast("long").alias("pid"),
        *keep,
    )


def order_text(t: Column, event: Column, pos: Column) -> Column:
    return F.concat_ws(":", t.cast("string"), event.cast("string"), pos.cast("string"))


def length_ns(rule: Rule) -> int:
    return sum(step.within_ns for step in rule.sequence.steps)


def in_cells(rows: DataFrame, snapshot: RuleSnapshot) -> DataFrame:
    """``rows`` with the start of their ``slab`` and whether it is their ``own`` one, dealt by shard and slab.

    Rows that an instance of the slab before may still reach are in that slab, too. A null time is a slab of its own.
    """
    length = max((length_ns(r) for r in snapshot.sequences), default=0)
    width = max(1, SLAB * length)
    into = F.pmod(F.col("t"), F.lit(width).cast("long"))
    home = F.col("t") - into
    slabs = F.when(into < F.lit(length), F.array(home, home - F.lit(width))).otherwise(F.array(home))
    dealt = rows.select("shard", "t", "event", "pos", "rule_id", "pid", into.alias("into"), F.explode(slabs).alias("slab"))
    own = F.col("slab").eqNullSafe(F.col("t") - F.col("into"))
    return dealt.withColumn("own", own).drop("into").repartition("shard", "slab")


def with_crowding(cells: DataFrame, snapshot: RuleSnapshot, most: int = MOST_INSTANCES) -> DataFrame:
    """``cells`` with ``crowded``: whether more than ``most`` matches of a rule lie within the length of its sequence."""
    by_length: dict[int, list[str]] = {}
    for rule in snapshot.sequences:
        by_length.setdefault(length_ns(rule), []).append(rule.id)
    length = F.coalesce(*[F.when(F.col("rule_id").isin(*ids), F.lit(n)) for n, ids in by_length.items()])
    same_rule = Window.partitionBy("shard", "slab", "rule_id").orderBy(F.desc("t"))
    full = F.coalesce(F.lag("t", most).over(same_rule) - F.col("t") <= length, F.lit(False))
    return cells.withColumn("crowded", full).withColumn("crowded", F.max("crowded").over(Window.partitionBy("shard", "slab")))


def _pointers(cells: DataFrame, rules: list[Rule], scope: str) -> DataFrame:
    """Root matches of sequences of one scope; ``step_<i>_0`` leads along the steps of the i-th."""
    group = ["shard", "slab", "pid"] if scope == "pid" else ["shard", "slab"]
    wanted = {r.id for r in rules} | {s.rule_id for r in rules for s in r.sequence.steps}
    # The pid decides no order; read here as well, it keeps the columns of all plans alike, so that they share one shuffle.
    later = Window.partitionBy(*group).orderBy(F.desc("t"), F.desc("event"), F.desc("pos"), F.desc("pid"))
    out = cells.where(F.col("rule_id").isin(*sorted(wanted)))
    if scope == "pid":
        out = out.where(F.col("pid").isNotNull())
    here = [F.col("t").alias("t"), F.col("event").alias("event"), F.col("pos").alias("pos")]
    for to_go in range(max(len(r.sequence.steps) for r in rules)):
        found = {}
        for i, rule in enumerate(rules):
            k = len(rule.sequence.steps) - 1 - to_go
            if k < 0:
                continue
            nxt = [F.col(f"step_{i}_{k + 1}").alias("next")] if to_go else []
            pointer = F.last(F.when(F.col("rule_id") == rule.sequence.steps[k].rule_id, F.struct(*here, *nxt)), ignorenulls=True)
            # A rule that is its own first step advances on the match that started the instance.
            found[f"step_{i}_{k}"] = pointer.over(later.rowsBetween(Window.unboundedPreceding, 0 if k == 0 else -1))
        out = out.withColumns(found)
    return out.where(F.col("own") & F.col("rule_id").isin(*[r.id for r in rules]))


def _record(kind: str, rule: Rule, at: Column, step: int | None = None) -> Column:
    steps = rule.sequence.steps
    done = step is None
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(rule.sequence.id).alias("seq_id"),
        F.lit(step).cast("int").alias("step_idx"),
        F.lit(None if done else steps[step].rule_id).cast("string").alias("matched_rule_id"),
        (F.array(*[F.lit(s.rule_id) for s in steps]) if done else F.lit(None)).cast("array<string>").alias("path"),
        F.lit(len(steps) if done else None).cast("int").alias("steps"),
        order_text(at["t"], at["event"], at["pos"]).alias("event_order"),
    )


def _records(rule: Rule, first: Column) -> Column:
    """The step and completion records of the instance that a root row starts."""
    at, before, alive = first, F.col("t"), F.lit(True)
    out: list[Column] = []
    for k, step in enumerate(rule.sequence.steps):
        alive = alive & at.isNotNull() & (at["t"] <= before + F.lit(step.within_ns))
        out.append(F.when(F.coalesce(alive, F.lit(False)), _record("step", rule, at, k)))
        last = at
        if k + 1 < len(rule.sequence.steps):
            before, at = at["t"], at["next"]
    out.append(F.when(F.coalesce(alive, F.lit(False)), _record("completed", rule, last)))
    return F.array_compact(F.array(*out))


def _events(roots: DataFrame, rules: list[Rule]) -> DataFrame:
    """Step and completion records of the instances that the rows of ``roots`` start; a row has one rule."""
    records = F.coalesce(*[F.when(F.col("rule_id") == r.id, _records(r, F.col(f"step_{i}_0"))) for i, r in enumerate(rules)])
    root = order_text(F.col("t"), F.col("event"), F.col("pos"))
    rows = roots.select("shard", F.col("rule_id").alias("root_rule_id"), root.alias("root_order"), F.explode(records).alias("e"))
    return rows.select("shard", "e.type", "root_rule_id", "e.seq_id", "root_order", "e.step_idx", "e.matched_rule_id", "e.path", "e.steps", "e.event_order")


def _machine(cells: DataFrame, snapshot: RuleSnapshot, most: int, counted_thresholds: bool = False) -> DataFrame:
    """The state machine over the sorted rows of each cell; only instances of the cell's own roots are told."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, machine = None, Correlator(snapshot, most, counted_thresholds)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.shard, r.slab) != cell:
                    cell = (r.shard, r.slab)
                    machine.forget()
                key = f"{r.t}:{r.event}:{r.pos}"
                for e in machine.on_match(r.rule_id, r.t, None if pd.isna(r.pid) else int(r.pid), (key, r.own)):
                    root, own = e.root
                    if not own:
                        continue
                    if isinstance(e, Completed):
                        out.append((r.shard, "completed", e.root_rule, e.sequence, root, None, None, list(e.path), len(e.path), key))
                    else:
                        out.append((r.shard, "step", e.root_rule, e.sequence, root, e.step, e.matched_rule, None, None, key))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            yield frame.astype({"step_idx": "Int32", "steps": "Int32"})

    slim = cells.select("shard", "slab", "t", "event", "pos", "rule_id", "pid", "own")
    return slim.sortWithinPartitions("shard", "slab", "t", "event", "pos").mapInPandas(run, OUT)


def run_exact(rows: DataFrame, snapshot: RuleSnapshot, most: int = MOST_INSTANCES, counted_thresholds: bool = False) -> DataFrame:
    """The state machine over sorted streams: a task holds the state of one cell at a time, not its rows."""
    return _machine(in_cells(rows, snapshot), snapshot, most, counted_thresholds)


def correlate(matches: DataFrame, snapshot: RuleSnapshot, most: int = MOST_INSTANCES, exact: bool = False) -> DataFrame:
    """Step and completion records of all sequences over matches (as ``match_rules`` gives them)."""
    rows = prepared(matches, snapshot)
    if exact or not snapshot.sequences:
        return run_exact(rows, snapshot, most)
    cells = with_crowding(in_cells(rows, snapshot), snapshot, most)
    calm = cells.where(~F.col("crowded"))
    out = _machine(cells.where("crowded"), snapshot, most)
    for scope in ("shard", "pid"):
        rules = [r for r in snapshot.sequences if (r.sequence.scope == "pid") == (scope == "pid")]
        for at in range(0, len(rules), SEQUENCES_PER_PASS):
            chosen = rules[at : at + SEQUENCES_PER_PASS]
            out = out.unionByName(_events(_pointers(calm, chosen, scope), chosen))
    return out


#: Matches in a block of ``correlate_blocks``, about.
BLOCK_ROWS = 50_000


def _in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` dealt by ``block``: spans of time of one length, as many as the rows need."""
    n, first, last = rows.agg(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    width = max(1, -(-((last or 0) - (first or 0) + 1) * block_rows // max(n, 1)))
    return rows.withColumn("block", F.expr(f"(t - {first or 0}) div {width}"))


def _block_pointers(rows: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """Root matches with ``step_<i>_0`` as ``_pointers`` gives them, by a scan of blocks from the end.

    A row finds the next match of a step in its own block, or else takes the first one of the
    nearest later block that has any. Each level of steps is a pass over the blocks and one over
    a row a block; no row is in two blocks, and no block is larger for being of a busy container.
    """
    order = [F.desc("t"), F.desc("event"), F.desc("pos"), F.desc("pid")]
    inside = Window.partitionBy(*keys, "block").orderBy(*order)
    behind = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    here = [F.col("t").alias("t"), F.col("event").alias("event"), F.col("pos").alias("pos")]
    out = rows
    for to_go in range(max(len(r.sequence.steps) for r in rules)):
        found, firsts = {}, {}
        for i, rule in enumerate(rules):
            k = len(rule.sequence.steps) - 1 - to_go
            if k < 0:
                continue
            nxt = [F.col(f"step_{i}_{k + 1}").alias("next")] if to_go else []
            match = F.when(F.col("rule_id") == rule.sequence.steps[k].rule_id, F.struct(*here, *nxt))
            found[f"step_{i}_{k}"] = F.last(match, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0 if k == 0 else -1))
            firsts[f"step_{i}_{k}"] = F.min(match).alias(f"step_{i}_{k}")
        blocks = out.groupBy(*keys, "block").agg(*firsts.values())
        # One row a block and container.
        carried = blocks.select(*[F.col(c).alias(f"of_{c}") for c in (*keys, "block")], *[F.last(c, ignorenulls=True).over(behind).alias(f"later_{c}") for c in firsts])
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*keys, "block")]
        both = out.withColumns(found).join(carried, same).select(*out.columns, *[F.coalesce(c, f"later_{c}").alias(c) for c in found])
        # The next level reads this one twice: as rows and as the first matches of blocks.
        spent = {f"step_{i}_{len(r.sequence.steps) - to_go}" for i, r in enumerate(rules) if to_go < len(r.sequence.steps)}
        out = cut(both.select(*[c for c in both.columns if c not in spent]))
    return out.where(F.col("rule_id").isin(*[r.id for r in rules]))


def correlate_blocks(matches: DataFrame, snapshot: RuleSnapshot, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The records of ``correlate`` without a cap of live instances, for sequences of any length.

    A container with most of the matches is as many blocks as its matches need, however long its
    sequences are, and no match is copied.
    """
    rows = prepared(matches, snapshot).where("t IS NOT NULL")
    out = None
    for scope in ("shard", "pid"):
        chosen = [r for r in snapshot.sequences if (r.sequence.scope == "pid") == (scope == "pid")]
        for at in range(0, len(chosen), SEQUENCES_PER_PASS):
            rules = chosen[at : at + SEQUENCES_PER_PASS]
            wanted = {r.id for r in rules} | {s.rule_id for r in rules for s in r.sequence.steps}
            own = rows.where(F.col("rule_id").isin(*sorted(wanted)))
            if scope == "pid":
                own = own.where(F.col("pid").isNotNull())
            events = _events(_block_pointers(_in_blocks(cut(own), block_rows), rules, ["shard", "pid"] if scope == "pid" else ["shard"]), rules)
            out = events if out is None else out.unionByName(events)
    return out if out is not None else matches.sparkSession.createDataFrame([], OUT)
