"""All rules against all events in one scan."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Field, FieldCatalog
from ..plans.rules import Action, Rule, RuleSnapshot

#: Rules whose tests share one array expression; bounds the size of a generated method.
RULES_PER_ARRAY = 100
MATCH_TYPE = "array<struct<rule_id:string,rule_hash:string,severity:string,cand_pos:int>>"


def match_array(snapshot: RuleSnapshot, rules: list[Rule] | None = None, catalog: FieldCatalog | None = None) -> Column:
    """The rules that match a row, in evaluation order; ``catalog`` says where their fields are, if not the snapshot's."""
    catalog = catalog or snapshot.catalog
    order = {r.id: i for i, r in enumerate(snapshot.candidates)}
    wanted = None if rules is None else {r.id for r in rules}
    chosen = [r for r in snapshot.candidates if wanted is None or r.id in wanted]
    hits = [
        F.when(r.predicate(catalog), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.hash).alias("rule_hash"), F.lit(r.severity).alias("severity"), F.lit(order[r.id]).alias("cand_pos")))
        for r in chosen
        if r.kinds is None or r.kinds
    ]
    parts = [F.array_compact(F.array(*hits[i : i + RULES_PER_ARRAY])) for i in range(0, len(hits), RULES_PER_ARRAY)]
    if not parts:
        return F.array().cast(MATCH_TYPE)
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))


def with_fields(events: DataFrame, snapshot: RuleSnapshot) -> tuple[DataFrame, FieldCatalog]:
    """``events`` with a column for every field that rules use and that takes computing, and where fields are then.

    Each is computed once a row, however many rules ask for it.
    """
    c = snapshot.catalog
    used = {c.find(condition.field).column for rule in snapshot.rules for condition in rule.conditions}
    names = {column: f"_field{i}" for i, column in enumerate(sorted(x for x in used if not re.fullmatch(r"\w+", x)))}

    def moved(f: Field) -> Field:
        return replace(f, column=names.get(f.column, f.column))

    slim = FieldCatalog([moved(f) for f in c.fields.values()], c.kind_column, c.shard, c.order, c.kinds, {k: moved(f) for k, f in c.suffixes.items()}, c.meta)
    return events.select("*", *[F.expr(column).alias(name) for column, name in names.items()]), slim


def match_rules(events: DataFrame, snapshot: RuleSnapshot, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per match: order and shard columns, ``rule_id, rule_hash, severity, cand_pos, uid, pid, comm``.

    One scan and one generator, whatever the number of rules; no join. ``keep`` adds columns.
    """
    c = snapshot.catalog
    base = list(dict.fromkeys([*c.order, *c.shard, c.kind_column, *keep]))
    meta = [F.expr(column).alias(f"meta_{name}") for name, column in c.meta.items()]
    events, slim = with_fields(events, snapshot)
    found = events.select(*base, *meta, F.explode(match_array(snapshot, catalog=slim)).alias("m"))
    return found.select(*base, "m.*", *[F.col(f"meta_{name}").alias(name) for name in c.meta if name not in base])


def action_struct(action: Action, snapshot: RuleSnapshot) -> Column:
    """An action with its parameter resolved from the row; its parameter is null where the field is absent."""
    v = action.value
    value = F.lit(v.literal) if v.field is None else snapshot.catalog.find(v.field).value(snapshot.catalog.kind_column)

    def only(kind: str, typed: Column, to: str) -> Column:
        return typed.cast(to) if action.kind == kind else F.lit(None).cast(to)

    pid = F.when((value.cast("long") >= 0) & (value.cast("long") < 2**32), value.cast("long")) if action.kind == "kill_process" else value
    return F.struct(F.lit(action.kind).alias("kind"), only("kill_process", pid, "long").alias("pid"), only("block_ip", value, "long").alias("ip"), only("deny_exec", value, "string").alias("path"))


def response_columns(snapshot: RuleSnapshot, trigger: str) -> Column:
    """The resolved actions of the row's ``rule_id``, null for rules without that trigger."""
    out = F.lit(None).cast("array<struct<kind:string,pid:bigint,ip:bigint,path:string>>")
    for rule in snapshot.rules:
        if rule.trigger == trigger:
            out = F.when(F.col("rule_id") == rule.id, F.array(*[action_struct(a, snapshot) for a in rule.actions])).otherwise(out)
    return out


def respond(rows: DataFrame, snapshot: RuleSnapshot, trigger: str) -> DataFrame:
    """Audit rows of the responses that ``rows`` (events with a ``rule_id``) ask for; nothing is executed.

    ``executed`` are the actions up to the first that cannot be resolved, as execution stops there.
    """
    c = snapshot.catalog
    asked = rows.withColumn("actions", response_columns(snapshot, trigger)).where(F.col("actions").isNotNull())

    def ready(a: Column) -> Column:
        return F.coalesce(a["pid"], a["ip"]).isNotNull() | a["path"].isNotNull()

    success = F.forall("actions", ready)
    return asked.select(
        *c.order,
        "rule_id",
        F.lit(trigger).alias("trigger"),
        "actions",
        *[F.expr(column).alias(name) for name, column in c.meta.items()],
        success.alias("success"),
        F.when(success, F.lit("Done")).otherwise(F.lit("Failed")).alias("status"),
    )
