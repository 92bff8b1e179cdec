"""Rule texts as data: which sets of rules compile, and in which order their conditions are tested."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import FieldCatalog, RuleError
from ..plans.rules import compile_rules, parse_rule


def check_sets(sets: DataFrame, catalog: FieldCatalog, texts: str = "texts") -> DataFrame:
    """``sets`` with ``code`` and ``message`` of the first error of their rules, both empty for a good set.

    ``texts``: the rule texts of a set in load order; null counts as none. Equal sets are compiled once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rules in batch["_texts"]:
                try:
                    compile_rules(list(rules), catalog)
                    out.append(("", ""))
                except RuleError as e:
                    out.append((e.code, str(e)))
            yield pd.DataFrame({"_texts": batch["_texts"], "code": [c for c, _ in out], "message": [m for _, m in out]})

    held = F.coalesce(F.col(texts), F.array().cast("array<string>"))
    distinct = sets.select(held.alias("_texts")).distinct().mapInPandas(run, "_texts array<string>, code string, message string")
    return sets.withColumn("_texts", held).join(distinct, "_texts").drop("_texts")


def condition_orders(rules: DataFrame, catalog: FieldCatalog, text: str = "text") -> DataFrame:
    """``rules`` with ``ops``: the operators of their conditions in the order of testing; null for a bad rule."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rule in batch["_text"]:
                try:
                    out.append([f"{c.op} {c.field}" for c in parse_rule(rule, catalog).conditions])
                except RuleError:
                    out.append(None)
            yield pd.DataFrame({"_text": batch["_text"], "ops": out})

    distinct = rules.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct().mapInPandas(run, "_text string, ops array<string>")
    return rules.join(distinct, rules[text] == distinct["_text"], "left").drop("_text")
