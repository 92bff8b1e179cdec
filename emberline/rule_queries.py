"""Registered queries of large rule sets, with SQL that draws the same rules from their numbers."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from . import queries as Q
from .operators.rule_index import match_indexed
from .plans.rules import RuleSnapshot
from .queries import K, VALUE, query, table

TYPES = ("click", "view", "purchase", "signup", "error")
MANY = 10_000


def drawn_rule(i: int) -> str:
    """The i-th of a family of rules: users, values, texts, prefixes and patterns in turn."""
    n = i // 5
    match i % 5:
        case 0:
            conditions = [("user.id", "==", n % 1500), ("event.value", ">=", i * 7 % 200)]
        case 1:
            conditions = [("event.type", "==", TYPES[n % 5]), ("event.value", ">=", i * 13 % 500), ("event.value", "<=", i * 13 % 500 + n % 3)]
        case 2:
            conditions = [("event.props", "contains", f": {n % 100}}}"), ("user.id", "in", [n % 150, n * 3 % 150, n * 7 % 1500])]
        case 3:
            conditions = [("event.type", "starts_with", TYPES[n % 5][:2]), ("props.k", "==", n % 100), ("event.value", "<", i * 11 % 60), ("user.id", "!=", n % 7)]
        case _:
            conditions = [("event.props", "regex", f": {n % 100}[05]?\\}}$"), ("event.id", "bit_and", 4), ("event.value", ">", n % 90)]
    return Q.rule_toml(f"drawn-{i}", conditions, ("info", "low", "medium", "high")[n % 4])


@lru_cache(maxsize=4)
def drawn_rules(n: int) -> RuleSnapshot:
    return Q.bench(*[drawn_rule(i) for i in range(n)])


_TYPE = "['click', 'view', 'purchase', 'signup', 'error'][n % 5 + 1]"
DRAWN_SQL = f"""WITH r AS (SELECT range AS i, range // 5 AS n FROM range({MANY})),
  e AS (SELECT event_id, event_type, user_id, {VALUE} AS v, {K} AS k, props FROM events)
  SELECT event_id, 'drawn-' || i AS rule_id, i::INT AS cand_pos, ['info', 'low', 'medium', 'high'][n % 4 + 1] AS severity FROM (
    SELECT event_id, i, n FROM e JOIN r ON user_id = n % 1500 WHERE i % 5 = 0 AND v >= i * 7 % 200
    UNION ALL SELECT event_id, i, n FROM e JOIN r ON event_type = {_TYPE} WHERE i % 5 = 1 AND v BETWEEN i * 13 % 500 AND i * 13 % 500 + n % 3
    UNION ALL SELECT event_id, i, n FROM e JOIN r ON k = n % 100 WHERE i % 5 = 2 AND user_id IN (n % 150, n * 3 % 150, n * 7 % 1500)
    UNION ALL SELECT event_id, i, n FROM e JOIN r ON k = n % 100 WHERE i % 5 = 3 AND starts_with(event_type, {_TYPE}[1:2]) AND v < i * 11 % 60 AND user_id <> n % 7
    UNION ALL SELECT event_id, i, n FROM e JOIN r ON n % 100 IN (k, CASE WHEN k >= 10 AND k % 5 = 0 THEN k // 10 END) WHERE i % 5 = 4 AND event_id & 4 <> 0 AND v > n % 90)"""


@query(DRAWN_SQL)
def ruleset_of_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand rules over all events, by the index of their conditions."""
    return match_indexed(table(spark, sf_dir, "events"), drawn_rules(MANY)).select("event_id", "rule_id", "cand_pos", "severity")
