"""Compilation of one condition to a two-valued Column: an absent field makes every operator false."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.names import ip_number
from .catalog import INT, IP, STRING, FieldCatalog, RuleError
from .regex import translate

ALIASES = {
    "==": "eq", "equals": "eq", "eq": "eq",
    "!=": "ne", "not_equals": "ne", "not_eq": "ne",
    ">": "gt", "gt": "gt", ">=": "gte", "gte": "gte", "<": "lt", "lt": "lt", "<=": "lte", "lte": "lte",
    "in": "in", "not_in": "not_in", "contains": "contains", "starts_with": "starts_with",
    "regex": "regex", "matches_regex": "regex", "bit_and": "bit_and", "exists": "exists",
}
BOOL = "bool"


@dataclass(frozen=True)
class Literal:
    """A typed rule value: ``many`` for sets."""

    type: str
    value: Any
    many: bool = False


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    literal: Literal
    cost: int

    def column(self, catalog: FieldCatalog) -> Column:
        """True or false for every row, never null."""
        left = catalog.find(self.field).value(catalog.kind_column)
        return F.coalesce(self._test(left), F.lit(False))

    def _test(self, left: Column) -> Column:
        v = self.literal.value
        match self.op:
            case "eq":
                return left == F.lit(v)
            case "ne":
                return left != F.lit(v)
            case "gt":
                return left > F.lit(v)
            case "gte":
                return left >= F.lit(v)
            case "lt":
                return left < F.lit(v)
            case "lte":
                return left <= F.lit(v)
            case "in":
                return left.isin(*v) if v else F.lit(False)
            case "not_in":
                return left.isNotNull() & ~left.isin(*v) if v else left.isNotNull()
            case "contains":
                return F.contains(left, F.lit(v)) if self.literal.type == STRING and not self.literal.many else F.lit(False)
            case "starts_with":
                return F.startswith(left, F.lit(v)) if self.literal.type == STRING and not self.literal.many else F.lit(False)
            case "regex":
                return left.rlike(translate(v))
            case "bit_and":
                return left.bitwiseAND(F.lit(v)) != 0
            case _:
                return left.isNotNull()


def compile_literal(field: str, value: Any) -> Literal:
    """The value decides the type: text that reads as an address is one, also where text is wanted."""

    def bad(what: str) -> RuleError:
        return RuleError("InvalidFieldValue", f"Invalid value '{what}' for field '{field}'")

    if isinstance(value, bool):
        return Literal(BOOL, value)
    if isinstance(value, int):
        return Literal(INT, value)
    if isinstance(value, str):
        ip = ip_number(value)
        return Literal(STRING, value) if ip is None else Literal(IP, ip)
    if isinstance(value, list):
        if not value:
            raise bad("empty array")
        if isinstance(value[0], int) and not isinstance(value[0], bool):
            if any(not isinstance(x, int) or isinstance(x, bool) for x in value):
                raise bad(str(value))
            return Literal(INT, tuple(value), True)
        if isinstance(value[0], str):
            if any(not isinstance(x, str) for x in value):
                raise bad(str(value))
            ips = [ip_number(x) for x in value]
            if all(x is not None for x in ips):
                return Literal(IP, tuple(ips), True)
            return Literal(STRING, tuple(x for x, ip in zip(value, ips) if ip is None), True)
        raise bad("unsupported array type")
    raise bad(str(value))


def compile_condition(field: str, op: str, value: Any, catalog: FieldCatalog) -> Condition:
    """A checked condition with its evaluation cost."""
    known = catalog.find(field)
    if op not in ALIASES:
        raise RuleError("UnknownOp", f"Unknown operation '{op}'")
    op = ALIASES[op]
    if op == "regex":
        if not isinstance(value, str):
            raise RuleError("InvalidRegex", "Invalid regex '<non-string>': regex value must be a string")
        translate(value)
        literal = Literal(STRING, value)
    else:
        literal = compile_literal(field, value)
    kind, scalar = literal.type, not literal.many
    fits = {
        "eq": scalar and kind == known.type,
        "ne": scalar and kind == known.type,
        "in": literal.many and kind == known.type,
        "not_in": literal.many and kind == known.type,
        "contains": known.type == STRING,
        "starts_with": known.type == STRING,
        "regex": known.type == STRING,
        "exists": True,
    }.get(op, scalar and kind == INT and known.type == INT)
    if not fits:
        raise RuleError("InvalidFieldValue", f"Invalid value '{value}' for field '{field}'")
    return Condition(field, op, literal, _cost(op, literal))


def _cost(op: str, literal: Literal) -> int:
    fixed = {"exists": 0, "bit_and": 1, "gt": 1, "gte": 1, "lt": 1, "lte": 1, "starts_with": 5, "contains": 6, "regex": 7}
    if op in fixed:
        return fixed[op]
    if op in ("eq", "ne"):
        return 2 if literal.type == STRING else 1
    return 4 if literal.type == STRING else 3
