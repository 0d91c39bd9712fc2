"""Filter trees as Columns.

A tree is a dict: {"op": "and", "args": [...]}, {"op": "eq", "column": ..., "value": ...} and so on. Policies may name an attribute of the
identity with {"$attr": name} where a scalar stands; intents may not, and the two are built by different functions.
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FilterError, Identity

COMPARE = {"eq": operator.eq, "neq": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
JOINED = {"and": operator.and_, "or": operator.or_}
OPERATORS = (*JOINED, "not", *COMPARE, "in", "not_in", "is_null", "is_not_null", "between")


class MissingAttribute(FilterError):
    """A policy names an attribute that the identity lacks."""


def named(column: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def _is_scalar(value: Any) -> bool:
    return value is None or isinstance(value, str | int | float | bool)


def _is_attribute(value: Any) -> bool:
    return isinstance(value, dict) and set(value) == {"$attr"} and isinstance(value["$attr"], str)


def check(tree: Any, columns: frozenset[str] | set[str], attributes: bool) -> None:
    """Raises FilterError unless the tree is valid over these columns; `attributes` allows {"$attr": ...}."""
    if not isinstance(tree, dict):
        raise FilterError(f"a filter must be an object, not {type(tree).__name__}")
    op = tree.get("op")
    if op not in OPERATORS:
        raise FilterError(f"unknown operator {op!r}")
    if op in JOINED or op == "not":
        args = tree.get("args")
        if set(tree) - {"op", "args"} or not isinstance(args, list | tuple) or not args:
            raise FilterError(f"{op} needs a list of args and nothing else")
        if op == "not" and len(args) != 1:
            raise FilterError("not takes one argument")
        for arg in args:
            check(arg, columns, attributes)
        return
    if set(tree) - {"op", "column", "value"}:
        raise FilterError(f"unknown keys in {op}: {sorted(set(tree) - {'op', 'column', 'value'})}")
    if tree.get("column") not in columns:
        raise FilterError(f"unknown column {tree.get('column')!r}")
    value = tree.get("value")
    if op in ("is_null", "is_not_null"):
        if "value" in tree:
            raise FilterError(f"{op} takes no value")
    elif op in ("in", "not_in"):
        if not isinstance(value, list | tuple) or not value or not all(map(_is_scalar, value)):
            raise FilterError(f"{op} needs a list of scalars")
    elif op == "between":
        if not isinstance(value, list | tuple) or len(value) != 2 or not all(map(_is_scalar, value)):
            raise FilterError("between needs two scalars")
    elif "value" not in tree or not (_is_scalar(value) or (attributes and _is_attribute(value))):
        raise FilterError(f"{op} needs a scalar value")


def columns_of(tree: dict) -> set[str]:
    """The columns that a valid tree names."""
    return set().union(*map(columns_of, tree["args"])) if "args" in tree else {tree["column"]}


def _build(tree: dict, value_of) -> Column:
    op = tree["op"]
    if op in JOINED:
        return reduce(JOINED[op], (_build(a, value_of) for a in tree["args"]))
    if op == "not":
        return ~_build(tree["args"][0], value_of)
    c, value = named(tree["column"]), tree.get("value")
    if op in COMPARE:
        return COMPARE[op](c, F.lit(value_of(value)))
    if op in ("in", "not_in"):
        found = c.isin(*[F.lit(value_of(v)) for v in value])
        return found if op == "in" else ~found
    if op == "between":
        return c.between(F.lit(value_of(value[0])), F.lit(value_of(value[1])))
    return c.isNull() if op == "is_null" else c.isNotNull()


def intent_column(tree: dict, columns: frozenset[str] | set[str]) -> Column:
    """The Column of a filter that a user wrote."""
    check(tree, columns, attributes=False)
    return _build(tree, lambda v: v)


def policy_column(tree: dict, columns: frozenset[str] | set[str], identity: Identity) -> Column:
    """The Column of a policy's row filter for one identity."""
    check(tree, columns, attributes=True)

    def value_of(v):
        if not _is_attribute(v):
            return v
        if v["$attr"] not in identity.attributes:
            raise MissingAttribute(v["$attr"])
        return identity.attributes[v["$attr"]]

    return _build(tree, value_of)
