"""Python values as constant columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "double"
    if isinstance(value, dict):
        return "struct<" + ",".join(f"{k}:{_type(v)}" for k, v in value.items()) + ">"
    if isinstance(value, (list, tuple)):
        return f"array<{_type(value[0]) if value else 'string'}>"
    return "string"


def constant(value) -> Column:
    """A nested constant (text, numbers, lists, dicts as structs). The optimizer folds it once."""
    kind = _type(value)
    if not isinstance(value, (list, dict)):
        return F.lit(value)
    return F.from_json(F.lit(json.dumps(value)), kind)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a higher-order function may be inlined there and computed again
    for each element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]
