"""Metadata filters: a JSON filter compiles to one column expression.

Metadata is a JSON text, parsed once into a VARIANT. Keys are looked up flat.
Every condition is true or false, never null, so negation is safe. Types are
compared strictly: a number is no string, and only numbers have an order.
Malformed JSON counts as an object without fields.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of regular expressions that are refused, and the weights of their complexity.
FORBIDDEN_SHAPES = (
    r"\(\?!\.\*\)\.\*\$",
    r"\(\.\*\)\+",
    r"\(\.\+\)\+",
    r"\(\.\*\)\*",
    r"\(\.\+\)\*",
    r"\(\.\*\)\{[0-9]+,\}",
    r"\(\.\+\)\{[0-9]+,\}",
    r"\([^)]*\+[^)]*\)\+",
    r"\([^)]*\*[^)]*\)\*",
    r"\([^)]*\|[^)]*\)\+",
    r"\([^)]*\|[^)]*\)\*",
    r"\([^)]*\|[^)]*\)\{[0-9]+,\}",
    r"\\d\+\\d\+",
    r"\\w\+\\w\+",
    r"\\s\+\\s\+",
)
COMPLEXITY = {r"[+*?]|\{[0-9]+,?\}": 3, r"\(": 2, r"\|": 2}
NESTED, NESTED_WEIGHT, MOST_COMPLEX = r"[+*]\).*[+*{]", 10, 20
LONGEST_PATTERN, LONGEST_VALUE, FLAGS = 1000, 10_000, r"[gimsuvy]*"
TYPES = ("null", "boolean", "number", "string", "array", "object")


class FilterError(ValueError):
    """The filter isn't valid."""


def complexity(pattern: str) -> int:
    """Rough cost of a regular expression."""
    score = sum(weight * len(re.findall(shape, pattern)) for shape, weight in COMPLEXITY.items())
    return score + (NESTED_WEIGHT if re.search(NESTED, pattern) else 0)


def is_dangerous(pattern: str) -> bool:
    """True if a pattern might take exponential time, or is very complex."""
    return complexity(pattern) > MOST_COMPLEX or any(re.search(s, pattern) for s in FORBIDDEN_SHAPES)


def _inside(item: Column, key: str) -> Column:
    """Field of a VARIANT object. A path can quote a key in two ways; one that fits neither is looked up in a map."""
    if key and "'" not in key:
        return F.try_variant_get(item, f"$['{key}']", "variant")
    if key and '"' not in key:
        return F.try_variant_get(item, f'$["{key}"]', "variant")
    return F.try_element_at(F.try_variant_get(item, "$", "map<string,variant>"), F.lit(key))


def _compiles(pattern: str) -> bool:
    """Whether Java, which runs the pattern, takes it."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


class Value:
    """A value inside a VARIANT with its type; a missing one is SQL null."""

    def __init__(self, raw: Column):
        self.raw = raw
        shape = F.schema_of_variant(raw)
        self.kind = (
            F.when(raw.isNull(), F.lit(None)).when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean").when(shape == "STRING", "string")
            .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("number")
        )

    def is_a(self, kind: str) -> Column:
        return F.coalesce(self.kind == kind, F.lit(False))

    def number(self) -> Column:
        """The value as a double, null unless it is a number."""
        return F.when(self.is_a("number"), F.try_variant_get(self.raw, "$", "double"))

    def text(self) -> Column:
        return F.when(self.is_a("string"), F.try_variant_get(self.raw, "$", "string"))

    def items(self) -> Column:
        """The elements, null unless it is an array."""
        return F.when(self.is_a("array"), F.try_variant_get(self.raw, "$", "array<variant>"))

    def equals(self, other: Any) -> Column:
        """Deep equality with a JSON value."""
        if other is None:
            return self.is_a("null")
        if isinstance(other, bool):
            found = F.when(self.is_a("boolean"), F.try_variant_get(self.raw, "$", "boolean")) == F.lit(other)
        elif isinstance(other, (int, float)):
            found = self.number() == F.lit(float(other))
        elif isinstance(other, str):
            found = self.text() == F.lit(other)
        else:
            kind = "array" if isinstance(other, (list, tuple)) else "object"
            found = F.when(self.is_a(kind), F.to_json(self.raw) == F.to_json(F.parse_json(F.lit(json.dumps(other)))))
        return F.coalesce(found, F.lit(False))


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _regex(value: Value, operand: Any) -> Column:
    pattern, flags = (operand.get("pattern"), operand.get("flags") or "") if isinstance(operand, dict) else (operand, "")
    if not isinstance(pattern, str) or not isinstance(flags, str) or len(pattern) > LONGEST_PATTERN or not re.fullmatch(FLAGS, flags) or is_dangerous(pattern):
        return F.lit(False)
    if not _compiles(pattern):
        return F.lit(False)
    mode = "".join(f for f in "ims" if f in flags)
    text = value.text()
    return F.coalesce((F.length(text) <= LONGEST_VALUE) & text.rlike((f"(?{mode})" if mode else "") + pattern), F.lit(False))


def _between(value: Value, operand: Any) -> Column:
    if not isinstance(operand, (list, tuple)) or len(operand) != 2 or not all(map(_is_number, operand)):
        return F.lit(False)
    return F.coalesce(value.number().between(float(operand[0]), float(operand[1])), F.lit(False))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


_ORDER = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def _number_condition(number: Column, operator: str, operand: Any) -> Column:
    """An operator on the length of an array."""
    if operator in _ORDER:
        return F.coalesce(_ORDER[operator](number, F.lit(float(operand))), F.lit(False)) if _is_number(operand) else F.lit(False)
    if operator in ("$eq", "$ne"):
        same = F.coalesce(number == float(operand), F.lit(False)) if _is_number(operand) else F.lit(False)
        return same if operator == "$eq" else ~same
    if operator == "$between" and isinstance(operand, (list, tuple)) and len(operand) == 2:
        return F.coalesce(number.between(float(operand[0]), float(operand[1])), F.lit(False))
    if operator in ("$in", "$nin"):
        if not isinstance(operand, (list, tuple)):
            return F.lit(False)
        inside = _any([F.coalesce(number == float(x), F.lit(False)) for x in operand if _is_number(x)])
        return inside if operator == "$in" else ~inside
    raise FilterError(f"unknown operator for a size: {operator}")


def _condition(value: Value, operator: str, operand: Any) -> Column:
    if operator in _ORDER:
        return F.coalesce(_ORDER[operator](value.number(), F.lit(float(operand))), F.lit(False)) if _is_number(operand) else F.lit(False)
    match operator:
        case "$eq":
            return value.equals(operand)
        case "$ne":
            return ~value.equals(operand)
        case "$in" | "$nin":
            if not isinstance(operand, (list, tuple)):
                return F.lit(False)
            inside = _any([value.equals(x) for x in operand])
            return inside if operator == "$in" else ~inside
        case "$contains":
            return F.coalesce(value.text().contains(operand), F.lit(False)) if isinstance(operand, str) else F.lit(False)
        case "$between":
            return _between(value, operand)
        case "$exists":
            return (value.raw.isNotNull() == F.lit(operand)) if isinstance(operand, bool) else F.lit(False)
        case "$type":
            return value.is_a(operand) if operand in TYPES else F.lit(False)
        case "$regex":
            return _regex(value, operand)
        case "$size":
            n = F.size(value.items())
            has = value.is_a("array")
            if _is_number(operand):
                return has & F.coalesce(n == float(operand), F.lit(False))
            if isinstance(operand, dict):
                return has & _all([_number_condition(n.cast("double"), o, x) for o, x in operand.items()])
            return F.lit(False)
        case "$all":
            if not isinstance(operand, (list, tuple)):
                return F.lit(False)
            each = [F.exists(value.items(), _equal_to(w)) for w in operand]
            return value.is_a("array") & _all([F.coalesce(c, F.lit(False)) for c in each])
        case "$elemMatch":
            if isinstance(operand, dict):
                inner = lambda x: _complex(lambda key: _field(x, key), operand)
            else:
                inner = lambda x: Value(x).equals(operand)
            return F.coalesce(F.exists(value.items(), inner), F.lit(False))
    raise FilterError(f"unknown field operator: {operator}")


def _equal_to(other: Any):
    return lambda x: Value(x).equals(other)


def _field(item: Column, key: str) -> Value:
    """Field of an array element; a scalar is an object with the one field ``value``."""
    kind = Value(item)
    inside = _inside(item, key)
    if key != "value":
        return Value(F.when(kind.is_a("object"), inside))
    return Value(F.when(kind.is_a("object"), inside).when(~kind.is_a("array"), item))


def _complex(get, condition: dict) -> Column:
    parts = []
    for key, operand in condition.items():
        if key in ("$and", "$or"):
            if not isinstance(operand, (list, tuple)):
                raise FilterError(f"{key} takes a list")
            parts.append((_all if key == "$and" else _any)([_complex(get, c) for c in operand]))
        elif key == "$not":
            parts.append(~_complex(get, operand))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator: {key}")
        elif isinstance(operand, dict):
            value = get(key)
            parts.append(_all([_condition(value, o, x) for o, x in operand.items()]))
        elif isinstance(operand, (list, tuple)):
            if operand:
                raise FilterError("a list is no condition; use $eq or $in")
        else:
            parts.append(get(key).equals(operand))
    return _all(parts)


def _is_simple(condition: dict) -> bool:
    return not any(k.startswith("$") or (isinstance(v, dict) and any(str(x).startswith("$") for x in v)) for k, v in condition.items())


def compile_filter(condition: dict | None, metadata: str | Column = "metadata") -> Column:
    """The filter as a condition on a JSON text column; an empty filter is always true.

    A filter without any operator compares all fields deeply. Otherwise a field
    takes a scalar or a map of operators. Unknown operators are an error here,
    not row by row.
    """
    if condition is not None and not isinstance(condition, dict):
        raise FilterError("a filter is an object")
    if not condition:
        return F.lit(True)
    parsed = F.try_parse_json(F.col(metadata) if isinstance(metadata, str) else metadata)
    get = lambda key: Value(_inside(parsed, key))
    if _is_simple(condition):
        return _all([get(k).equals(v) for k, v in condition.items()])
    return _complex(get, condition)


class FilterBuilder:
    """Builds a filter step by step; the last condition on a field holds."""

    def __init__(self) -> None:
        self._made: dict[str, Any] = {}

    def _set(self, field: str, value: Any) -> FilterBuilder:
        self._made[field] = value
        return self

    def equals(self, field: str, value: Any) -> FilterBuilder:
        return self._set(field, {"$eq": value})

    def range(self, field: str, least: float | None = None, most: float | None = None) -> FilterBuilder:
        return self._set(field, {k: v for k, v in (("$gte", least), ("$lte", most)) if v is not None})

    def is_in(self, field: str, values: list) -> FilterBuilder:
        return self._set(field, {"$in": list(values)})

    def not_in(self, field: str, values: list) -> FilterBuilder:
        return self._set(field, {"$nin": list(values)})

    def exists(self, field: str, present: bool = True) -> FilterBuilder:
        return self._set(field, {"$exists": present})

    def regex(self, field: str, pattern: str, flags: str = "") -> FilterBuilder:
        """Refuses a pattern that a search would take as matching nothing."""
        if len(pattern) > LONGEST_PATTERN or is_dangerous(pattern) or not re.fullmatch(FLAGS, flags):
            raise FilterError("this pattern isn't allowed")
        return self._set(field, {"$regex": {"pattern": pattern, "flags": flags} if flags else pattern})

    def all_of(self, *filters: dict) -> FilterBuilder:
        return self._set("$and", list(filters))

    def any_of(self, *filters: dict) -> FilterBuilder:
        return self._set("$or", list(filters))

    def none_of(self, condition: dict) -> FilterBuilder:
        return self._set("$not", condition)

    def build(self) -> dict:
        return dict(self._made)
