"""Conditions over JSON payloads, arithmetic formulas and small schemas, compiled to column expressions."""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONDITION = re.compile(r"^\s*(\$(?:\.[\w-]+)+)?\s*(==|!=|>=|<=|>|<|=)\s*(.*?)\s*$")
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/()<>]))")
#: Tolerance of equality, and named constants of formulas.
TOLERANCE, CONSTANTS = 1e-12, {"pi": math.pi, "e": math.e}


def condition(text: str | None, payload: Column) -> Column:
    """Whether a payload meets ``$.path op value`` or, as a number itself, ``op value``. An empty condition always holds;
    anything else that cannot be read, a missing payload or path, or a number on one side of an order only, does not."""
    if text is None or not text.strip():
        return F.lit(True)
    m = _CONDITION.match(text)
    if not m:
        return F.lit(False)
    path, op, value = m.groups()
    value = value.strip("\"'")
    found = F.get_json_object(payload, path) if path else payload
    a, b = found.try_cast("double"), F.lit(value).try_cast("double")
    numeric = a.isNotNull() & b.isNotNull()
    compare = lambda x, y: {"==": x == y, "=": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]
    return F.coalesce(F.when(numeric, compare(a, b)).otherwise(compare(found, F.lit(value))), F.lit(False))


def formula(text: str, columns: dict[str, Column], lenient_equals: bool = False) -> Column:
    """An arithmetic expression with at most one comparison over named columns (``+ - * /``, parentheses, ``pi``, ``e``).

    A comparison gives a boolean, equality within a tolerance. Null where a value is null or no number, or by division by
    zero. Raises ``ValueError`` for a text that is no formula or an unknown name; a single ``=`` is one only if lenient.
    """
    if lenient_equals:
        text = re.sub(r"(?<![<>=!])=(?!=)", "==", text)
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:]!r}")
        tokens.append(m.groups())
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place][2] if place < len(tokens) else None

    def take() -> tuple:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the formula ends too early")
        place += 1
        return tokens[place - 1]

    def atom() -> Column:
        number, name, sign = take()
        if number is not None:
            return F.lit(float(number))
        if name is not None:
            if name in columns:
                return columns[name].try_cast("double")
            if name in CONSTANTS:
                return F.lit(CONSTANTS[name])
            raise ValueError(f"unknown name {name}")
        if sign == "(":
            inner = level(0)
            if take()[2] != ")":
                raise ValueError("a bracket is not closed")
            return inner
        if sign == "-":
            return -atom()
        raise ValueError(f"unexpected {sign}")

    def level(k: int) -> Column:
        signs = (("+", "-"), ("*", "/"))
        if k == len(signs):
            return atom()
        left = level(k + 1)
        while peek() in signs[k]:
            sign = take()[2]
            right = level(k + 1)
            left = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}[sign](left, right)
        return left

    out = level(0)
    if (sign := peek()) in ("==", "!=", "<", ">", "<=", ">="):
        take()
        right = level(0)
        near = F.abs(out - right) <= TOLERANCE
        out = {"==": near, "!=": ~near, "<": out < right, ">": out > right, "<=": out <= right, ">=": out >= right}[sign]
    if place != len(tokens):
        raise ValueError("the formula goes on after its end")
    return out


def fits_schema(payload: Column, schema: str | dict) -> Column:
    """Whether a JSON payload has a schema's required fields, the types of its properties and of their items."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    value = F.try_parse_json(payload)
    kinds = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}

    def check(path: str, rule: dict) -> list[Column]:
        out = []
        here = F.try_variant_get(value, path, "variant")
        if (kind := rule.get("type")) in kinds:
            out.append(here.isNull() | F.schema_of_variant(here).rlike(f"^{kinds[kind]}$"))
        for name in rule.get("required", []):
            out.append(F.try_variant_get(value, f"{path}.{name}", "variant").isNotNull())
        for name, inner in rule.get("properties", {}).items():
            out.extend(check(f"{path}.{name}", inner))
        item = rule.get("items", {}).get("type")
        if item in ("string", "integer", "number", "boolean"):
            spark_kind = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}[item]
            out.append(here.isNull() | F.try_variant_get(value, path, f"array<{spark_kind}>").isNotNull())
        return out

    return F.coalesce(reduce(lambda a, b: a & b, check("$", schema), value.isNotNull()), F.lit(False))
