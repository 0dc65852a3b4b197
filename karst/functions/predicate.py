"""Metadata predicates (F1-F7): text to a Column over a JSON column and a timestamp.

    clause (AND clause)*      clause := field (= | < | <= | > | >=) literal | field IN (literal, ...)

There is no OR, NOT, != or nesting; anything else is a ``PredicateError``. A field is a top-level key of the JSON text
(``meta.`` before it is optional); ``ts`` is the row's timestamp. Strings stay strings and numbers numbers; where literal and
value differ in kind, the string side is read as a number. true, false, null, objects, arrays, missing keys and invalid
JSON never match. JSON is taken apart by the JVM (VARIANT), so nothing here leaves generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class PredicateError(ValueError):
    pass


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    values: tuple[str | float, ...]


_SPACE = " \t\r\n"
_PART = re.compile(r"'[^']*'|\"[^\"]*\"|<=|>=|[<>=(),]|[^\s<>=(),'\"]+")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def _literal(part: str) -> str | float:
    if part[0] in "'\"":
        return part[1:-1]
    if _NUMBER.fullmatch(part):
        return float(part)
    raise PredicateError(f"not a literal: {part}")


def parse(text: str) -> list[Clause]:
    """The clauses of a predicate, whose optional wrapping (``filter=`` and one pair of quotes) is taken off."""
    s = text.strip(_SPACE)
    if s[:7].lower() == "filter=":
        s = s[7:].strip(_SPACE)
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "'\"":
        s = s[1:-1]
    parts = _PART.findall(s)
    if "".join(parts) != re.sub(r"\s+(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", "", s) or not parts:
        raise PredicateError(f"not a predicate: {text!r}")
    clauses, i = [], 0

    def take() -> str:
        nonlocal i
        if i >= len(parts):
            raise PredicateError(f"incomplete: {text!r}")
        i += 1
        return parts[i - 1]

    while True:
        field = re.sub(r"^meta\.", "", take(), flags=re.I)
        if not re.fullmatch(r"[A-Za-z0-9_-]+", field):
            raise PredicateError(f"not a field: {field!r}")
        op = take().upper()
        if op == "IN":
            if take() != "(":
                raise PredicateError("IN needs a list")
            values = [_literal(take())]
            while (sep := take()) == ",":
                if i < len(parts) and parts[i] == ")":
                    continue
                values.append(_literal(take()))
            if sep != ")":
                raise PredicateError("IN needs a list")
        elif op in ("=", "<", "<=", ">", ">="):
            values = [_literal(take())]
        else:
            raise PredicateError(f"not an operator: {op}")
        clauses.append(Clause(field, op, tuple(values)))
        if i == len(parts):
            return clauses
        if take().upper() != "AND":
            raise PredicateError(f"only AND joins clauses: {text!r}")


def _number(s: str) -> float | None:
    try:
        return float(s)
    except ValueError:
        return None


def _clause(c: Clause, meta: Column, ts: Column) -> Column:
    if c.field == "ts":
        is_text, is_number = F.lit(False), ts.isNotNull()
        text, number = F.lit(None).cast("string"), ts.cast("double")
    else:
        v = F.try_variant_get(F.try_parse_json(meta), f"$['{c.field}']", "variant")
        kind = F.schema_of_variant(v)
        is_text = kind == "STRING"
        is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    as_number = F.when(is_text, text.try_cast("double")).when(is_number, number)

    def equal(lit: str | float) -> Column:
        n = lit if isinstance(lit, float) else _number(lit)
        by_number = as_number == F.lit(n) if n is not None else F.lit(False)
        if isinstance(lit, float):
            return by_number
        return F.when(is_text, text == F.lit(lit)).when(is_number, by_number)

    if c.op in ("=", "IN"):
        p = equal(c.values[0])
        for x in c.values[1:]:
            p = F.coalesce(p, F.lit(False)) | F.coalesce(equal(x), F.lit(False))
    else:
        lit = c.values[0]
        n = lit if isinstance(lit, float) else _number(lit)
        if n is None:
            return F.lit(False)
        p = {"<": as_number < n, "<=": as_number <= n, ">": as_number > n, ">=": as_number >= n}[c.op]
    return F.coalesce(p, F.lit(False))


def predicate(text: str, meta: Column | str, ts: Column | str) -> Column:
    """The predicate as a boolean Column, never null."""
    meta, ts = (F.col(x) if isinstance(x, str) else x for x in (meta, ts))
    out = None
    for c in parse(text):
        out = _clause(c, meta, ts) if out is None else out & _clause(c, meta, ts)
    return out
