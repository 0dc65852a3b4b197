"""Capabilities of tokens (D24, F14): operation and key pattern."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Capability:
    op: str  # or "*"
    match: str  # exact, prefix or any
    pattern: str = ""


def allows(capabilities: list[Capability], op: Column | str, key: Column | str) -> Column:
    """Whether any capability covers the operation on the key."""
    op, key = (F.col(x) if isinstance(x, str) else x for x in (op, key))
    out = F.lit(False)
    for c in capabilities:
        on = {"exact": key == c.pattern, "prefix": key.startswith(c.pattern), "any": F.lit(True)}[c.match]
        out = out | (((op == c.op) if c.op != "*" else F.lit(True)) & on)
    return F.coalesce(out, F.lit(False))


def namespace_capabilities(ns: str, mode: str = "read") -> list[Capability]:
    """What a reader, writer or both (``readwrite``) of a memory namespace needs: 6, 10 or 16 capabilities."""
    keys = [f"mem:{ns}:", f"vec:mem:{ns}:", f"bq:vec:mem:{ns}:", f"__meta:mem:{ns}:"]
    run = Capability("exec", "prefix", "mem_")
    read = [*(Capability("get", "prefix", k) for k in keys), run, Capability("subscribe", "prefix", keys[0])]
    write = [*(Capability(o, "prefix", k) for o in ("set", "delete") for k in keys), Capability("publish", "prefix", keys[0]), run]
    return {"read": read, "write": write, "readwrite": read + write}[mode]
