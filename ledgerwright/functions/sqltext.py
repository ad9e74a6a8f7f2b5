"""Larger column functions written once as SQL lambdas.

A lambda is parsed in the JVM in one call and binds its argument once, so a function with
many small steps costs one step to build and does not repeat its input in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apply(body: str, argument: Column, name: str = "x") -> Column:
    """Value of the SQL expression `body`, in which `name` stands for `argument`."""
    rows = F.call_function("transform", F.array(argument), F.expr(f"{name} -> {body}"))
    return F.get(rows, F.lit(0))


def let(name: str, value: str, body: str) -> str:
    """SQL text of `body` with `name` bound to `value`."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def quoted(text: str) -> str:
    """SQL string literal without escape processing."""
    return "r'" + text + "'"
