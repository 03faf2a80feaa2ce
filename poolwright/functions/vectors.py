"""Vectors as array<double> columns, in built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable
from math import isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    """Elements as doubles, before any arithmetic."""
    return vector.cast("array<double>")


def literal(vector: Iterable[float]) -> Column:
    """A constant vector, as one parsed expression: one call instead of one for each element."""
    values = ", ".join(f"CAST('{float(v)!r}' AS DOUBLE)" if not isfinite(v) else f"{float(v)!r}D" for v in vector)
    return F.expr(f"array({values})")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """2 - 2ab for unit vectors."""
    return F.lit(2.0) - F.lit(2.0) * dot(a, b)


def p_log_p(p: Column) -> Column:
    """p ln p with its limit 0 at p = 0."""
    return F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))


def negative_entropy(probabilities: Column) -> Column:
    return total(F.transform(probabilities, p_log_p))


def first_argmax(values: Column) -> Column:
    """0-based position of the greatest element, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def seeded(seed: int, *key: Column) -> Column:
    """A reproducible pseudo-random order: the MD5 of seed and key. Other SQL engines have the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def rounded(value: Column, places: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(value, places) + F.lit(0.0)
