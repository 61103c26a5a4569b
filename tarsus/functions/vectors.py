"""Vector arithmetic on array columns, JVM-side and in double precision (MTH1, MTH2, MTH3, MTH4, MTH5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable binds it, where a repeated expression inside a
    higher-order function would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, least: float = 1e-12) -> Column:
    return let(doubles(v), lambda u: let(F.greatest(norm(u), F.lit(least)), lambda length: F.transform(u, lambda x: x / length)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def combine(base: Column, residual: Column, alpha: Column) -> Column:
    """base + alpha * residual, element by element."""
    return F.zip_with(base, residual, lambda x, y: x + alpha * y)


def cross_entropy(logits: Column, target: Column) -> Column:
    """logsumexp(logits) - logits[target], target counted from 0."""
    return let(logits, lambda u: let(F.array_max(u), lambda most: most + F.ln(total(F.transform(u, lambda x: F.exp(x - most)))) - F.get(u, target)))


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def unit_norm(v: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def stable_share(key: Column, seed: str) -> Column:
    """A number in [0, 2^32) drawn from a salted SHA-256, equal on every engine and at every partitioning."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "|"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
