"""Arithmetic on array columns, all of it built from higher-order SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once a row, however often f uses it: it is bound as a lambda's variable,
    so the planner can't write it out at every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(v: Column) -> Column:
    """Sum of an array; 0 for an empty one."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; positions missing on one side give null."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    return bound(F.struct(v.alias("v"), norm(v).alias("n")), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x.cast("double"))))


def shares(v: Column) -> Column:
    """The vector divided by its sum; a vector without mass is spread evenly."""
    return bound(F.struct(v.alias("v"), total(v).alias("s")), lambda y: F.transform(y["v"], lambda x: F.when(y["s"] > 0, x / y["s"]).otherwise(F.lit(1.0) / F.size(y["v"]))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    parts = F.struct(norm(a).alias("a"), norm(b).alias("b"), dot(a, b).alias("d"))
    return bound(parts, lambda s: F.when((s["a"] > 0) & (s["b"] > 0), s["d"] / (s["a"] * s["b"])).otherwise(0.0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def argmax(v: Column) -> Column:
    """Index from 0 of the largest element, the first among equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def log_sum_exp(v: Column) -> Column:
    return bound(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda s: s["top"] + F.ln(total(F.transform(s["v"], lambda x: F.exp(x - s["top"])))))


def softmax(v: Column) -> Column:
    return bound(F.struct(v.alias("v"), log_sum_exp(v).alias("z")), lambda s: F.transform(s["v"], lambda x: F.exp(x - s["z"])))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def rotate(v: Column, by: Column) -> Column:
    """The vector read from index ``by`` on, going round: rotating a chroma by its root puts the root first."""
    n = F.size(v)
    k = F.pmod(by, n)
    return F.concat(F.slice(v, k + 1, n - k), F.slice(v, 1, k))


def blocks_scaled(v: Column, size: int) -> Column:
    """Each block of ``size`` elements scaled to length 1 on its own."""
    starts = F.sequence(F.lit(1), F.size(v), F.lit(size))
    return F.flatten(F.transform(starts, lambda s: unit(F.slice(v, s, size))))


def folded(v: Column, lowest: int, classes: int = 12) -> Column:
    """Elements summed by their class: element i belongs to (lowest + i) mod ``classes``."""
    at = lambda i, c: F.pmod(i + F.lit(lowest), F.lit(classes)) == c
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda c: total(F.transform(v, lambda x, i: F.when(at(i, c), x.cast("double")).otherwise(0.0))),
    )


def tonal_centroid(chroma: Column) -> Column:
    """The 6-dimensional tonal centroid of a 12-class chroma: circles of fifths, minor and major thirds."""
    radius, step = (1.0, 1.0, 0.5), (7 * math.pi / 6, 3 * math.pi / 2, 2 * math.pi / 3)
    rows = []
    for r, w in zip(radius, step, strict=True):
        for f in (math.sin, math.cos):
            rows.append(F.array(*[F.lit(r * f(w * k)) for k in range(12)]))
    both = F.struct(chroma.alias("c"), total(chroma).alias("s"))
    return bound(both, lambda b: F.transform(F.array(*rows), lambda m: F.when(b["s"] > 0, dot(m, b["c"]) / b["s"]).otherwise(0.0)))
