"""Rectangles as four columns x0, y0, x1, y1 (points, y downwards)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part of two intervals, negative if they are apart."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def meets(a: str, b: str, margin: float = 0.0) -> Column:
    """Rectangles of aliases a (grown by margin) and b have a common area."""
    c = lambda t, x: F.col(f"{t}.{x}")
    return (c(a, "x0") - margin < c(b, "x1")) & (c(b, "x0") < c(a, "x1") + margin) & (c(a, "y0") - margin < c(b, "y1")) & (c(b, "y0") < c(a, "y1") + margin)


def contains(box: str, x: Column, y: Column) -> Column:
    c = lambda k: F.col(f"{box}.{k}")
    return (c("x0") <= x) & (x < c("x1")) & (c("y0") <= y) & (y < c("y1"))


def lower_quantile(values: Column, q: float) -> Column:
    """Of the sorted values, the one at index floor(q * (n - 1))."""
    return F.transform(F.array(F.array_sort(values)), lambda v: v[F.floor((F.size(v) - 1) * q).cast("int")])[0]
