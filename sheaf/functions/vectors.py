"""Vector columns: text form, norms and cosine distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_text(c: Column) -> Column:
    """``[1.0,2.0]``; null stays null."""
    return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ","), F.lit("]")))


def from_text(c: Column) -> Column:
    """Inverse of :func:`to_text`; null where the text is no list of numbers."""
    return F.from_json(c, "array<float>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def is_usable(c: Column) -> Column:
    """A vector that can be searched: present, not empty, not all zeros."""
    return c.isNotNull() & F.exists(c, lambda x: x != 0)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a vector is missing, has no length, or the dimensions differ."""
    same = F.size(a) == F.size(b)
    length = norm(a) * norm(b)
    return F.when(same, F.lit(1.0) - F.try_divide(dot(a, b), length))


def unit(c: Column) -> Column:
    """Scaled to length one; a zero vector becomes null."""
    length = norm(c)
    return F.when(length > 0, F.transform(c, lambda x: (x / length).cast("float")))
