"""Vector algebra on arrays, accumulated in double precision from the first component on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once a row: a lambda's variable instead of an expression inlined at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, floor: float = 1e-12) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def masked_mean(rows: Column, mask: Column, size: int) -> Column:
    """The mean of the rows (array of arrays) whose mask is 1, by dimension; the count is at least 1e-9."""
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    weighted = F.zip_with(rows, mask, lambda r, m: F.transform(r, lambda x: x.cast("double") * m.cast("double")))
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate(weighted, zero, lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    return let(count, lambda n: F.transform(total, lambda x: x / n))
