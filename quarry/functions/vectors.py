"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, even if the body names it in a lambda over many elements."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    """V-1: the inner product, added up in double from the first element on; null for different lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Of length one; a zero vector stays as it is."""

    def divided(length: Column) -> Column:
        divisor = F.when(length > 0, length).otherwise(1.0)
        return F.transform(a, lambda x: x.cast("double") / divisor)

    return let(norm(a), divided)


def truncate_and_normalize(a: Column, dimensions: int) -> Column:
    """V-2: the first elements, of length one again."""
    return normalized(F.slice(a, 1, dimensions))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def root_mean_square(samples: Column) -> Column:
    """AG-9: the level of some samples; 0 for none."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)
