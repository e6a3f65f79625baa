"""Vector arithmetic, similarities and distances as Column functions over arrays of numbers.

All sums run in double. Zero vectors never raise: each function says what it gives. Vectors that are compared must
have one length; a null vector gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    """A constant vector, for a query that is already on the driver; no join is needed to compare with it."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def _with_each(a: Column, value: Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(component, value) for each component. A lambda's body is evaluated anew for every element, so the value is
    repeated into an array, which evaluates it once."""
    return F.zip_with(doubles(a), F.array_repeat(value, F.size(a)), of)


def scale(a: Column, by: Column | float) -> Column:
    if isinstance(by, Column):
        return _with_each(a, by, lambda x, y: x * y)
    return F.transform(doubles(a), lambda x: x * F.lit(float(by)))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(doubles(a), lambda x: x * x)))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(_with_each(a, n, lambda x, y: F.try_divide(x, y)))


def total(a: Column) -> Column:
    return _fold(doubles(a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either vector is zero or empty. Norms may be given where an index stores them."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), n))


def cosine_clamped(a: Column, b: Column) -> Column:
    """cosine held within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def cosine_or_nan(a: Column, b: Column) -> Column:
    """NaN where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), n))


def cosine_smoothed(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """epsilon is added to the product of the norms."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def unit_interval(cos: Column) -> Column:
    """A cosine moved from [-1, 1] to [0, 1]."""
    return (cos + 1) / 2


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def distance_score(distance: Column) -> Column:
    """1 / (1 + distance)."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union.cast("double")))


def truncate(a: Column, n: int) -> Column:
    """The first n components, as nested-dimension models allow."""
    return F.slice(a, 1, n)


def rounded(a: Column, digits: int = 4) -> Column:
    return F.transform(doubles(a), lambda x: F.round(x, digits))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def std_population(a: Column) -> Column:
    m = mean(a)
    return F.sqrt(F.try_divide(_fold(_with_each(a, m, lambda x, y: (x - y) * (x - y))), F.size(a).cast("double")))


def float32_bytes(a: Column) -> Column:
    return F.size(a) * 4


def quality_checks(a: Column, dimensions: int, bound: float = 2.0, least_norm: float = 0.1) -> Column:
    """A struct of checks: dimension, not empty, all finite, all within the bound, norm large enough, and all of them."""
    some = F.size(a) > 0
    checks = {
        "right_dim": F.size(a) == dimensions,
        "not_empty": some,
        "finite": F.forall(doubles(a), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))),
        "in_range": F.forall(doubles(a), lambda x: F.coalesce(F.abs(x) <= bound, F.lit(False))),
        "norm_ok": F.coalesce(norm(a) > least_norm, F.lit(False)),
    }
    valid = F.lit(True)
    for c in checks.values():
        valid = valid & F.coalesce(c, F.lit(False))
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()], valid.alias("valid"))
