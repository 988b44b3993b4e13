"""Vector and geometry functions over array columns. Elements are widened to double before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the hyperbolic, spherical and Euclidean distance, for search and for the library.
SEARCH_WEIGHTS = (0.3, 0.2, 0.5)
LIBRARY_WEIGHTS = (0.4, 0.2, 0.4)
#: Largest squared norm inside the ball, and the least denominator.
BALL_EPS = 1e-5


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: list[float]) -> Column:
    """A vector as a literal of the plan."""
    return F.array(*[F.lit(float(x)) for x in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def sum_squares(v: Column) -> Column:
    return total(F.transform(doubles(v), lambda x: x * x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(sum_squares(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0 or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(F.try_divide(dot(a, b), size))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def spherical(a: Column, b: Column) -> Column:
    """The angle between two vectors; pi if a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.pi()).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), size)))))


def poincare(a: Column, b: Column) -> Column:
    """Distance in the Poincare ball; norms are kept inside it."""
    inside = lambda v: F.least(sum_squares(v), F.lit(1 - BALL_EPS))
    apart = total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))
    below = F.greatest((1 - inside(a)) * (1 - inside(b)), F.lit(BALL_EPS))
    return F.acosh(F.greatest(1 + 2 * apart / below, F.lit(1.0)))


def combined(hyperbolic: Column, sphere: Column, flat: Column, weights: tuple[float, float, float] = SEARCH_WEIGHTS) -> Column:
    """Weighted distance in the product space; the weights are normalised."""
    w = [x / sum(weights) for x in weights]
    return w[0] * hyperbolic + w[1] * sphere + w[2] * flat


def l2_normalise(v: Column) -> Column:
    size = norm(v)
    return F.when(size == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: F.try_divide(x, size)))


def mobius_add(a: Column, b: Column) -> Column:
    """Addition in the Poincare ball."""
    ab, aa, bb = dot(a, b), sum_squares(a), sum_squares(b)
    below = F.greatest(1 + 2 * ab + aa * bb, F.lit(1e-15))
    return F.zip_with(doubles(a), doubles(b), lambda x, y: ((1 + 2 * ab + bb) * x + (1 - aa) * y) / below)


def exp_map_zero(v: Column) -> Column:
    size = F.greatest(norm(v), F.lit(1e-15))
    return F.transform(doubles(v), lambda x: F.tanh(size) * x / size)


def log_map_zero(v: Column) -> Column:
    size = F.least(F.greatest(norm(v), F.lit(1e-15)), F.lit(1 - BALL_EPS))
    return F.transform(doubles(v), lambda x: F.atanh(size) * x / size)


def project_to_ball(v: Column, most: float = 1 - BALL_EPS) -> Column:
    size = norm(v)
    return F.when(size > most, F.transform(doubles(v), lambda x: x * most / size)).otherwise(doubles(v))


def linear(v: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """Projection by a matrix and a bias, normalised; the input is padded with zeros or cut to the matrix."""
    wide = len(weights[0])
    padded = F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), wide)), 1, wide)
    rows = [dot(padded, literal(row)) + (bias[i] if bias else 0.0) for i, row in enumerate(weights)]
    return l2_normalise(F.array(*rows))


def fingerprint(out_counts: Column, in_counts: Column, type_flags: Column, stats: Column) -> Column:
    """Graph fingerprint of 64 numbers: 16 out and 16 in counts as ln(1 + n) / 3, 16 type flags, statistics, zeros."""
    fixed = lambda v, n: F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), n)), 1, n)
    logs = lambda v: F.transform(fixed(v, 16), lambda x: F.log1p(x) / 3)
    return F.concat(logs(out_counts), logs(in_counts), fixed(type_flags, 16), fixed(stats, 16))
