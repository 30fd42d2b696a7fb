"""Vector arithmetic on ``array<double>`` columns and score normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression used inside a lambda is otherwise evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]


def as_double(vec) -> Column:
    return (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    def divide(v):
        return let(F.greatest(norm(v), F.lit(eps)), lambda length: F.transform(v, lambda x: x / length))

    return let(a, divide)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def reprojection_score(q: Column, p: Column, beta: float, dim: int) -> Column:
    """Ridge reprojection of ``q`` on the span of one prototype (lambda = 1/dim).

    With one vector per class the ridge inverse reduces to a scalar:
    a = (q.p) / (p.p + 1/dim); score = -|rho*a*p - q|^2 with rho = e**beta.
    """
    rho = math.exp(beta)
    qp, pp, qq = dot(q, p), dot(p, p), dot(q, q)
    a = qp / (pp + F.lit(1.0 / dim))
    return -(F.lit(rho * rho) * a * a * pp - F.lit(2.0 * rho) * a * qp + qq)
