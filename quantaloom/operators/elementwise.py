"""Element-wise operators.  Missing in, missing out, but for ``max`` and ``min``, which skip a missing side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import EPS, FOLDS, register


def unary(name: str):
    return register(name, "map", fold=FOLDS[name])


def binary(name: str):
    return register(name, "map", arrays=2, fold=FOLDS[name])


def safe(y: Column) -> Column:
    """A denominator pushed away from zero on its own side."""
    return y + F.lit(EPS) * F.signum(y + F.lit(EPS))


unary("abs")(F.abs)
unary("sign")(F.signum)
unary("neg")(lambda x: -x)
unary("log")(lambda x: F.log(F.abs(x) + F.lit(EPS)))
unary("sqrt")(lambda x: F.sqrt(F.abs(x)))
unary("inv")(lambda x: F.try_divide(F.lit(1.0), safe(x)))
binary("add")(lambda x, y: x + y)
binary("sub")(lambda x, y: x - y)
binary("mul")(lambda x, y: x * y)
binary("div")(lambda x, y: F.try_divide(x, safe(y)))
binary("max")(F.greatest)
binary("min")(F.least)


@register("power", "map", arrays=1, scalars=1)
def power(x: Column, n: float) -> Column:
    return F.pow(F.abs(x) + F.lit(EPS), F.lit(n)) * F.signum(x)
