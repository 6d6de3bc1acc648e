"""Operators by name: what they take, over what they look, and how they become columns.

An operator's ``build`` gets Columns for its arrays, then its numbers.  Rolling operators also get the frame of their
date-ordered asset partition, cross-sectional ones that of their date.  All of it is built-in Spark: rolling
and cross-sectional operators are window expressions, so a batch of formulas shares exchanges and sorts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-10
ASSET, DATE, INDEX = "code", "date", "t"


@dataclass(frozen=True)
class Operator:
    """kind: 'map' (element by element), 'roll' (an asset's past), 'cross' (a date's assets) or 'macro' (of other operators)."""

    name: str
    kind: str
    build: Callable
    arrays: int = 1
    scalars: int = 0
    window: bool = False
    fold: Callable[..., float] | None = None


OPERATORS: dict[str, Operator] = {}


def register(name: str, kind: str, *, arrays: int = 1, scalars: int = 0, window: bool = False, fold: Callable[..., float] | None = None) -> Callable:
    """Add an operator; a later one of the same name replaces the earlier."""

    def add(build: Callable) -> Callable:
        OPERATORS[name] = Operator(name, kind, build, arrays, scalars, window, fold)
        return build

    return add


def operator_names() -> list[str]:
    return sorted(OPERATORS)


def past(d: int | None = None):
    """An asset's rows up to the current date, the last ``d`` of them if given; the panel must be dense."""
    w = Window.partitionBy(ASSET).orderBy(DATE)
    return w if d is None else w.rowsBetween(1 - d, 0)


def across():
    """All assets of a date."""
    return Window.partitionBy(DATE)


def clean(x: Column) -> Column:
    """Missing instead of NaN."""
    return F.nanvl(x, F.lit(None).cast("double"))


def finite(x: Column) -> Column:
    """Missing instead of NaN or infinity."""
    return F.when(F.abs(clean(x)) < float("inf"), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """``x`` within bounds; missing stays missing."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def _away_from_zero(y: float) -> float:
    return y + EPS * ((y + EPS > 0) - (y + EPS < 0))


def sign(x: float) -> float:
    return float((x > 0) - (x < 0))


FOLDS = {
    "abs": abs, "neg": lambda x: -x, "sign": sign, "log": lambda x: math.log(abs(x) + EPS), "sqrt": lambda x: math.sqrt(abs(x)),
    "inv": lambda x: 1 / _away_from_zero(x), "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y,
    "div": lambda x, y: x / _away_from_zero(y), "max": max, "min": min,
}
