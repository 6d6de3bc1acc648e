"""Rolling operators: over the last d dates of an asset.

``full`` False: a value comes from the first row on, from whatever is present in the window (the semantics of moving-window
kernels with a minimal count of one).  ``full`` True: only from the d-th row on, ranks as shares of the window and extremes
counted from its oldest row.  Decay, product and regression residual always wait for the d-th row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import EPS, INDEX, clip, past, register


def roll(name: str, arrays: int = 1):
    return register(name, "roll", arrays=arrays, scalars=1, window=True)


def _filled(d: int, x: Column) -> Column:
    """``x`` from the asset's d-th row on."""
    return F.when(F.col(INDEX) >= d - 1, x)


def _simple(name: str, agg, empty: float | None = None) -> None:
    @roll(name)
    def build(x: Column, d: int, full: bool) -> Column:
        out = agg(x).over(past(d))
        if full:
            out = _filled(d, out if empty is None else F.coalesce(out, F.lit(empty)))
        return out


_simple("ts_mean", F.avg)
_simple("ts_sum", F.sum, 0.0)
_simple("ts_min", F.min)
_simple("ts_max", F.max)
_simple("ts_std", F.stddev_samp)


@roll("ts_lag")
def ts_lag(x: Column, d: int, full: bool) -> Column:
    return F.lag(x, d).over(past())


@roll("ts_delta")
def ts_delta(x: Column, d: int, full: bool) -> Column:
    return x - F.lag(x, d).over(past())


@roll("ts_rank")
def ts_rank(x: Column, d: int, full: bool) -> Column:
    """Rank of the newest value: centred in [-1, 1], 0 for a lone value; if ``full``, average rank over the number present."""
    seen = F.collect_list(x).over(past(d))
    less, same, n = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x)), F.size(seen)
    if full:
        return _filled(d, F.when(x.isNotNull(), (less + (same + 1) / 2) / n))
    spread = F.coalesce((less + (same - 1) / 2) / F.nullif(n - 1, F.lit(0)), F.lit(0.5))
    return F.when(x.isNotNull(), 2 * (spread - 0.5))


def _extreme(name: str, pick, newest_first: int) -> None:
    @roll(name)
    def build(x: Column, d: int, full: bool) -> Column:
        t = F.col(INDEX)
        if full:
            return _filled(d, pick(t, F.when(x.isNotNull(), F.struct(x, newest_first * -t))).over(past(d)) - (t - d + 1)).cast("double")
        return (t - pick(t, F.when(x.isNotNull(), F.struct(x, newest_first * t))).over(past(d))).cast("double")


#: Of equal extremes the newest counts; if ``full``, the oldest.
_extreme("ts_argmin", F.min_by, -1)
_extreme("ts_argmax", F.max_by, 1)


@roll("ts_decay_linear")
def ts_decay_linear(x: Column, d: int, full: bool) -> Column:
    """Mean with weights d (newest) to 1; a missing value counts as 0 at its weight."""
    seen = F.collect_list(F.coalesce(x, F.lit(0.0))).over(past(d))  # from the oldest on; no difference of large sums, which would lose digits late in a long calendar
    weighted = F.aggregate(F.transform(seen, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return _filled(d, weighted / (d * (d + 1) / 2))


@roll("ts_product")
def ts_product(x: Column, d: int, full: bool) -> Column:
    return _filled(d, F.product(F.coalesce(x, F.lit(1.0))).over(past(d)))


def _moments(x: Column, y: Column, d: int) -> tuple[Column, Column, Column]:
    w = past(d)
    return F.avg(x).over(w), F.avg(y).over(w), F.avg(x * y).over(w)


@roll("ts_cov", arrays=2)
def ts_cov(x: Column, y: Column, d: int, full: bool) -> Column:
    mx, my, mxy = _moments(x, y, d)
    out = mxy - mx * my
    return _filled(d, out) if full else out


@roll("ts_corr", arrays=2)
def ts_corr(x: Column, y: Column, d: int, full: bool) -> Column:
    """Correlation from means that each skip their own missing values; variances are floored, a constant gives 0."""
    mx, my, mxy = _moments(x, y, d)
    w = past(d)

    def spread(v: Column, m: Column) -> Column:
        s = F.avg(v * v).over(w) - m * m
        return F.when(s.isNotNull(), F.sqrt(F.greatest(s, F.lit(EPS))))

    out = clip((mxy - mx * my) / (spread(x, mx) * spread(y, my)), -1.0, 1.0)
    return _filled(d, out) if full else out


@roll("ts_rsquare", arrays=2)
def ts_rsquare(x: Column, y: Column, d: int, full: bool) -> Column:
    r = ts_corr(x, y, d, full)
    return r * r


@roll("ts_regression_residual", arrays=2)
def ts_regression_residual(x: Column, y: Column, d: int, full: bool) -> Column:
    """The newest y less its value on the line of y on x; means skip missing values of their own series."""
    w = past(d)
    both = x.isNotNull() & y.isNotNull()
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    xx = F.sum(x * x).over(w) - F.count(x).over(w) * mx * mx
    xy = F.sum(x * y).over(w) - my * F.sum(F.when(both, x)).over(w) - mx * F.sum(F.when(both, y)).over(w) + F.sum(both.cast("long")).over(w) * mx * my
    beta = F.coalesce(xy, F.lit(0.0)) / (F.coalesce(xx, F.lit(0.0)) + F.lit(EPS))
    return _filled(d, y - beta * x - (my - beta * mx))


@register("ts_skew", "macro", scalars=1, window=True)
def ts_skew(call, x, d):
    """Third moment of deviations, each from its own trailing mean."""
    e = call("sub", x, call("ts_mean", x, d))
    second = call("ts_mean", call("mul", e, e), d)
    return call("_ratio", call("ts_mean", call("mul", call("mul", e, e), e), d), second)


@register("ts_kurt", "macro", scalars=1, window=True)
def ts_kurt(call, x, d):
    """Fourth moment of deviations, each from its own trailing mean, in excess of 3."""
    e = call("sub", x, call("ts_mean", x, d))
    e2 = call("mul", e, e)
    second = call("ts_mean", e2, d)
    return call("_excess", call("ts_mean", call("mul", e2, e2), d), second)


#: Parts of the two macros, not names of the language.
PARTS = {
    "_ratio": lambda third, second: third / F.pow(second + F.lit(EPS), F.lit(1.5)),
    "_excess": lambda fourth, second: fourth / (second * second + F.lit(EPS)) - 3,
}
