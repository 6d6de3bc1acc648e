"""Candidate formulas: products of operators, fields and windows, by pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

from quantaloom.operators import OPERATORS

#: What the patterns range over.
FIELDS = ("open", "high", "low", "close", "volume", "amount", "vwap", "returns")
CORE = ("close", "volume", "returns", "high", "low", "amount", "vwap")
WINDOWS = (3, 5, 10, 20, 40, 60, 120)
CORE_WINDOWS = (3, 5, 10, 20, 40)
VALUE_FIELDS = ("bvps", "roe_pct", "basic_eps", "total_mv", "pe", "pb")


def _named(*prefixes: str, arrays: int = 1, scalars: int = 1) -> tuple[str, ...]:
    return tuple(n for n, op in OPERATORS.items() if n.startswith(prefixes) and op.kind in ("roll", "macro", "cross") and (op.arrays, op.scalars) == (arrays, scalars))


ROLLING = _named("ts_")
PAIRED = _named("ts_", arrays=2)
CROSS = _named("cs_", scalars=0)
UNARY = ("abs", "log", "sign", "sqrt", "neg", "inv")


@dataclass(frozen=True)
class Pattern:
    """``template`` filled with every combination of ``axes`` that ``where`` accepts; the depth at which it comes in."""

    depth: int
    template: str
    axes: dict[str, tuple]
    where: Callable[[dict], bool] = lambda _: True

    def formulas(self) -> Iterator[str]:
        for values in product(*self.axes.values()):
            chosen = dict(zip(self.axes, values, strict=True))
            if self.where(chosen):
                yield self.template.format(**chosen)


def _ordered(x: dict) -> bool:
    return x["f"] < x["g"]


def _different(x: dict) -> bool:
    return x["f"] != x["g"]


_MOVES = ("ts_rank", "ts_std", "ts_mean", "ts_delta")
#: The patterns.
PATTERNS = (
    Pattern(1, "{op}({f}, {w})", {"op": ROLLING, "f": FIELDS, "w": WINDOWS}),
    Pattern(1, "{op}({f})", {"op": CROSS + UNARY, "f": FIELDS}),
    Pattern(2, "{outer}({op}({f}, {w}))", {"outer": CROSS + UNARY, "op": ROLLING, "f": FIELDS, "w": WINDOWS}),
    Pattern(2, "{op}({mix}({f}, {g}), {w})", {"op": ROLLING, "mix": ("div", "sub"), "f": FIELDS, "g": FIELDS, "w": WINDOWS}, _ordered),
    Pattern(2, "{op}({f}, {g}, {w})", {"op": PAIRED, "f": FIELDS, "g": FIELDS, "w": (5, 10, 20)}, _different),
    Pattern(2, "{outer}({op}({f}, {g}, {w}))", {"outer": CROSS, "op": PAIRED, "f": ("close", "volume", "returns"), "g": ("close", "volume", "returns", "amount"), "w": (10, 20)}, _different),
    Pattern(3, "cs_rank({op}({pair}({f}, {g}, {v}), {w}))", {"op": (*_MOVES, "ts_decay_linear"), "pair": ("ts_corr", "ts_cov"), "f": ("close", "returns", "high", "low"), "g": ("volume", "amount", "vwap"), "w": CORE_WINDOWS, "v": CORE_WINDOWS}),
    Pattern(3, "cs_rank({op}({mix}({f}, {g}), {w}))", {"op": ROLLING, "mix": ("div", "sub"), "f": CORE, "g": CORE, "w": CORE_WINDOWS}, _ordered),
    Pattern(3, "sub({outer}({op}({f}, {w})), {outer}({f}))", {"outer": CROSS, "op": (*_MOVES, "ts_skew", "ts_kurt"), "f": CORE, "w": CORE_WINDOWS}),
    Pattern(3, "{op}(cs_rank({f}), {w})", {"op": ("ts_delta", "ts_rank", "ts_std"), "f": CORE, "w": CORE_WINDOWS}),
    Pattern(3, "cs_rank(ts_regression_residual({f}, {g}, {w}))", {"f": ("close", "returns"), "g": ("volume", "amount", "vwap"), "w": (10, 20, 40)}),
    Pattern(3, "cs_rank(div(ts_delta({f}, {v}), ts_std({f}, {w})))", {"f": ("close", "volume", "returns"), "v": (3, 5, 10, 20), "w": (10, 20, 40)}),
    Pattern(3, "cs_rank(ts_decay_linear({f}, {w}))", {"f": ("returns", "volume"), "w": CORE_WINDOWS}),
    Pattern(3, "sub(cs_rank(ts_decay_linear({f}, {w})), cs_rank(ts_mean({f}, {w})))", {"f": ("returns", "volume"), "w": CORE_WINDOWS}),
)
#: Patterns over fundamentals.
VALUE_PATTERNS = (
    Pattern(1, "cs_rank({f})", {"f": VALUE_FIELDS}),
    Pattern(1, "cs_rank(div({f}, close))", {"f": VALUE_FIELDS}),
    Pattern(1, "cs_rank(div({f}, {g}))", {"f": ("basic_eps", "bvps", "roe_pct"), "g": ("close", "total_mv")}),
    Pattern(1, "cs_rank(neg({f}))", {"f": ("total_mv", "pe")}),
)


def candidates(max_depth: int = 3, fundamentals: bool = False) -> list[str]:
    """All distinct formulas up to a depth, sorted; with those over fundamentals if asked for."""
    chosen = [p for p in PATTERNS if p.depth <= max_depth] + list(VALUE_PATTERNS) * fundamentals
    return sorted({f for p in chosen for f in p.formulas()})


def engineered(n_dates: int, fundamentals: tuple[str, ...] = ()) -> dict[str, str]:
    """Feature formulas by name: returns, volatility, volume, correlation, shapes of bars, moments, ranks, extremes, decay, residuals.

    Windows beyond the calendar drop returns over them.
    """
    out: dict[str, str] = {}
    short, long = CORE_WINDOWS, WINDOWS
    eps = "0.0000000001"

    def both(name: str, formula: str, rank_name: str | None = None) -> None:
        out[name] = formula
        out[rank_name or f"cs_rank_{name}"] = f"cs_rank({formula})"

    def over(d: int) -> str:
        return f"(close / ts_lag(close, {d}) - 1)"

    for d in long:
        if d < n_dates:
            both(f"ret_{d}d", over(d))
            out[f"cs_zscore_ret_{d}d"] = f"cs_zscore({over(d)})"
    for d in short:
        both(f"vol_{d}d", f"ts_std(returns, {d})")
        both(f"vol_ratio_{d}", f"volume / (ts_mean(volume, {d}) + {eps})")
        out[f"vol_ma_{d}"] = f"ts_mean(volume, {d})"
        both(f"vol_over_ma_{d}", f"volume / (ts_mean(volume, {d}) + {eps})")
        out[f"amt_over_ma_{d}"] = f"amount / (ts_mean(amount, {d}) + {eps})"
        out[f"vol_trend_{d}"] = f"ts_delta(ts_mean(volume, {d}), {d})"
        both(f"corr_cv_{d}", f"ts_corr(close, volume, {d})")
        both(f"corr_rv_{d}", f"ts_corr(returns, volume, {d})")
        both(f"hl_range_ma_{d}", f"ts_mean((high - low) / (close + {eps}), {d})", f"cs_rank_hl_ma_{d}")
        for name, field in (("close", "close"), ("vol", "volume"), ("ret", "returns")):
            out[f"ts_rank_{name}_{d}"] = f"ts_rank({field}, {d})"
    for d in (10, 20, 40):
        both(f"vol_change_{d}d", f"ts_delta(ts_std(returns, {d}), 5)")
        both(f"kurt_{d}", f"ts_kurt(returns, {d})")
    for name, formula in (("hl_range", "(high - low) / (close + {e})"), ("vwap_dev", "(close - vwap) / (vwap + {e})"), ("intraday", "(close - open) / (open + {e})"), ("body_ratio", "abs(close - open) / (high - low + {e})")):
        both(name, formula.format(e=eps))
    out["upper_shadow"] = f"(high - max(close, open)) / (high - low + {eps})"
    out["lower_shadow"] = f"(min(close, open) - low) / (high - low + {eps})"
    out["typical_dev"] = f"(close - (high + low + close) / 3) / ((high + low + close) / 3 + {eps})"
    for d in (5, 10, 20, 40, 60):
        both(f"skew_{d}", f"ts_skew(returns, {d})")
    for d in (10, 20, 40, 60):
        out[f"close_highD{d}"] = f"close / (ts_max(close, {d}) + {eps})"
        out[f"close_lowD{d}"] = f"close / (ts_min(close, {d}) + {eps})"
        for name, op, field in (("argmax_close", "argmax", "close"), ("argmin_close", "argmin", "close"), ("argmax_vol", "argmax", "volume")):
            out[f"{name}_{d}"] = f"ts_{op}({field}, {d}) / {d}"
    for d in (5, 10, 20, 40):
        both(f"decay_ret_{d}", f"ts_decay_linear(returns, {d})")
        out[f"decay_vol_{d}"] = f"ts_decay_linear(volume, {d})"
        both(f"risk_adj_mom_{d}", f"{over(d)} / (ts_std(returns, {d}) + {eps})")
    for d in (10, 20):
        both(f"resid_cv_{d}", f"ts_regression_residual(close, volume, {d})")
    for f in fundamentals:
        out[f"cs_rank_{f}"], out[f"cs_zscore_{f}"] = f"cs_rank({f})", f"cs_zscore({f})"
        if f in ("pe", "total_mv"):
            out[f"cs_rank_neg_{f}"] = f"cs_rank(neg({f}))"
    return out


def combiner_features(n_dates: int) -> dict[str, str]:
    """The smaller feature set of the combination command."""
    every = engineered(n_dates)
    names = [f"{p}ret_{d}d" for d in (5, 10, 20, 40, 60) for p in ("", "cs_rank_")]
    names += [f"{p}{d}{s}" for d in (5, 10, 20, 40) for p, s in (("vol_", "d"), ("vol_ratio_", ""), ("corr_cv_", ""))]
    names += ["hl_range", "vwap_dev", "intraday", *[f"{p}_{d}" for d in (10, 20, 40) for p in ("skew", "ts_rank_close")]]
    return {n: every[n] for n in names if n in every}
