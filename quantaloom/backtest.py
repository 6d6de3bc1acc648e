"""Quantile long/short back-tests of signals (name, code, date, t, value, fwd), a batch at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.functions.ic import average_rank, ic_series, ic_summary, series_of
from quantaloom.functions.performance import drawdown_cap, performance, turnover, vol_target

GROUPS = 5


def ranked(signals: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Rows that have both value and fwd, on dates with enough of them, with average rank ``r`` and count ``n``."""
    both = signals.where("value is not null and fwd is not null").select("name", "code", "date", "t", "value", "fwd")
    day = Window.partitionBy("name", "date")
    return both.select("name", "code", "date", "t", "fwd", average_rank("value", ["name", "date"]).alias("r"), F.count("*").over(day).alias("n")).where(F.col("n") >= 2 * groups)


def _sides(groups: int) -> tuple[Column, Column]:
    r, n = F.col("r"), F.col("n")
    return r > n * (groups - 1) / groups, r <= n / groups


def group_returns(signals: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(name, date, grp, r): mean fwd of each quantile group, 1 the lowest; a date's empty groups are absent.

    Group g holds average ranks in ((g-1) * n / groups, g * n / groups].
    """
    rows = ranked(signals, groups)
    size = F.col("n") / groups
    grp = F.when(F.col("r") <= size, 1)
    for g in range(1, groups):
        grp = grp.when((F.col("r") > g * size) & (F.col("r") <= (g + 1) * size), g + 1)
    return rows.withColumn("grp", grp).where("grp is not null").groupBy("name", "date", "grp").agg(F.avg("fwd").alias("r"))


def long_short(signals: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(name, date, t, r): mean fwd of the top group less that of the bottom group, per date of the signals, missing where there is none."""
    top, bottom = _sides(groups)
    daily = ranked(signals, groups).groupBy("name", "date").agg((F.avg(F.when(top, F.col("fwd"))) - F.avg(F.when(bottom, F.col("fwd")))).alias("r"))
    return signals.select("name", "date", "t").distinct().join(daily, ["name", "date"], "left")


def positions(signals: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(name, code, date, w) for every row of the signals: 1 / size of the top group, -1 / size of the bottom group, else 0."""
    top, bottom = _sides(groups)
    day = Window.partitionBy("name", "date")
    up, down = F.sum(top.cast("int")).over(day), F.sum(bottom.cast("int")).over(day)
    held = ranked(signals, groups).select("name", "code", "date", top.alias("top"), bottom.alias("bottom"), up.alias("up"), down.alias("down"))
    w = F.when((F.col("up") > 0) & (F.col("down") > 0), F.when(F.col("bottom"), -1.0 / F.col("down")).when(F.col("top"), 1.0 / F.col("up")))
    held = held.select("name", "code", "date", w.alias("w"))
    return signals.select("name", "code", "date").join(held, ["name", "code", "date"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def controlled(series: DataFrame, target_vol: float | None = None, max_drawdown: float | None = None, lookback: int = 20) -> DataFrame:
    """A return series under volatility targeting, then a drawdown cap, as far as they are asked for."""
    if target_vol:
        series = vol_target(series, target_vol, lookback)
    if max_drawdown:
        series = drawdown_cap(series.select("name", "date", "r"), max_drawdown)
    return series


def backtest(signals: DataFrame, *, groups: int = GROUPS, target_vol: float | None = None, max_drawdown: float | None = None, lookback: int = 20) -> DataFrame:
    """One row per name: the performance of the (controlled) long/short series, and the turnover of its weights."""
    series = controlled(long_short(signals, groups), target_vol, max_drawdown, lookback)
    return performance(series).join(turnover(positions(signals, groups)), "name")


def group_totals(signals: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(name, grp, total): compound return of each quantile group."""
    return group_returns(signals, groups).groupBy("name", "grp").agg((F.product(1 + F.col("r")) - 1).alias("total"))


def tearsheet(signals: DataFrame, **how) -> DataFrame:
    """IC statistics and back-test of each signal, one row per name."""
    return ic_summary(ic_series(signals)).withColumnRenamed("n_days", "ic_days").join(backtest(signals, **how), "name", "left")


def combination_weights(summary: Mapping[str, tuple[float, float]], names: Sequence[str], method: str) -> dict[str, float]:
    """Signed weights of signals, of absolute sum 1, from their (ic_mean, icir); equal ones for 'equal' and unknown methods.

    The signs come from the mean IC of the whole period: a back-test of such a mix is in-sample.
    """
    if method not in ("ic_weighted", "icir_weighted"):
        return {n: 1 / len(names) for n in names}
    size = {n: abs(summary.get(n, (0.0, 0.0))[method == "icir_weighted"]) for n in names}
    total = sum(size.values()) or 1.0
    return {n: size[n] / total * (1.0 if summary.get(n, (0.0, 0.0))[0] >= 0 else -1.0) for n in names}


def combine(wide: DataFrame, names: Sequence[str], method: str = "ic_weighted") -> DataFrame:
    """(name = method, code, date, t, value, fwd) of a wide frame (code, date, t, fwd, one column per signal): the weighted sum, missing values as 0."""
    from quantaloom.combine import adaptive_combine, weighted

    if not names:
        raise ValueError("No signals")
    if method == "adaptive":
        return adaptive_combine(wide, names)
    found = {}
    if method in ("ic_weighted", "icir_weighted"):
        found = {r["name"]: (r["ic_mean"], r["icir"]) for r in ic_summary(series_of(wide, names)).collect()}  # one row per signal
    weights = combination_weights(found, names, method)
    value = weighted(F.array(*[F.col(f"`{n}`") for n in names]), None, F.array(*[F.lit(weights[n]) for n in names]))
    return wide.select(F.lit(method).alias("name"), "code", "date", "t", value.alias("value"), "fwd")


def library_backtest(wide: DataFrame, names: Sequence[str], method: str = "ic_weighted", **how) -> DataFrame:
    """Back-test of the combination of signals."""
    return backtest(combine(wide, names, method), **how)
