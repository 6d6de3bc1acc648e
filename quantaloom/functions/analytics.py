"""Report analytics over return series (name, date, r) and factor tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log, sqrt
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .performance import EPS, YEAR, annual_return, days, equity, sharpe

COST = 0.0031
#: Cost multipliers of the sensitivity grid.
MULTIPLIERS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)
TRIALS = 22110
#: Categories of formulas and feature names, the first that has a word of its list in them.
CATEGORIES = (
    ("Momentum/Reversal", ()),  # see ``category``
    ("Volatility", ("vol_", "vol(", "std")),
    ("Price-Volume Correlation", ("corr", "cov")),
    ("Rank/Relative", ()),
    ("Higher Moments", ("skew", "kurt")),
    ("Microstructure", ("hl_", "vwap", "intraday", "body", "shadow")),
    ("Decay-Weighted", ("decay",)),
    ("Risk-Adjusted", ("risk_adj",)),
    ("Regression Residual", ("resid", "regression")),
    ("Fundamental", ("pe", "pb", "bvps", "roe", "eps", "mv", "dv_ttm")),
    ("Timing (Argmax/Argmin)", ("argmax", "argmin")),
)
OTHER_CATEGORY = "Formulaic Alpha (Mined)"


def compounded(series: DataFrame, period: str) -> DataFrame:
    """(name, period, r): returns compounded by date pattern, such as ``yyyy`` or ``yyyyMM``."""
    return series.where("r is not null").groupBy("name", F.date_format("date", period).alias("period")).agg((F.product(1 + F.col("r")) - 1).alias("r"))


def monthly_sums(series: DataFrame, value: str = "r") -> DataFrame:
    """(name, period, total) of a value by month."""
    return series.where(F.col(value).isNotNull()).groupBy("name", F.date_format("date", "yyyy-MM").alias("period")).agg(F.sum(value).alias("total"))


def market(panel: DataFrame) -> DataFrame:
    """(date, m): the mean forward return of all assets by date."""
    return panel.groupBy("date").agg(F.avg("fwd").alias("m")).where("m is not null")


def market_model(series: DataFrame, m: DataFrame, least: int = 50) -> DataFrame:
    """Per name: beta, correlation and annual alpha against (date, m); 0, 0 and the own annual mean for ``least`` days or fewer."""
    both = series.where("r is not null").join(m, "date")
    agg = both.groupBy("name").agg(
        F.count("*").alias("n"), F.covar_samp("r", "m").alias("cov"), F.var_samp("m").alias("vm"), F.stddev_samp("r").alias("sr"), F.stddev_samp("m").alias("sm"), F.avg("r").alias("mr"), F.avg("m").alias("mm"),
    )
    enough = F.col("n") > least
    beta = F.when(enough, F.col("cov") / (F.col("vm") + F.lit(EPS))).otherwise(F.lit(0.0))
    corr = F.when(enough, F.coalesce(F.try_divide(F.col("cov"), F.col("sr") * F.col("sm")), F.lit(0.0))).otherwise(F.lit(0.0))
    return agg.select("name", beta.alias("beta"), corr.alias("correlation"), ((F.col("mr") - beta * F.col("mm")) * YEAR).alias("alpha"))


def with_costs(series: DataFrame, turnover: DataFrame, rate: float = COST) -> DataFrame:
    """``r`` less ``rate`` times the mean turnover (name, turnover), every present day."""
    return series.join(turnover, "name").withColumn("r", F.col("r") - F.col("turnover") * rate).drop("turnover")


def cost_grid(series: DataFrame, turnover: DataFrame, rate: float = COST, multipliers: Sequence[float] = MULTIPLIERS) -> DataFrame:
    """(name, multiplier, sharpe, annual_return) at multiples of the costs."""
    grid = series.join(turnover, "name").withColumn("multiplier", F.explode(F.array(*map(F.lit, map(float, multipliers)))))
    net = F.col("r") - F.col("turnover") * rate * F.col("multiplier")
    return grid.withColumn("net", net).groupBy("name", "multiplier").agg(sharpe(F.col("net")).alias("sharpe"), annual_return(F.col("net")).alias("annual_return"))


def regimes(series: DataFrame, block: int = 60, start: int = 60, least: int = 20) -> DataFrame:
    """(name, block, total, vol, regime) of blocks of dates from ``start`` on with at least ``least`` present days.

    Bull above 5 %, Bear below -5 %, else HighVol above 25 % a year, else LowVol.
    """
    at = F.row_number().over(days()) - 1
    rows = series.withColumn("at", at).where((F.col("at") >= start) & F.col("r").isNotNull())
    rows = rows.groupBy("name", F.floor((F.col("at") - start) / block).cast("int").alias("block"))
    rows = rows.agg((F.product(1 + F.col("r")) - 1).alias("total"), (F.stddev_pop("r") * F.sqrt(F.lit(float(YEAR)))).alias("vol"), F.count("*").alias("n")).where(F.col("n") >= least)
    regime = F.when(F.col("total") > 0.05, "Bull").when(F.col("total") < -0.05, "Bear").when(F.col("vol") > 0.25, "HighVol").otherwise("LowVol")
    return rows.select("name", "block", "total", "vol", regime.alias("regime"))


def tail_risk(series: DataFrame, share: float = 0.05) -> DataFrame:
    """Per name: cvar (mean of the worst ``share`` of days, one at least), profit_factor (gains over losses), calmar."""
    rows = series.where("r is not null")
    order, whole = Window.partitionBy("name").orderBy("r", "date"), Window.partitionBy("name")
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    worst = F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("r"))
    gains, losses = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("r") < 0, -F.col("r")).otherwise(0.0))
    agg = rows.groupBy("name").agg(F.avg(worst).alias("cvar"), F.try_divide(gains, losses).alias("profit_factor"), annual_return(F.col("r")).alias("annual"))
    depth = equity(series).groupBy("name").agg(F.min("drawdown").alias("deepest"))
    return agg.join(depth, "name").select("name", "cvar", "profit_factor", F.try_divide("annual", F.abs("deepest")).alias("calmar"))


def deflated_sharpe(series: DataFrame, trials: int = TRIALS) -> DataFrame:
    """Per name: the Sharpe ratio less what the best of ``trials`` is expected to show, over a spread widened by skew and kurtosis.

    Skew and excess kurtosis are corrected for sample size.
    """
    r, n = F.col("r"), F.count("r")
    skew = F.when(n > 2, F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6)).otherwise(F.lit(0.0))
    agg = series.groupBy("name").agg(sharpe(r).alias("sharpe"), F.coalesce(skew, F.lit(0.0)).alias("skew"), F.coalesce(kurt, F.lit(0.0)).alias("kurt"))
    sr = F.col("sharpe")
    spread = F.greatest(F.lit(0.01), F.sqrt(F.greatest(F.lit(0.0), 1 + F.col("skew") * sr / 3 + (F.col("kurt") - 1) / 4 * sr * sr)))
    return agg.select("name", "sharpe", "skew", "kurt", ((sr - sqrt(2 * log(trials))) / spread).alias("deflated"))


def halves(series: DataFrame) -> DataFrame:
    """Per name: first and second, the Sharpe ratios of the halves of the present days."""
    rows = series.where("r is not null").withColumn("k", F.row_number().over(days())).withColumn("n", F.count("*").over(Window.partitionBy("name")))
    early = F.col("k") <= F.floor(F.col("n") / 2)
    return rows.groupBy("name").agg(sharpe(F.when(early, F.col("r"))).alias("first"), sharpe(F.when(~early, F.col("r"))).alias("second"))


def capped_days(series: DataFrame) -> DataFrame:
    """Per name: present days with a return of exactly 0."""
    return series.groupBy("name").agg(F.sum(F.coalesce((F.col("r") == 0).cast("long"), F.lit(0))).alias("capped_days"))


def drawdown_events(series: DataFrame, enter: float = -0.01, leave: float = -0.005) -> DataFrame:
    """(name, started, trough, ended, depth, days, recovery, over): spells from a drawdown below ``enter`` until it is back at ``leave``.

    The peak is 1 at least; ``days`` and ``recovery`` count present days from the start and the trough to the end, which is the last
    day for a spell that is not over.  Whether a day is inside is told by the threshold that was crossed last, so no fold is needed.
    """
    so_far = days().rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.col("peak"), F.lit(1.0))
    e = equity(series).withColumn("drawdown", (F.col("equity") - peak) / (peak + F.lit(EPS))).withColumn("day", F.row_number().over(days()))
    mark = F.when(F.col("drawdown") < enter, 1).when(F.col("drawdown") >= leave, 0)
    e = e.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(so_far), F.lit(0)))
    e = e.withColumn("before", F.coalesce(F.lag("inside").over(days()), F.lit(0)))
    e = e.withColumn("spell", F.sum(F.when((F.col("inside") == 1) & (F.col("before") == 0), 1).otherwise(0)).over(so_far))
    rows = e.where("inside = 1 or before = 1")
    low = F.min(F.when(F.col("inside") == 1, F.struct("drawdown", "day", "date")))
    agg = rows.groupBy("name", "spell").agg(F.min("date").alias("started"), F.min("day").alias("first"), low.alias("low"), F.max("date").alias("ended"), F.max("day").alias("last"), (F.min("inside") == 0).alias("over"))
    return agg.select("name", "started", F.col("low.date").alias("trough"), "ended", F.col("low.drawdown").alias("depth"), (F.col("last") - F.col("first")).alias("days"), (F.col("last") - F.col("low.day")).alias("recovery"), "over")


def milestones(balances: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(name, threshold, date) whenever ``balance`` rises to a threshold from below."""
    rows = balances.withColumn("before", F.lag("balance").over(days())).withColumn("threshold", F.explode(F.array(*map(F.lit, map(float, thresholds)))))
    return rows.where((F.col("before") < F.col("threshold")) & (F.col("balance") >= F.col("threshold"))).select("name", "threshold", "date")


def category(formula: Column) -> Column:
    """The category of a formula or of a feature's name."""
    held = lambda *words: reduce(or_, (F.contains(formula, F.lit(w)) for w in words))
    rules = {
        "Momentum/Reversal": F.startswith(formula, F.lit("ret_")) | F.contains(F.lower(formula), F.lit("momentum")) | F.contains(F.left(formula, F.lit(10)), F.lit("ret")),
        "Rank/Relative": held("rank") & held("close", "volume"),
    }
    out = F
    for name, words in CATEGORIES:
        out = out.when(rules[name] if name in rules else held(*words), name)
    return out.otherwise(OTHER_CATEGORY)


def category_rollup(factors: DataFrame) -> DataFrame:
    """(category, n, mean_abs_ic, best_ic) of (expression, ic_mean)."""
    size = F.abs("ic_mean")
    return factors.groupBy(category(F.col("expression")).alias("category")).agg(F.count("*").alias("n"), F.avg(size).alias("mean_abs_ic"), F.max_by("ic_mean", F.struct(size, "ic_mean")).alias("best_ic"))


#: A report's checks by name, with what must be above (True) or below (False) which bound.
CHECKS = {
    "net_sharpe": (True, 1.0),
    "max_drawdown": (False, 0.15),
    "oos_ratio": (True, 0.6),
    "calmar": (True, 1.0),
    "profit_factor": (True, 1.5),
    "alpha_retention": (True, 60.0),
    "beta": (False, 0.1),
    "deflated_sharpe": (True, 0.0),
}


def checks(figures: dict[str, float]) -> dict[str, bool]:
    """Whether each figure of CHECKS passes; those with an upper bound go by their size."""
    return {k: figures[k] > bound if above else abs(figures[k]) < bound for k, (above, bound) in CHECKS.items()}


def traffic_light(net_sharpe: float, max_drawdown: float, oos_ratio: float) -> str:
    """GREEN: deploy; YELLOW: fix, then look again; RED: drop."""
    deep = abs(max_drawdown)
    if net_sharpe > 2 and deep < 0.06 and oos_ratio > 0.5:
        return "GREEN"
    return "YELLOW" if net_sharpe > 1 and deep < 0.1 else "RED"


def report_card(series: DataFrame, turnover: DataFrame, m: DataFrame, rate: float = COST, trials: int = TRIALS) -> DataFrame:
    """Per name: the figures of CHECKS, how many of the checks pass (``passed``), and the traffic light (``light``).

    Costs are those of the mean turnover (name, turnover); ``m`` is the market (date, m).
    """
    net = with_costs(series, turnover, rate).groupBy("name").agg(sharpe(F.col("r")).alias("net_sharpe"), annual_return(F.col("r")).alias("net"))
    gross = series.groupBy("name").agg(annual_return(F.col("r")).alias("gross"))
    depth = equity(series).groupBy("name").agg(F.min("drawdown").alias("max_drawdown"))
    parts = [gross, depth, halves(series), tail_risk(series).drop("cvar"), market_model(series, m).select("name", "beta"), deflated_sharpe(series, trials).select("name", F.col("deflated").alias("deflated_sharpe"))]
    card = reduce(lambda a, b: a.join(b, "name"), parts, net)  # each has one row per name
    card = card.withColumn("oos_ratio", F.col("second") / (F.col("first") + F.lit(EPS))).withColumn("alpha_retention", F.coalesce(F.try_divide("net", "gross"), F.lit(0.0)) * 100)
    passes = [F.coalesce((F.col(k) > bound if above else F.abs(k) < bound).cast("int"), F.lit(0)) for k, (above, bound) in CHECKS.items()]
    deep = F.abs("max_drawdown")
    light = F.when((F.col("net_sharpe") > 2) & (deep < 0.06) & (F.col("oos_ratio") > 0.5), "GREEN").when((F.col("net_sharpe") > 1) & (deep < 0.1), "YELLOW").otherwise("RED")
    return card.select("name", *CHECKS, reduce(lambda a, b: a + b, passes).alias("passed"), light.alias("light"))
