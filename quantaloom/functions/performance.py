"""Metrics of daily return series (name, date, r), and overlays that control their risk.

A series is a few thousand rows at most; work is parallel over names.  Missing days are rows with a missing r: they
are skipped, not filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
EPS = 1e-10
MIN_DAYS = 10


def days(name: str = "name") -> Window:
    return Window.partitionBy(name).orderBy("date")


def sharpe(r: Column) -> Column:
    """Annualised mean over population standard deviation; 0 for fewer than MIN_DAYS days or a flat series."""
    sd = F.stddev_pop(r)
    return F.when((F.count(r) >= MIN_DAYS) & (sd >= EPS), F.avg(r) / sd * F.sqrt(F.lit(float(YEAR)))).otherwise(F.lit(0.0))


def annual_return(r: Column) -> Column:
    """Compound return a year; 0 for fewer than 2 days or a loss of everything."""
    whole, n = F.product(1 + r), F.count(r)
    return F.when((n >= 2) & (whole > 0), F.pow(whole, F.lit(float(YEAR)) / n) - 1).otherwise(F.lit(0.0))


def win_ratio(r: Column) -> Column:
    return F.coalesce(F.avg((r > 0).cast("double")), F.lit(0.0))


def equity(series: DataFrame) -> DataFrame:
    """Present days with ``equity``, the product of 1 + r so far, ``peak``, its maximum so far, and ``drawdown`` <= 0."""
    so_far = days().rowsBetween(Window.unboundedPreceding, 0)
    e = series.where("r is not null").withColumn("equity", F.product(1 + F.col("r")).over(so_far))
    e = e.withColumn("peak", F.max("equity").over(so_far))
    return e.withColumn("drawdown", (F.col("equity") - F.col("peak")) / (F.col("peak") + F.lit(EPS)))


def performance(series: DataFrame) -> DataFrame:
    """Per name: sharpe, annual_return, win_ratio, max_drawdown, total_return, n_days."""
    r = F.col("r")
    sums = series.groupBy("name").agg(
        sharpe(r).alias("sharpe"), annual_return(r).alias("annual_return"), win_ratio(r).alias("win_ratio"),
        F.coalesce(F.product(1 + r) - 1, F.lit(0.0)).alias("total_return"), F.count(r).alias("n_days"),
    )
    worst = equity(series).groupBy("name").agg(F.min("drawdown").alias("max_drawdown"))
    return sums.join(worst, "name", "left").withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0)))


def turnover(positions: DataFrame) -> DataFrame:
    """Per name: mean over dates but the first of the summed absolute changes of weights (name, code, date, w), missing weights 0."""
    w = F.coalesce("w", F.lit(0.0))
    change = F.abs(w - F.lag(w).over(Window.partitionBy("name", "code").orderBy("date")))
    daily = positions.withColumn("change", change).groupBy("name", "date").agg(F.sum("change").alias("change"))
    return daily.groupBy("name").agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("turnover"))


def vol_target(series: DataFrame, target: float, lookback: int = 20) -> DataFrame:
    """``r`` scaled down to an annual volatility of ``target``, measured over the ``lookback`` dates before each (five present ones at least)."""
    past = days().rowsBetween(-lookback, -1)
    vol = F.stddev_pop("r").over(past) * F.sqrt(F.lit(float(YEAR)))
    scale = F.when((F.count("r").over(past) >= 5) & (vol >= EPS), F.least(F.lit(1.0), F.try_divide(F.lit(target), vol))).otherwise(F.lit(1.0))
    return series.withColumn("r", F.col("r") * scale)


def drawdown_cap(series: DataFrame, most: float) -> DataFrame:
    """``r`` set to 0 on days that would bring the drawdown above ``most``; (name, date, r).

    Each day depends on the days before it, so a name's series is folded in date order, as one array; names are
    independent of each other.
    """
    gathered = series.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("date", "r"))).alias("rows"))
    kind = dict(series.dtypes)["date"]
    start = F.struct(F.lit(1.0).alias("equity"), F.lit(1.0).alias("peak"), F.expr(f"cast(array() as array<struct<date:{kind},r:double>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        after = s["equity"] * (1 + x["r"])
        over = (s["peak"] - after) / (s["peak"] + F.lit(EPS)) > most
        now = F.when(x["r"].isNull() | over, s["equity"]).otherwise(after)
        kept = F.when(over, F.lit(0.0)).otherwise(x["r"])
        return F.struct(now.alias("equity"), F.greatest(s["peak"], now).alias("peak"), F.array_append(s["out"], F.struct(x["date"].alias("date"), kept.alias("r"))).alias("out"))

    return gathered.select("name", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("x")).select("name", "x.date", "x.r")


def rolling_sharpe(series: DataFrame, window: int = 63, least: int = 20) -> DataFrame:
    """``rolling_sharpe`` over the ``window`` dates before each, from the ``window``-th date on."""
    return _rolling(series, "rolling_sharpe", window, least, lambda m, s: m / s * F.sqrt(F.lit(float(YEAR))))


def rolling_vol(series: DataFrame, window: int = 21, least: int = 10) -> DataFrame:
    """``rolling_vol``, annualised, over the ``window`` dates before each, from the ``window``-th date on."""
    return _rolling(series, "rolling_vol", window, least, lambda m, s: s * F.sqrt(F.lit(float(YEAR))))


def _rolling(series: DataFrame, name: str, window: int, least: int, of) -> DataFrame:
    past = days().rowsBetween(-window, -1)
    sd = F.stddev_pop("r").over(past)
    good = (F.row_number().over(days()) > window) & (F.count("r").over(past) >= least) & (sd >= EPS)
    return series.withColumn(name, F.when(good, of(F.avg("r").over(past), F.nullif(sd, F.lit(0.0)))))


def profit_and_loss(series: DataFrame, notional: float) -> DataFrame:
    """``pnl`` = notional * r, and ``balance`` before each day: the notional compounded over the days before."""
    before = days().rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.product(1 + F.coalesce("r", F.lit(0.0))).over(before), F.lit(1.0))
    return series.withColumn("pnl", F.col("r") * notional).withColumn("balance", grown * notional)
