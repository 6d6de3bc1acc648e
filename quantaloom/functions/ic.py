"""Information coefficients: rank correlation of signals with forward returns, and statistics of their series.

Signals are taken long, (name, code, date, t, value, fwd): one set of exchanges serves a whole batch of signals.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ASSETS = 10
MIN_DAYS = 10
FLAT = 1e-10


def to_long(wide: DataFrame, names: Sequence[str], value: str = "value") -> DataFrame:
    """(name, value) rows from the columns ``names``; the other columns are kept."""
    ids = [c for c in wide.columns if c not in names]
    return wide.unpivot(ids, list(names), "name", value)


def _pearson(n: Column, a: Column, b: Column, ab: Column, aa: Column, bb: Column) -> Column:
    """Correlation from sums; missing if either side is flat."""
    va, vb = aa - a * a / n, bb - b * b / n
    return F.when((va > FLAT) & (vb > FLAT), (ab - a * b / n) / F.sqrt(va * vb))


def _by_date(ranked: DataFrame, keys: list[str], least: int) -> DataFrame:
    a, b = F.col("ra").cast("double"), F.col("rb").cast("double")
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    return sums.select(*keys, "n", F.when(F.col("n") >= least, _pearson(*map(F.col, ("n", "a", "b", "ab", "aa", "bb")))).alias("ic"))


def ic_series(signals: DataFrame, *, least: int = MIN_ASSETS) -> DataFrame:
    """(name, date, t, n, ic): per date the Pearson correlation of ordinal ranks (ties by asset) of value and fwd, over assets that have both.

    Missing below ``least`` assets; dates without any asset that has both are absent.
    """
    both = signals.where("value is not null and fwd is not null")
    day = Window.partitionBy("name", "date")
    ranked = both.select("name", "date", "t", F.row_number().over(day.orderBy("value", "code")).alias("ra"), F.row_number().over(day.orderBy("fwd", "code")).alias("rb"))
    return _by_date(ranked, ["name", "date", "t"], least)


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """1-based rank within ``keys``, the mean rank among equals."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def spearman_series(pairs: DataFrame, *, least: int = MIN_ASSETS) -> DataFrame:
    """(name, date, t, n, ic) of rows (name, code, date, t, value, fwd) with average ranks."""
    both = pairs.where("value is not null and fwd is not null")
    ranked = both.select("name", "date", "t", average_rank("value", ["name", "date"]).alias("ra"), average_rank("fwd", ["name", "date"]).alias("rb"))
    return _by_date(ranked, ["name", "date", "t"], least)


def ic_wide(wide: DataFrame, names: Sequence[str], *, least: int = MIN_ASSETS, ties: str = "code") -> DataFrame:
    """``ic_series`` (ties 'code') or ``spearman_series`` (ties 'average') of many signals that are columns of ``wide`` (code, date, t, fwd, ...).

    Rows move once, by date, and a date's assets are ranked together for all signals: nothing is unpivoted, which for hundreds of
    signals would be hundreds of times the rows.  A date's assets and signals must fit a task (8 bytes a cell).
    """
    kind = dict(wide.dtypes)["date"]
    method, names = {"code": "first", "average": "average"}[ties], list(names)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        f = rows.to_pandas()
        f = f[f["fwd"].notna()].sort_values("code", kind="stable")
        x, y = f[names], f["fwd"]
        present = x.notna().to_numpy()
        n = present.sum(0)
        out = np.full(len(names), np.nan)
        patterns, which = np.unique(present, axis=1, return_inverse=True)
        for k in range(patterns.shape[1]):
            here, own = patterns[:, k], np.flatnonzero(which.ravel() == k)
            if here.sum() < max(least, 1):
                continue
            a, b = x.iloc[here, own].rank(method=method).to_numpy(), y[here].rank(method=method).to_numpy()
            a, b = a - a.mean(0), b - b.mean()
            va, vb = (a * a).sum(0), (b * b).sum()
            if vb > FLAT:
                out[own] = np.where(va > FLAT, (a * b[:, None]).sum(0) / np.sqrt(np.where(va > FLAT, va, 1) * vb), np.nan)
        seen = np.flatnonzero(n)
        at = rows.schema
        columns = [pa.array([names[i] for i in seen], pa.string()), pa.array([key[0].as_py()] * len(seen), at.field("date").type), pa.array([key[1].as_py()] * len(seen), pa.int32()), pa.array(n[seen], pa.int64()), pa.array(out[seen], pa.float64(), mask=np.isnan(out[seen]))]
        return pa.Table.from_arrays(columns, names=["name", "date", "t", "n", "ic"])

    return wide.select("code", "date", "t", "fwd", *[F.col(f"`{n}`") for n in names]).groupBy("date", "t").applyInArrow(run, f"name string, date {kind}, t int, n long, ic double")


#: Signals from which on ``series_of`` ranks them as columns.
MANY = 8


def series_of(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """``ic_series`` of signals that are columns of ``wide``."""
    return ic_wide(wide, names) if len(names) >= MANY else ic_series(to_long(wide.select("code", "date", "t", "fwd", *[F.col(f"`{n}`") for n in names]), names))


def signal_correlation(a: DataFrame, b: DataFrame, *, least: int = MIN_ASSETS) -> DataFrame:
    """(correlation, n_dates): mean over dates of the Spearman correlation of two signals (code, date, t, value); 0 if no date counts."""
    both = a.select("code", "date", "t", "value").join(b.select("code", "date", F.col("value").alias("fwd")), ["code", "date"])
    daily = spearman_series(both.withColumn("name", F.lit("a")), least=least)
    return daily.agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("correlation"), F.count("ic").alias("n_dates"))


def icir(x: Column) -> Column:
    """Mean over population standard deviation; 0 for fewer than MIN_DAYS values or a flat series."""
    sd = F.stddev_pop(x)
    return F.when((F.count(x) >= MIN_DAYS) & (sd >= FLAT), F.avg(x) / sd).otherwise(F.lit(0.0))


def t_statistic(x: Column) -> Column:
    """t of the mean (sample standard deviation); 0 for fewer than MIN_DAYS values or a flat series."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= MIN_DAYS) & (sd >= FLAT), F.avg(x) / (sd / F.sqrt(F.count(x)))).otherwise(F.lit(0.0))


def ic_summary(series: DataFrame) -> DataFrame:
    """Per name: ic_mean, ic_std (population), icir, ic_t, ic_positive (share of days above 0), n_days (days with an IC)."""
    ic = F.col("ic")
    return series.groupBy("name").agg(
        F.coalesce(F.avg(ic), F.lit(0.0)).alias("ic_mean"), F.coalesce(F.stddev_pop(ic), F.lit(0.0)).alias("ic_std"), icir(ic).alias("icir"), t_statistic(ic).alias("ic_t"),
        F.coalesce(F.avg((ic > 0).cast("double")), F.lit(0.0)).alias("ic_positive"), F.count(ic).alias("n_days"),
    )


def extremes(series: DataFrame) -> DataFrame:
    """Per name: ic_median, ic_min and ic_max over the days with an IC."""
    return series.groupBy("name").agg(F.median("ic").alias("ic_median"), F.min("ic").alias("ic_min"), F.max("ic").alias("ic_max"))


def hlz_threshold(n_tests: int, significance: float = 0.05) -> float:
    """The t-statistic that a factor must reach after ``n_tests`` tests (Bonferroni, 3.0 at least); 1.96 for a lone test."""
    if n_tests <= 1:
        return 1.96
    return max(NormalDist().inv_cdf(1 - significance / (2 * n_tests)), 3.0)


def out_of_sample(series: DataFrame, n_dates: int, *, ratio: float = 0.6, purge: int = 5, least: int = 20) -> DataFrame:
    """Per name: is_ic, oos_ic, degradation (1 - |oos| / |is|), oos_days and valid, from an IC series split by date index.

    The last ``1 - ratio`` of the dates, less ``purge``, are out of sample.  Not valid: fewer than ``least`` days there.
    """
    split = int(n_dates * ratio)
    start = split + purge
    ic, t = F.col("ic"), F.col("t")
    inside, outside = F.when(t < split, ic), F.when(t >= start, ic)
    stats = series.groupBy("name").agg(F.coalesce(F.avg(inside), F.lit(0.0)).alias("is_ic"), F.coalesce(F.avg(outside), F.lit(0.0)).alias("oos_ic"), F.count(outside).alias("oos_days"))
    loss = F.when(F.abs("is_ic") > FLAT, 1 - F.abs("oos_ic") / F.abs("is_ic")).otherwise(F.lit(1.0))
    if start >= n_dates - least:  # too short to tell
        return stats.select("name", F.lit(0.0).alias("is_ic"), F.lit(0.0).alias("oos_ic"), F.lit(1.0).alias("degradation"), "oos_days", F.lit(False).alias("valid"))
    return stats.select("name", "is_ic", "oos_ic", loss.alias("degradation"), "oos_days", (F.col("oos_days") >= least).alias("valid"))


def smoothed(series: DataFrame, days: int = 20) -> DataFrame:
    """``series`` with ``smooth``: the centred mean of ``days`` ICs by name, missing days counting as 0, the ends padded with 0."""
    near = Window.partitionBy("name").orderBy("date").rowsBetween(-(days // 2), days - days // 2 - 1)
    return series.withColumn("smooth", F.sum(F.coalesce("ic", F.lit(0.0))).over(near) / days)


def histogram(series: DataFrame, bins: int = 50) -> DataFrame:
    """(name, bin, lo, density): ``bins`` equal bins between a name's least and largest IC, the last closed."""
    ends = series.where("ic is not null").groupBy("name").agg(F.min("ic").alias("least"), F.max("ic").alias("most"), F.count("*").alias("n"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("ic") - F.col("least"), width), F.lit(0.0)))).cast("int")
    rows = series.where("ic is not null").select("name", "ic").join(ends, "name").withColumn("bin", at).withColumn("lo", F.col("least") + F.col("bin") * width)
    return rows.groupBy("name", "bin", "lo", "n", width.alias("w")).agg(F.count("*").alias("k")).select("name", "bin", "lo", F.try_divide(F.col("k"), F.col("n") * F.col("w")).alias("density"))


def confidence(n: int, level: float = 0.95) -> float:
    """Half width of a confidence band for a mean IC of n days, in standard deviations."""
    return NormalDist().inv_cdf(0.5 + level / 2) / sqrt(max(n, 1))
