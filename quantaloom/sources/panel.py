"""Panels: one row per asset and date, dense, with prices, volumes and returns.

The panel stays long.  What is small by nature is kept small: the calendar (one row per date) is gathered once as an
index; rows are never pivoted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
BARS = (*PRICES, "volume", "amount")
FEATURES = (*BARS, "vwap", "returns")
#: Column names of vendors' daily bars, English and Chinese (fixed values).
VENDOR_NAMES = {"ts_code": "code", "trade_date": "date", "vol": "volume", "日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount", "股票代码": "code"}


@dataclass(frozen=True)
class Panel:
    """``df``: code, date, t (0-based index of the date), features; ``n_dates``: length of the calendar."""

    df: DataFrame
    n_dates: int

    def head(self, n: int) -> Panel:
        """The panel of the first n assets by code."""
        codes = self.df.select("code").distinct().orderBy("code").limit(n)
        return Panel(self.df.join(codes, "code", "left_semi"), self.n_dates)


def missing(x: Column) -> Column:
    """A number, or missing for NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def normalised(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Bars with the columns' own names, numbers coerced (what is no number is missing), and close times volume for a missing amount."""
    df = df.withColumnsRenamed(names or VENDOR_NAMES)
    df = df.withColumns({c: missing(F.col(c).try_cast("double")) for c in BARS if c in df.columns})
    value = F.col("close") * F.col("volume")
    return df.withColumn("amount", F.coalesce("amount", value) if "amount" in df.columns else value)


class BarSource(Protocol):
    """Where daily bars come from: a vendor's client, for instance."""

    def history(self, spark: SparkSession, code: str, start: str, end: str) -> DataFrame:
        """An asset's bars between two dates, under the vendor's names or ours."""
        ...


def frames_of(spark: SparkSession, source: BarSource, codes: Iterable[str], start: str, end: str) -> dict[str, DataFrame]:
    """Bars of each asset from a source, normalised."""
    return {c: normalised(source.history(spark, c, start, end)) for c in codes}


def panel_of_frames(frames: Mapping[str, DataFrame], *, max_assets: int | None = 300, min_days: int = 101, min_dates: int = 60) -> Panel:
    """The panel of frames of bars by asset, on the dates that all assets with at least ``min_days`` of them share."""
    if not frames:
        raise ValueError("No assets")
    parts = [f.select(F.lit(c).alias("code"), "date", *BARS) for c, f in frames.items()]
    while len(parts) > 1:  # in pairs, so that the plan is no deeper than the logarithm of the assets
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return build_panel(parts[0], max_assets=max_assets, min_days=min_days, min_dates=min_dates)


def read_bars(spark: SparkSession, paths: str | Iterable[str], names: dict[str, str] | None = None) -> DataFrame:
    """Daily bars (code, date, open, high, low, close, volume, amount and whatever else) of one or more parquet paths.

    Columns are renamed by ``names``; numbers are coerced, what is no number is missing; a missing amount is close times volume.
    """
    return normalised(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)), names)


def parse_date(c: Column) -> Column:
    """A date from yyyymmdd (text or number), yyyy-mm-dd, a date or a timestamp; null if it is none."""
    text = F.regexp_replace(c.cast("string"), "-", "")
    return F.to_date(F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")))


def universe(bars: DataFrame, max_assets: int | None = 300, min_days: int = 500) -> DataFrame:
    """(code, n_days) of the assets with at least ``min_days`` dates, the ``max_assets`` longest of them, ties by code."""
    days = bars.groupBy("code").agg(F.count("date").alias("n_days")).where(F.col("n_days") >= min_days)
    return days if max_assets is None else days.orderBy(F.desc("n_days"), "code").limit(max_assets)


def common_dates(bars: DataFrame, assets: DataFrame) -> DataFrame:
    """(date) on which every one of ``assets`` has a row."""
    whole = assets.agg(F.count("*").alias("whole"))
    seen = bars.join(assets.select("code"), "code", "left_semi").groupBy("date").agg(F.count_distinct("code").alias("n"))
    return seen.join(F.broadcast(whole), F.col("n") == F.col("whole"), "left_semi").select("date")


def calendar(spark: SparkSession, dates: DataFrame) -> tuple[DataFrame, int]:
    """(date, t) of distinct dates, and their number.  One small row per trading date."""
    found = sorted(r[0] for r in dates.select("date").distinct().collect() if r[0] is not None)
    kind = dates.schema["date"].dataType.simpleString()
    return spark.createDataFrame(list(zip(found, range(len(found)), strict=True)), f"date {kind}, t int"), len(found)


def derive(df: DataFrame) -> DataFrame:
    """vwap (the close where nothing was traded), and returns against the previous date of the calendar."""
    vwap = F.when(F.col("volume") > 0, F.try_divide("amount", "volume")).otherwise(F.col("close"))
    before = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
    return df.withColumn("vwap", vwap).withColumn("returns", F.try_divide(F.col("close"), before) - 1)


def densify(bars: DataFrame, dates: DataFrame | None = None) -> Panel:
    """A panel of all assets of ``bars`` and all ``dates`` (its own if not given); absent rows are missing values."""
    index, n = calendar(bars.sparkSession, dates if dates is not None else bars)
    grid = bars.select("code").distinct().crossJoin(F.broadcast(index))
    return Panel(derive(grid.join(bars, ["code", "date"], "left")), n)


def build_panel(bars: DataFrame, *, max_assets: int | None = 300, min_days: int = 500, min_dates: int = 60) -> Panel:
    """The panel of the longest-lived assets on the dates that all of them share; an error if these are fewer than ``min_dates``."""
    assets = universe(bars, max_assets, min_days)
    index, n = calendar(bars.sparkSession, common_dates(bars, assets))
    if n < min_dates:
        raise ValueError(f"Only {n} common dates, need >= {min_dates}")
    kept = bars.select("code", "date", *BARS).join(assets.select("code"), "code", "left_semi").join(F.broadcast(index), "date")
    suffix_free = F.substring_index("code", ".", 1)
    return Panel(derive(kept).withColumn("code", suffix_free).select("code", "date", "t", *FEATURES), n)


def forward_returns(panel: DataFrame, horizon: int = 1) -> Column:
    """close[t + horizon] / close[t] - 1, missing at the end, as a window column."""
    return F.try_divide(F.lead("close", horizon).over(Window.partitionBy("code").orderBy("date")), F.col("close")) - 1


def with_forward(panel: Panel, horizon: int = 1) -> Panel:
    return Panel(panel.df.withColumn("fwd", forward_returns(panel.df, horizon)), panel.n_dates)
