"""Fundamentals: exact joins of daily tables, as-of joins of quarterly reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .panel import Panel, missing, parse_date

REPORT_LAG_DAYS = 45
#: Columns of the daily table and of quarterly balance sheets and income statements, and the files that hold them.
DAILY = ("total_mv", "pe", "pb", "dv_ttm")
QUARTERLY = {"balance": ("bvps", "roe_pct"), "income": ("basic_eps", "n_income", "revenue")}
FILES = {"daily": "daily_basic*.parquet", "balance": "*balance*.parquet", "income": "*income*.parquet"}


def join_daily(panel: DataFrame, daily: DataFrame, columns: list[str]) -> DataFrame:
    """``panel`` with ``columns`` of ``daily`` (code, date, ...) where it has them.

    A column for which ``daily`` lacks an asset or a date of the panel altogether is left out of the result: a partly
    covered grid is no panel.
    """
    have = [c for c in columns if c in daily.columns and c not in panel.columns]
    if not have:
        return panel
    here = daily.select("code", "date", *have).join(panel.select("code", "date").distinct(), ["code", "date"], "left_semi")
    grid = panel.agg(F.count_distinct("code").alias("codes"), F.count_distinct("date").alias("dates")).first()
    covered = here.agg(F.count_distinct("code").alias("codes"), F.count_distinct("date").alias("dates")).first()
    if (grid["codes"], grid["dates"]) != (covered["codes"], covered["dates"]):
        return panel
    return panel.join(here.dropDuplicates(["code", "date"]), ["code", "date"], "left")


def asof_join(left: DataFrame, right: DataFrame, columns: list[str], *, key: str = "code", on: str = "date", report: str = "report_date", lag_days: int = REPORT_LAG_DAYS) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` whose report date is at least ``lag_days`` days back, per key.

    The whole last row counts, its nulls included; rows of ``right`` without a report date are dropped; of several rows with one
    report date the last by their values counts.  One shuffle by key and one pass in date order, no range join.
    """
    have = [c for c in columns if c in right.columns]
    order = [c for c in left.columns if c not in (key, on)]
    facts = right.where(F.col(report).isNotNull()).select(F.col(key), F.col(report).cast("date").alias("__at"), F.lit(0).alias("__side"), F.struct(*have).alias("__fact"))
    asks = left.select("*", F.date_sub(F.col(on).cast("date"), lag_days).alias("__at"), F.lit(1).alias("__side"))
    both = asks.unionByName(facts, allowMissingColumns=True)
    seen = Window.partitionBy(key).orderBy("__at", "__side", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__last", F.last("__fact", ignorenulls=True).over(seen)).where("__side = 1")
    return filled.select(key, on, *order, *[F.col("__last")[c].alias(c) for c in have])


def _keyed(table: DataFrame, columns: Sequence[str], date: str, into: str) -> DataFrame:
    """(code, ``into``, the columns that are there) of a vendor's table: codes without suffix, dates of any form, numbers coerced."""
    code = "ts_code" if "ts_code" in table.columns else "code"
    have = [c for c in columns if c in table.columns]
    return table.select(F.substring_index(F.col(code).cast("string"), ".", 1).alias("code"), parse_date(F.col(date)).alias(into), *[missing(F.col(c).try_cast("double")).alias(c) for c in have])


def with_fundamentals(panel: Panel, daily: DataFrame | None = None, reports: Sequence[DataFrame] = ()) -> Panel:
    """A panel with the fundamentals that the tables have: of the day, and of the last report that was out for ``REPORT_LAG_DAYS`` days.

    ``daily``: code or ts_code, date or trade_date and columns of DAILY.  ``reports``: code or ts_code, report_date or end_date and columns of QUARTERLY.
    """
    df = panel.df
    if daily is not None:
        df = join_daily(df, _keyed(daily, DAILY, "trade_date" if "trade_date" in daily.columns else "date", "date"), list(DAILY))
    for table in reports:
        wanted = [c for own in QUARTERLY.values() for c in own if c in table.columns and c not in df.columns]
        if wanted:
            df = asof_join(df, _keyed(table, wanted, "end_date" if "end_date" in table.columns else "report_date", "report_date"), wanted)
    return Panel(df, panel.n_dates)


def load(spark: SparkSession, panel: Panel, folder: str) -> Panel:
    """A panel with the fundamentals of a folder of parquet files; what is absent is left out."""
    from pyspark.errors import AnalysisException

    found = {}
    for kind, pattern in FILES.items():
        try:
            found[kind] = spark.read.parquet(f"{folder.rstrip('/')}/{pattern}")
        except AnalysisException:
            continue
    return with_fundamentals(panel, found.get("daily"), [found[k] for k in QUARTERLY if k in found])


def held(panel: Panel) -> tuple[str, ...]:
    """The fundamentals that a panel has and features are made of."""
    return tuple(c for c in ("bvps", "roe_pct", "basic_eps", *DAILY) if c in panel.df.columns)
