"""Panels derived from the star-schema tables, as DataFrames and as SQL, for tests, benchmarks and the driver's comparison.

f1: supplier x month of line items.  f2: user x day of events, with gaps.  f3: nation x week of orders, a long calendar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.sources.panel import Panel, densify, with_forward


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as the SQL twins have it: by zero it is infinite, or NaN for 0 / 0, and no error."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def to_digits(x: Column, digits: int) -> Column:
    """``round(x, digits)`` of the SQL twins: the double times a power of ten goes to the next whole number, halves away from zero, and what overflows stays.

    ``F.round`` goes by the decimal digits instead, so that halves which are not halves as doubles end elsewhere.
    """
    power = F.lit(10.0**digits)
    scaled = x * power
    whole = F.round(scaled)
    return F.when(whole == 0, scaled * F.lit(0.0)).when(F.abs(scaled) < float("inf"), whole / power).otherwise(x)


def sum_in_order(c: str, order: list[str]) -> Column:
    """The sum of a group's values added one by one in the order of columns: its last digit is the same wherever the rows lie.

    A group is held as an array, so this is for groups that don't grow with the tables.
    """
    rows = F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(*order, c))))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda total, r: total + r[c]))


def _bars(rows: DataFrame, order: list[str], volume, amount) -> DataFrame:
    at = F.struct(*order, "price")
    return rows.groupBy("code", "date").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        volume.cast("double").alias("volume"), amount.cast("double").alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str, which: str = "f3") -> DataFrame:
    """(code, date, open, high, low, close, volume, amount) of a fixture."""
    if which == "f1":
        rows = table(spark, sf_dir, "lineitem").select(
            F.col("l_suppkey").cast("string").alias("code"), F.trunc("l_shipdate", "month").alias("date"), ratio(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")).alias("price"),
            "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("a"),
        )
        return _bars(rows, ["l_shipdate", "l_orderkey", "l_linenumber"], F.sum("q"), F.sum("a"))
    if which == "f2":
        rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("code"), F.to_date("ts").alias("date"), F.col("value").cast("double").alias("price"), "ts", "event_id")
        return _bars(rows, ["ts", "event_id"], F.count("*"), sum_in_order("price", ["ts", "event_id"]))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.trunc("o_orderdate", "week").alias("date"), F.col("o_totalprice").cast("double").alias("price"))
    return _bars(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), ["o_orderdate", "o_orderkey"], F.count("*"), F.sum("price"))


def panel(spark: SparkSession, sf_dir: str, which: str = "f3", cut: Callable[[DataFrame], DataFrame] = lambda b: b) -> Panel:
    """The dense panel of a fixture, with fwd; ``cut``: what is done with its bars, which are read three times."""
    return with_forward(densify(cut(bars(spark, sf_dir, which))))


_ROWS = {
    "f1": ("SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS price, "
           "l_shipdate AS k1, l_orderkey AS k2, l_linenumber AS k3, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS a FROM lineitem"),
    "f2": "SELECT CAST(user_id AS VARCHAR) AS code, CAST(ts AS DATE) AS date, CAST(value AS DOUBLE) AS price, ts AS k1, event_id AS k2, 0 AS k3, 1.0::DOUBLE AS q, CAST(value AS DOUBLE) AS a FROM events",
    "f3": ("SELECT CAST(c_nationkey AS VARCHAR) AS code, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(o_totalprice AS DOUBLE) AS price, o_orderdate AS k1, o_orderkey AS k2, 0 AS k3, "
           "1.0::DOUBLE AS q, CAST(o_totalprice AS DOUBLE) AS a FROM orders JOIN customer ON o_custkey = c_custkey"),
}


def bars_ctes(which: str = "f3") -> str:
    """The CTEs ``rows_`` and ``bars`` of a fixture, without WITH."""
    return f"""rows_ AS ({_ROWS[which]}),
bars AS (SELECT code, date, first(price ORDER BY k1, k2, k3, price) AS open, max(price) AS high, min(price) AS low, first(price ORDER BY k1 DESC, k2 DESC, k3 DESC, price DESC) AS close,
  sum(q) AS volume, sum(a) AS amount FROM rows_ GROUP BY code, date)"""


def panel_ctes(which: str = "f3") -> str:
    """The CTEs up to ``p``, the dense panel with code, date, t, the features and fwd."""
    return f"""{bars_ctes(which)},
days AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars)),
grid AS (SELECT code, date, t FROM (SELECT DISTINCT code FROM bars) CROSS JOIN days),
p AS (SELECT g.code, g.date, g.t, b.open, b.high, b.low, b.close, b.volume, b.amount, CASE WHEN b.volume > 0 THEN b.amount / b.volume ELSE b.close END AS vwap,
  b.close / nullif(lag(b.close) OVER o, 0) - 1 AS returns, lead(b.close) OVER o / nullif(b.close, 0) - 1 AS fwd
  FROM grid g LEFT JOIN bars b ON b.code = g.code AND b.date = g.date WINDOW o AS (PARTITION BY g.code ORDER BY g.date))"""
