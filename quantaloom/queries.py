"""Named queries over the fixtures, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom import backtest as bt
from quantaloom import combine as cb
from quantaloom import fixtures, formula_sql
from quantaloom import library as lib
from quantaloom.functions import analytics, ic, performance
from quantaloom.generate import candidates, combiner_features, engineered
from quantaloom.plans import blocks
from quantaloom.plans.compiler import evaluate
from quantaloom.scratch import free, materialize
from quantaloom.sources import fundamentals, stores
from quantaloom.sources.panel import Panel, build_panel, common_dates, panel_of_frames, read_bars, universe, with_forward

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


QUERIES: dict[str, Query] = {}
SIGNAL = "cs_rank(ts_mean(returns, 5))"
OTHER = "neg(cs_rank(ts_std(returns, 10)))"
Y = "div(sub(vwap, close), close)"


def add(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = Query(run, sql)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; -0.0 is 0.0."""
    return df.select(*[(fixtures.to_digits(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _q(columns: str, body: str, ctes: str, digits: int = 6, doubles: tuple[str, ...] = ()) -> str:
    shown = ", ".join([*[c.strip() for c in columns.split(",") if c.strip()], *[f"round({d}, {digits}) + 0.0 AS {d}" for d in doubles]])
    return f"WITH {ctes} SELECT {shown} FROM ({body})"


# ---- panels -------------------------------------------------------------------------------------------------

def _panel_query(which: str) -> None:
    """A panel: prices as they are; sums rounded to cents; vwap as a ratio to the close, which has no halves to round."""
    add(
        f"panel_{which}",
        lambda spark, d: fixtures.panel(spark, d, which).df.select(
            "code", "date", "t", "open", "high", "low", "close", "volume", fixtures.to_digits(F.col("amount"), 2).alias("amount"), *[fixtures.to_digits(c, 6).alias(n) for c, n in ((fixtures.ratio(F.col("vwap"), F.col("close")), "vwap"), (F.col("returns"), "returns"), (F.col("fwd"), "fwd"))],
        ),
        f"WITH {fixtures.panel_ctes(which)} SELECT code, date, t, open, high, low, close, volume, round(amount, 2) AS amount, round(vwap / close, 6) AS vwap, round(returns, 6) AS returns, round(fwd, 6) AS fwd FROM p",
    )


for _w in ("f1", "f2", "f3"):
    _panel_query(_w)

add(
    "universe_top_assets",
    lambda spark, d: universe(fixtures.bars(spark, d, "f1"), max_assets=50, min_days=60),
    f"WITH {fixtures.bars_ctes('f1')} SELECT code, count(date) AS n_days FROM bars GROUP BY code HAVING count(date) >= 60 ORDER BY n_days DESC, code LIMIT 50",
)
add(
    "common_dates",
    lambda spark, d: (lambda b: common_dates(b, universe(b, None, 60)))(fixtures.bars(spark, d, "f1")),
    f"""WITH {fixtures.bars_ctes('f1')}, u AS (SELECT code, count(date) AS n FROM bars GROUP BY code HAVING count(date) >= 60)
SELECT date FROM bars WHERE code IN (SELECT code FROM u) GROUP BY date HAVING count(DISTINCT code) = (SELECT count(*) FROM u)""",
)
add(
    "panel_of_common_dates",
    lambda spark, d: rounded(with_forward(build_panel(fixtures.bars(spark, d, "f1"), min_days=60, min_dates=20)).df.select("code", "date", "t", (F.col("close") / 7).alias("close"), "returns", "fwd")),
    _q("code, date, t", "SELECT * FROM pp", f"""{fixtures.bars_ctes('f1')}, u AS (SELECT code, count(date) AS n FROM bars GROUP BY code HAVING count(date) >= 60 ORDER BY n DESC, code LIMIT 300),
cd AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT date FROM bars WHERE code IN (SELECT code FROM u) GROUP BY date HAVING count(DISTINCT code) = (SELECT count(*) FROM u))),
pp AS (SELECT b.code, b.date, cd.t, b.close / 7 AS close, b.close / nullif(lag(b.close) OVER o, 0) - 1 AS returns, lead(b.close) OVER o / nullif(b.close, 0) - 1 AS fwd
  FROM bars b JOIN cd ON b.date = cd.date WHERE b.code IN (SELECT code FROM u) WINDOW o AS (PARTITION BY b.code ORDER BY b.date))""", 6, ("close", "returns", "fwd")),
)


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly totals of orders per nation, stated at the quarter's end; a third of the values missing."""
    b = fixtures.bars(spark, d, "f3").withColumn("report_date", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)))
    q = b.groupBy("code", "report_date").agg(F.sum("volume").alias("revenue"), F.max("high").alias("top"))
    return q.withColumn("revenue", F.when(F.month("report_date") != 6, F.col("revenue")))


add(
    "asof_fundamentals",
    lambda spark, d: rounded(fundamentals.asof_join(fixtures.panel(spark, d, "f3").df.select("code", "date", "t"), _reports(spark, d), ["revenue", "top"]), 4),
    _q("code, date, t", "SELECT p.code, p.date, p.t, q.revenue, q.top FROM p ASOF LEFT JOIN q ON p.code = q.code AND p.date - INTERVAL 45 DAY >= q.report_date", f"""{fixtures.panel_ctes('f3')},
q0 AS (SELECT code, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS report_date, sum(volume) AS revenue, max(high) AS top FROM bars GROUP BY ALL),
q AS (SELECT code, report_date, CASE WHEN month(report_date) <> 6 THEN revenue END AS revenue, top FROM q0)""", 4, ("revenue", "top")),
)
add(
    "join_daily_fundamentals",
    lambda spark, d: rounded(fundamentals.join_daily(fixtures.panel(spark, d, "f3").df.select("code", "date", "close"), fixtures.bars(spark, d, "f3").select("code", "date", fixtures.ratio(F.col("close"), F.col("open")).alias("pe")), ["pe", "pb"])),
    _q("code, date", "SELECT p.code, p.date, p.close, b.close / b.open AS pe FROM p LEFT JOIN bars b ON p.code = b.code AND p.date = b.date", fixtures.panel_ctes("f3"), 6, ("close", "pe")),
)

add(
    "panel_of_frames",
    lambda spark, d: rounded(panel_of_frames({f"{i}": fixtures.bars(spark, d, "f1").where(F.col("code") == f"{i}") for i in range(1, 11)}, min_days=60, min_dates=20).df.select("code", "date", "t", (F.col("close") / 7).alias("close"), "returns")),
    _q("code, date, t", "SELECT * FROM pp", f"""{fixtures.bars_ctes('f1')}, b10 AS (SELECT * FROM bars WHERE CAST(code AS INTEGER) BETWEEN 1 AND 10), u AS (SELECT code FROM b10 GROUP BY code HAVING count(date) >= 60),
cd AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT date FROM b10 WHERE code IN (SELECT code FROM u) GROUP BY date HAVING count(DISTINCT code) = (SELECT count(*) FROM u))),
pp AS (SELECT b.code, b.date, cd.t, b.close / 7 AS close, b.close / nullif(lag(b.close) OVER o, 0) - 1 AS returns FROM b10 b JOIN cd ON b.date = cd.date WHERE b.code IN (SELECT code FROM u) WINDOW o AS (PARTITION BY b.code ORDER BY b.date))""", 6, ("close", "returns")),
)


def _valued(spark: SparkSession, d: str) -> Panel:
    """Fixture f3 with fundamentals made of its own bars: daily ratios and quarterly reports, under a vendor's names."""
    b = fixtures.bars(spark, d, "f3")
    daily = b.select(F.concat("code", F.lit(".XX")).alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("trade_date"), (F.col("amount") * 3).alias("total_mv"), fixtures.ratio(F.col("close"), F.col("open")).alias("pe"), fixtures.ratio(F.col("high"), F.col("low")).alias("pb"), fixtures.ratio(F.col("low"), F.col("close")).alias("dv_ttm"))
    quarters = _reports(spark, d).select(F.col("code").alias("ts_code"), F.date_format("report_date", "yyyyMMdd").alias("end_date"), F.col("revenue").alias("bvps"), F.col("top").alias("roe_pct"), (F.col("top") / 3).alias("basic_eps"))
    return fundamentals.with_fundamentals(fixtures.panel(spark, d, "f3"), daily, [quarters.drop("basic_eps"), quarters.select("ts_code", "end_date", "basic_eps")])


_VALUED = f"""{fixtures.panel_ctes('f3')}, q0 AS (SELECT code, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS report_date, sum(volume) AS revenue, max(high) AS top FROM bars GROUP BY ALL),
q AS (SELECT code, report_date, CASE WHEN month(report_date) <> 6 THEN revenue END AS bvps, top AS roe_pct, top / 3 AS basic_eps FROM q0),
pv AS (SELECT p.*, b.amount * 3 AS total_mv, b.close / b.open AS pe, b.high / b.low AS pb, b.low / b.close AS dv_ttm, q.bvps, q.roe_pct, q.basic_eps FROM p LEFT JOIN bars b ON b.code = p.code AND b.date = p.date ASOF LEFT JOIN q ON p.code = q.code AND p.date - INTERVAL 45 DAY >= q.report_date)"""
_VALUE_NAMES = {k: v for k, v in engineered(345, ("bvps", "roe_pct", "basic_eps", *fundamentals.DAILY)).items() if k not in engineered(345)}


def valued_features(spark: SparkSession, d: str) -> DataFrame:
    """Count and mean of the sixteen features of fundamentals."""
    p = _valued(spark, d)
    names = {k: v for k, v in engineered(p.n_dates, fundamentals.held(p)).items() if k in _VALUE_NAMES}
    return rounded(ic.to_long(evaluate(p.df, names, p.n_dates), list(names)).groupBy("name").agg(F.count("value").alias("n"), F.avg(F.col("value") * F.pmod("t", F.lit(7))).alias("mean")))


add("panel_with_fundamentals", lambda spark, d: rounded(_valued(spark, d).df.select("code", "date", "t", "total_mv", "pe", "pb", "dv_ttm", "bvps", "roe_pct", "basic_eps"), 4), _q("code, date, t", "SELECT * FROM pv", _VALUED, 4, ("total_mv", "pe", "pb", "dv_ttm", "bvps", "roe_pct", "basic_eps")))
add("fundamental_features", valued_features, _q("name, n", "SELECT name, count(value) AS n, avg(value * (t % 7)) AS mean FROM s GROUP BY name", f"{_VALUED}, {formula_sql.ctes(_VALUE_NAMES, 345, source='pv')}, {formula_sql.long(list(_VALUE_NAMES))}", 6, ("mean",)))

# ---- operators ----------------------------------------------------------------------------------------------

_W5 = "(PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_O = "(PARTITION BY code ORDER BY date)"
_XY = "xy AS (SELECT code, date, t, open, high, low, close, volume, returns AS x, (vwap - close) / (close + 1e-10 * sign(close + 1e-10)) AS y FROM p)"


def _formula(name: str, formula: str, value: str, extra: str = "", source: str = "xy", which: str = "f3", digits: int = 6) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = fixtures.panel(spark, d, which)
        return rounded(evaluate(p.df, {"value": formula}, p.n_dates), digits)

    body = f"SELECT code, date, t, {value} AS value FROM {source}"
    add(name, run, _q("code, date, t", body, f"{fixtures.panel_ctes(which)}, {_XY}{extra}", digits, ("value",)))


for _name, _sql in {
    "ts_mean": f"avg(x) OVER {_W5}", "ts_sum": f"sum(x) OVER {_W5}", "ts_min": f"min(x) OVER {_W5}", "ts_max": f"max(x) OVER {_W5}", "ts_std": f"stddev_samp(x) OVER {_W5}",
    "ts_lag": f"lag(x, 5) OVER {_O}", "ts_delta": f"x - lag(x, 5) OVER {_O}",
    "ts_argmin": f"CAST(t - arg_min(t, x) OVER {_W5} AS DOUBLE)", "ts_argmax": f"CAST(t - arg_max(t, x) OVER {_W5} AS DOUBLE)",
    "ts_product": f"CASE WHEN t >= 4 THEN product(coalesce(x, 1.0)) OVER {_W5} END",
    "ts_decay_linear": "CASE WHEN t >= 4 THEN (" + " + ".join(f"{5 - k} * coalesce(lag(x, {k}) OVER {_O}, 0)" for k in range(5)) + ") / 15 END",
}.items():
    _formula(_name, f"{_name}(returns, 5)", _sql)

_formula(
    "ts_rank", "ts_rank(returns, 5)", "CASE WHEN x IS NULL THEN NULL WHEN n = 1 THEN 0.0 ELSE 2 * ((l + (e - 1) / 2.0) / (n - 1) - 0.5) END",
    f", w AS (SELECT *, list(x) OVER {_W5} AS s FROM xy), r AS (SELECT *, len(list_filter(s, lambda v: v < x)) AS l, len(list_filter(s, lambda v: v = x)) AS e, len(list_filter(s, lambda v: v IS NOT NULL)) AS n FROM w)", "r",
)
_E = f", e1 AS (SELECT *, x - avg(x) OVER {_W5} AS e FROM xy), e2 AS (SELECT *, avg(e * e) OVER {_W5} AS m2, avg(e * e * e) OVER {_W5} AS m3, avg(e * e * e * e) OVER {_W5} AS m4 FROM e1)"
_formula("ts_skew", "ts_skew(returns, 5)", "m3 / power(m2 + 1e-10, 1.5)", _E, "e2")
_formula("ts_kurt", "ts_kurt(returns, 5)", "m4 / (m2 * m2 + 1e-10) - 3", _E, "e2")
_M = f", m AS (SELECT *, avg(x) OVER {_W5} AS mx, avg(y) OVER {_W5} AS my, avg(x * y) OVER {_W5} AS mxy, avg(x * x) OVER {_W5} AS mxx, avg(y * y) OVER {_W5} AS myy FROM xy)"
_M += ", c AS (SELECT *, (mxy - mx * my) / (sqrt(greatest(mxx - mx * mx, 1e-10)) * sqrt(greatest(myy - my * my, 1e-10))) AS raw FROM m), cc AS (SELECT *, CASE WHEN raw IS NOT NULL AND mxx IS NOT NULL AND myy IS NOT NULL THEN greatest(-1.0, least(1.0, raw)) END AS r FROM c)"
_formula("ts_cov", f"ts_cov(returns, {Y}, 5)", "mxy - mx * my", _M, "m")
_formula("ts_corr", f"ts_corr(returns, {Y}, 5)", "r", _M, "cc")
_formula("ts_rsquare", f"ts_rsquare(returns, {Y}, 5)", "r * r", _M, "cc")
_formula(
    "ts_regression_residual", f"ts_regression_residual(returns, {Y}, 5)", "CASE WHEN t >= 4 THEN y - b * x - (my - b * mx) END",
    f""", s AS (SELECT *, avg(x) OVER {_W5} AS mx, avg(y) OVER {_W5} AS my, list({{'x': x, 'y': y}}) OVER {_W5} AS l FROM xy),
s2 AS (SELECT *, coalesce(list_sum(list_transform(l, lambda v: (v.x - mx) * (v.y - my))), 0) / (coalesce(list_sum(list_transform(l, lambda v: (v.x - mx) * (v.x - mx))), 0) + 1e-10) AS b FROM s)""", "s2",
)
_D = "(PARTITION BY date)"
_formula("cs_rank", "cs_rank(returns)", f"CASE WHEN x IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY date ORDER BY x ASC NULLS LAST, code) AS DOUBLE) / count(x) OVER {_D} END")
_formula("cs_zscore", "cs_zscore(returns)", f"(x - avg(x) OVER {_D}) / (stddev_pop(x) OVER {_D} + 1e-10)")
_formula("cs_scale", "cs_scale(returns)", f"x / (sum(abs(x)) OVER {_D} + 1e-10)")
_formula("cs_demean", "cs_demean(returns)", f"x - avg(x) OVER {_D}")


def _away(c: str) -> str:
    return f"({c} + 1e-10 * sign({c} + 1e-10))"


for _name, _args, _sql in (
    ("abs", "returns", "abs(x)"), ("log", "returns", "ln(abs(x) + 1e-10)"), ("sign", "returns", "CAST(sign(x) AS DOUBLE)"), ("sqrt", "returns", "sqrt(abs(x))"), ("neg", "returns", "-x"),
    ("inv", "close", f"1.0 / {_away('close')}"), ("add", "returns, returns", "x + x"), ("sub", f"returns, {Y}", "x - y"), ("mul", f"returns, {Y}", "x * y"), ("div", "high, close", f"high / {_away('close')}"),
    ("power", "returns, 3", "power(abs(x) + 1e-10, 3) * sign(x)"), ("max", f"returns, {Y}", "greatest(x, y)"), ("min", f"returns, {Y}", "least(x, y)"),
):
    _formula(f"map_{_name}", f"{_name}({_args})", _sql)
_formula("infix", f"-returns * 2 + {Y} / (close - 1)", f"-x * 2 + y / {_away('(close - 1)')}")
_formula("window_clamp", "ts_mean(returns, 120)", "avg(x) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", which="f2", digits=5)
_formula(
    "formula_levels", "cs_rank(ts_mean(cs_zscore(returns), 5))", "CASE WHEN m IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY date ORDER BY m ASC NULLS LAST, code) AS DOUBLE) / count(m) OVER (PARTITION BY date) END",
    f", z AS (SELECT *, (x - avg(x) OVER {_D}) / (stddev_pop(x) OVER {_D} + 1e-10) AS z FROM xy), zm AS (SELECT *, avg(z) OVER {_W5} AS m FROM z)", "zm",
)

#: The formulas of the end-to-end corpus.
CORPUS = (
    "cs_rank(ts_delta(close, 20))",
    "neg(cs_rank(div(ts_delta(close, 5), ts_lag(close, 5))))",
    "cs_rank(ts_decay_linear(returns, 10))",
    "cs_rank(ts_corr(close, volume, 10))",
    "neg(cs_rank(ts_corr(returns, volume, 20)))",
    "cs_rank(div(volume, ts_mean(volume, 20)))",
    "neg(cs_rank(ts_std(returns, 20)))",
    "cs_rank(ts_skew(returns, 20))",
    "neg(cs_rank(ts_kurt(returns, 20)))",
    "cs_rank(div(sub(close, ts_min(low, 20)), sub(ts_max(high, 20), ts_min(low, 20))))",
    "cs_rank(sub(close, ts_mean(close, 20)))",
    "neg(cs_rank(div(sub(high, close), sub(high, low))))",
    "neg(cs_rank(div(sub(close, vwap), vwap)))",
    "cs_rank(ts_rank(div(close, vwap), 10))",
    "cs_rank(ts_regression_residual(volume, close, 20))",
    "cs_rank(mul(ts_corr(close, volume, 10), ts_std(returns, 10)))",
)


#: Months of fixture f1, an upper bound of windows.
_MONTHS = 83


def corpus(spark: SparkSession, d: str, which: str = "f1") -> DataFrame:
    """IC summary of the corpus, one plan."""
    p = fixtures.panel(spark, d, which)
    trees = blocks.trees_of({f"a{i + 1:02d}": f for i, f in enumerate(CORPUS)}, None, p.n_dates)
    found = blocks.ics(blocks.pack(p.df, {*blocks.needed(trees), "fwd"}), trees, ic.MIN_ASSETS, ic.FLAT)
    return rounded(ic.ic_summary(found.where("n > 0")))


def features(spark: SparkSession, d: str, names: Callable[[int], dict[str, str]] = engineered) -> DataFrame:
    """Count and mean of every feature; the mean in a billionth of the largest size, as volumes and returns are far apart."""
    p = fixtures.panel(spark, d, "f1")
    trees = blocks.trees_of(names(p.n_dates), None, p.n_dates)
    parts = blocks.totals(blocks.pack(p.df, blocks.needed(trees)), trees)
    share = F.try_divide(F.try_divide(F.sum("total"), F.sum("n")), F.max("most"))
    return rounded(parts.groupBy("name").agg(F.sum("n").alias("n"), share.alias("mean_share")))


# ---- signals and their metrics --------------------------------------------------------------------------------


def signals(spark: SparkSession, d: str, which: str = "f3", **formulas: str) -> DataFrame:
    """Signals of a fixture, long."""
    p = fixtures.panel(spark, d, which)
    named = formulas or {"momentum": SIGNAL, "calm": OTHER}
    return ic.to_long(evaluate(p.df, named, p.n_dates, keep=["fwd"]), list(named))


_S = f"""{fixtures.panel_ctes('f3')},
s0 AS (SELECT code, date, t, fwd, avg(returns) OVER {_W5} AS m, stddev_samp(returns) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v FROM p),
s1 AS (SELECT code, date, t, fwd, CASE WHEN m IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY date ORDER BY m ASC NULLS LAST, code) AS DOUBLE) / count(m) OVER (PARTITION BY date) END AS momentum,
  -CASE WHEN v IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY date ORDER BY v ASC NULLS LAST, code) AS DOUBLE) / count(v) OVER (PARTITION BY date) END AS calm FROM s0),
s AS (SELECT 'momentum' AS name, code, date, t, momentum AS value, fwd FROM s1 UNION ALL SELECT 'calm', code, date, t, calm, fwd FROM s1)"""
_PEARSON = "CASE WHEN count(*) >= {least} THEN (sum(a * b) - sum(a) * sum(b) / count(*)) / sqrt((sum(a * a) - sum(a) * sum(a) / count(*)) * (sum(b * b) - sum(b) * sum(b) / count(*))) END"


def _ic_ctes(signals_cte: str) -> str:
    """Up to ``ic``, of CTEs that end with signals ``s``."""
    return f"""{signals_cte}, ranks AS (SELECT name, date, t, CAST(row_number() OVER (PARTITION BY name, date ORDER BY value, code) AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY name, date ORDER BY fwd, code) AS DOUBLE) AS b
  FROM s WHERE value IS NOT NULL AND fwd IS NOT NULL), ic AS (SELECT name, date, t, count(*) AS n, {_PEARSON.format(least=10)} AS ic FROM ranks GROUP BY name, date, t)"""


def _summary_ctes(signals_cte: str) -> str:
    """Up to ``f``, the summary of ``ic`` by name."""
    return f"""{_ic_ctes(signals_cte)}, f AS (SELECT name, coalesce(avg(ic), 0) AS ic_mean, coalesce(stddev_pop(ic), 0) AS ic_std, CASE WHEN count(ic) >= 10 AND stddev_pop(ic) >= 1e-10 THEN avg(ic) / stddev_pop(ic) ELSE 0 END AS icir,
  CASE WHEN count(ic) >= 10 AND stddev_samp(ic) >= 1e-10 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) ELSE 0 END AS ic_t, coalesce(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END), 0) AS ic_positive, count(ic) AS n_days FROM ic GROUP BY name)"""


def _formula_signals(formulas: dict[str, str]) -> str:
    """CTEs up to the signals ``s`` of formulas over fixture f1."""
    return f"{fixtures.panel_ctes('f1')}, {formula_sql.ctes(formulas, _MONTHS)}, {formula_sql.long(list(formulas))}"


_IC, _SUM = _ic_ctes(_S), _summary_ctes(_S)
_FIGURES = ("ic_mean", "ic_std", "icir", "ic_t", "ic_positive")
add("alpha_corpus", corpus, _q("name, n_days", "SELECT * FROM f", _summary_ctes(_formula_signals({f"a{i + 1:02d}": f for i, f in enumerate(CORPUS)})), 6, _FIGURES))
for _name, _names in (("engineered_features", engineered), ("combiner_features", combiner_features)):
    add(
        _name,
        lambda spark, d, names=_names: features(spark, d, names),
        _q("name, n", "SELECT name, count(value) AS n, avg(value) / nullif(max(abs(value)), 0) AS mean_share FROM s GROUP BY name", _formula_signals(_names(_MONTHS)), 6, ("mean_share",)),
    )
add("ic_series", lambda spark, d: rounded(ic.ic_series(signals(spark, d))), _q("name, date, t, n", "SELECT * FROM ic", _IC, 6, ("ic",)))
add("ic_summary", lambda spark, d: rounded(ic.ic_summary(ic.ic_series(signals(spark, d)))), _q("name, n_days", "SELECT * FROM f", _SUM, 6, ("ic_mean", "ic_std", "icir", "ic_t", "ic_positive")))


def _dates(spark: SparkSession, d: str) -> int:
    return fixtures.panel(spark, d, "f3").n_dates


add(
    "out_of_sample",
    lambda spark, d: rounded(ic.out_of_sample(ic.ic_series(signals(spark, d)), _dates(spark, d))),
    _q("name, oos_days, valid", """SELECT name, is_ic, oos_ic, oos_days, oos_days >= 20 AS valid, CASE WHEN abs(is_ic) > 1e-10 THEN 1 - abs(oos_ic) / abs(is_ic) ELSE 1.0 END AS degradation FROM
(SELECT name, coalesce(avg(ic) FILTER (t < k), 0) AS is_ic, coalesce(avg(ic) FILTER (t >= k + 5), 0) AS oos_ic, count(ic) FILTER (t >= k + 5) AS oos_days FROM ic, (SELECT CAST(floor(count(*) * 0.6) AS INTEGER) AS k FROM days) GROUP BY name)""", _IC, 6, ("is_ic", "oos_ic", "degradation")),
)
_AVG_RANK = "rank() OVER (PARTITION BY name, date ORDER BY {c}) + (count(*) OVER (PARTITION BY name, date, {c}) - 1) / 2.0"


def _pair(spark: SparkSession, d: str) -> DataFrame:
    both = signals(spark, d).select("name", "code", "date", "t", "value")
    return rounded(ic.signal_correlation(both.where("name = 'momentum'"), both.where("name = 'calm'")))


add(
    "signal_correlation",
    _pair,
    _q("n_dates", f"SELECT coalesce(avg(c), 0) AS correlation, count(c) AS n_dates FROM (SELECT date, {_PEARSON.format(least=10)} AS c FROM (SELECT 'x' AS name, date, {_AVG_RANK.format(c='momentum')} AS a, {_AVG_RANK.format(c='calm')} AS b FROM (SELECT 'x' AS name, date, momentum, calm FROM s1 WHERE momentum IS NOT NULL AND calm IS NOT NULL)) GROUP BY date)", _S, 6, ("correlation",)),
)
add(
    "ic_smoothed",
    lambda spark, d: rounded(ic.smoothed(ic.ic_series(signals(spark, d))).select("name", "date", "smooth")),
    _q("name, date", "SELECT name, date, sum(coalesce(ic, 0)) OVER (PARTITION BY name ORDER BY date ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20 AS smooth FROM ic", _IC, 6, ("smooth",)),
)
add(
    "ic_histogram",
    lambda spark, d: rounded(ic.histogram(ic.ic_series(signals(spark, d)))),
    _q("name, bin", """SELECT name, CAST(bin AS INTEGER) AS bin, any_value(least) + bin * any_value(w) AS lo, count(*) / (any_value(n) * any_value(w)) AS density
FROM (SELECT *, least(49, floor((ic - least) / w)) AS bin FROM (SELECT name, ic, min(ic) OVER o AS least, (max(ic) OVER o - min(ic) OVER o) / 50 AS w, count(*) OVER o AS n FROM ic WHERE ic IS NOT NULL WINDOW o AS (PARTITION BY name))) GROUP BY name, bin""", _IC, 6, ("lo", "density")),
)
add(
    "ic_extremes",
    lambda spark, d: rounded(ic.extremes(ic.ic_series(signals(spark, d)))),
    _q("name", "SELECT name, median(ic) AS ic_median, min(ic) AS ic_min, max(ic) AS ic_max FROM ic GROUP BY name", _IC, 6, ("ic_median", "ic_min", "ic_max")),
)
#: Coefficients of a published rational approximation of the normal quantile's tail (relative error 1e-9).
_TAIL = "((((((-0.007784894002430293 * q - 0.3223964580411365) * q - 2.400758277161838) * q - 2.549732539343734) * q + 4.374664141464968) * q + 2.938163982698783) / ((((0.007784695709041462 * q + 0.3224671290700398) * q + 2.445134137142996) * q + 3.754408661907416) * q + 1))"
add(
    "hlz_thresholds",
    lambda spark, d: rounded(spark.createDataFrame([(n, ic.hlz_threshold(n)) for n in (1, 2, 10, 100, 864, 22110)], "n_tests int, threshold double"), 5),
    f"SELECT n_tests, round(CASE WHEN n_tests <= 1 THEN 1.96 ELSE greatest(3.0, -{_TAIL}) END, 5) AS threshold FROM (SELECT n_tests, sqrt(-2 * ln(0.05 / (2 * n_tests))) AS q FROM (VALUES (1), (2), (10), (100), (864), (22110)) x(n_tests))",
)
add(
    "signal_turnover",
    lambda spark, d: rounded(spark.createDataFrame([(n, lib.signal_turnover(fixtures.panel(spark, d, "f3"), f)) for n, f in (("momentum", SIGNAL), ("calm", OTHER))], "name string, turnover double")),
    _q("name", "SELECT name, avg(c) AS turnover FROM (SELECT name, date, avg(c) AS c FROM (SELECT name, date, abs(value - lag(value) OVER (PARTITION BY name, code ORDER BY date)) AS c FROM s) GROUP BY name, date) GROUP BY name", _S, 6, ("turnover",)),
)


#: All candidates of depth 1 are screened by two queries.  The skew of two values is the square root of two by size, whatever they are, and whole volumes in
#: another order have one deviation: such ranks go by the last digits of a division, which no other engine shares, so that these candidates have no SQL.
_NEAR_TIES = [f for f in candidates(1) if f.startswith(("ts_skew", "ts_std(volume"))]
_PLAIN_ONES = [f for f in candidates(1) if f not in set(_NEAR_TIES)]


def _screen(spark: SparkSession, d: str, formulas: list[str], **how) -> list[lib.Screened]:
    """The screen over fixture f1, whose bars are a table while it lasts, so that the line items' shuffle files go before the panel's come."""
    held: list[DataFrame] = []

    def cut(bars: DataFrame) -> DataFrame:
        held.append(materialize(bars, "bars"))
        return held[0]

    found = lib.screen(fixtures.panel(spark, d, "f1", cut), formulas, **how)
    free(*held)
    return found


def screened(spark: SparkSession, d: str, formulas: list[str] | None = None) -> DataFrame:
    """The screen over candidates, in batches over a panel that is packed once."""
    found = _screen(spark, d, formulas if formulas is not None else _PLAIN_ONES, ic_threshold=0.005, max_keep=10_000)
    rows = [(s.expression, s.ic_mean, s.icir, s.t_stat) for s in found]
    return rounded(spark.createDataFrame(rows, "expression string, ic_mean double, icir double, t_stat double"), 4)


_SCREEN = f"{_summary_ctes(_formula_signals({f: f for f in _PLAIN_ONES}))}, absent AS (SELECT name, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM s GROUP BY name)"
add("screen_near_ties", lambda spark, d: screened(spark, d, _NEAR_TIES))
add(
    "screen_factors",
    screened,
    _q("expression", "SELECT f.name AS expression, ic_mean, icir, ic_t AS t_stat FROM f JOIN absent ON absent.name = f.name WHERE missing <= 0.5 AND n_days >= 50 AND abs(ic_mean) >= 0.005", _SCREEN, 4, ("ic_mean", "icir", "t_stat")),
)


def chosen(spark: SparkSession, d: str) -> DataFrame:
    """The corpus after greedy de-duplication of IC series that correlate above a half."""
    kept = _screen(spark, d, list(CORPUS), ic_threshold=0.0, max_corr=0.5, always_dedup=True)
    return spark.createDataFrame([(s.expression, i) for i, s in enumerate(kept)], "expression string, place int")


_DEDUP = f"""{_summary_ctes(_formula_signals({f: f for f in CORPUS}))},
o AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY ic_mean DESC, name) AS k FROM f), z AS (SELECT o.k, d.t, coalesce(ic.ic, 0) AS v FROM o CROSS JOIN days d LEFT JOIN ic ON ic.name = o.name AND ic.t = d.t),
m AS MATERIALIZED (SELECT k, list(c ORDER BY j) AS c FROM (SELECT a.k, b.k AS j, abs(corr(a.v, b.v)) AS c FROM z a JOIN z b ON a.t = b.t GROUP BY a.k, b.k) GROUP BY k),
g(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT i + 1, CASE WHEN len(list_filter(kept, lambda x: m.c[x] > 0.5)) = 0 THEN list_append(kept, i + 1) ELSE kept END FROM g JOIN m ON m.k = g.i + 1),
h AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))"""
add("dedup_factors", chosen, f"WITH RECURSIVE {_DEDUP} SELECT o.name AS expression, CAST(row_number() OVER (ORDER BY o.k) - 1 AS INTEGER) AS place FROM h JOIN o ON o.k = h.k")
add("candidate_counts", lambda spark, d: spark.createDataFrame([(k, len(candidates(k))) for k in (1, 2, 3)] + [(4, len(candidates(3, True)))], "depth int, n long"), "SELECT * FROM (VALUES (1, 864::BIGINT), (2, 15152), (3, 22093), (4, 22110)) AS x(depth, n)")
_CASES = " ".join(f"WHEN {' OR '.join(tests)} THEN '{name}'" for name, tests in (
    ("Momentum/Reversal", ("expression LIKE 'ret\\_%' ESCAPE '\\'", "lower(expression) LIKE '%momentum%'", "left(expression, 10) LIKE '%ret%'")), ("Volatility", ("contains(expression, 'vol_')", "contains(expression, 'vol(')", "contains(expression, 'std')")),
    ("Price-Volume Correlation", ("contains(expression, 'corr')", "contains(expression, 'cov')")), ("Rank/Relative", ("contains(expression, 'rank') AND (contains(expression, 'close') OR contains(expression, 'volume'))",)),
    ("Higher Moments", ("contains(expression, 'skew')", "contains(expression, 'kurt')")), ("Microstructure", tuple(f"contains(expression, '{w}')" for w in ("hl_", "vwap", "intraday", "body", "shadow"))), ("Decay-Weighted", ("contains(expression, 'decay')",)),
    ("Risk-Adjusted", ("contains(expression, 'risk_adj')",)), ("Regression Residual", ("contains(expression, 'resid')", "contains(expression, 'regression')")), ("Fundamental", tuple(f"contains(expression, '{w}')" for w in ("pe", "pb", "bvps", "roe", "eps", "mv", "dv_ttm"))),
    ("Timing (Argmax/Argmin)", ("contains(expression, 'argmax')", "contains(expression, 'argmin')")),
))
_ROLLED = [(f, ((i % 7) - 3) / 8) for i, f in enumerate([*CORPUS, *candidates(1), *engineered(_MONTHS)])]
add(
    "category_rollup",
    lambda spark, d: rounded(analytics.category_rollup(spark.createDataFrame(_ROLLED, "expression string, ic_mean double"))),
    f"""WITH x(expression, ic_mean) AS (VALUES {', '.join(f"('{f}', {v}::DOUBLE)" for f, v in _ROLLED)}), y AS (SELECT *, CASE {_CASES} ELSE 'Formulaic Alpha (Mined)' END AS category FROM x)
SELECT category, count(*) AS n, round(avg(abs(ic_mean)), 6) + 0.0 AS mean_abs_ic, round(arg_max(ic_mean, row(abs(ic_mean), ic_mean)), 6) + 0.0 AS best_ic FROM y GROUP BY category""",
)
_LIST = lambda *xs: ", ".join(f"('{x}')" for x in xs)
_OPS = "ts_argmax ts_argmin ts_decay_linear ts_delta ts_kurt ts_lag ts_max ts_mean ts_min ts_product ts_rank ts_skew ts_std ts_sum".split()
_PARTS = f"""o(op) AS (VALUES {_LIST(*_OPS)}), f(f) AS (VALUES {_LIST('open', 'high', 'low', 'close', 'volume', 'amount', 'vwap', 'returns')}), w(w) AS (VALUES (3), (5), (10), (20), (40), (60), (120)),
c(c) AS (VALUES {_LIST('cs_rank', 'cs_zscore', 'cs_scale', 'cs_demean')}), u(u) AS (VALUES {_LIST('abs', 'log', 'sign', 'sqrt', 'neg', 'inv')}), cu AS (SELECT c AS x FROM c UNION ALL SELECT u FROM u)"""
_ONE = "SELECT op || '(' || f || ', ' || w || ')' AS expression FROM o, f, w UNION SELECT x || '(' || f || ')' FROM cu, f"
_TWO = f"""{_ONE} UNION SELECT x || '(' || op || '(' || f || ', ' || w || '))' FROM cu, o, f, w
UNION SELECT op || '(' || m || '(' || a.f || ', ' || b.f || '), ' || w || ')' FROM o, (VALUES ('div'), ('sub')) m(m), f a, f b, w WHERE a.f < b.f
UNION SELECT p || '(' || a.f || ', ' || b.f || ', ' || w || ')' FROM (VALUES {_LIST('ts_corr', 'ts_cov', 'ts_rsquare', 'ts_regression_residual')}) p(p), f a, f b, (VALUES (5), (10), (20)) v(w) WHERE a.f <> b.f
UNION SELECT c || '(' || p || '(' || a || ', ' || b || ', ' || w || '))' FROM c, (VALUES {_LIST('ts_corr', 'ts_cov', 'ts_rsquare', 'ts_regression_residual')}) p(p), (VALUES {_LIST('close', 'volume', 'returns')}) x(a), (VALUES {_LIST('close', 'volume', 'returns', 'amount')}) y(b), (VALUES (10), (20)) v(w) WHERE a <> b"""
add("candidates_depth_1", lambda spark, d: spark.createDataFrame([(f,) for f in candidates(1)], "expression string"), f"WITH {_PARTS} {_ONE}")
add("candidates_depth_2", lambda spark, d: spark.createDataFrame([(f,) for f in candidates(2)], "expression string"), f"WITH {_PARTS} {_TWO}")

# ---- back-tests -------------------------------------------------------------------------------------------------

_RANKED = f"""{_S}, v AS (SELECT * FROM s WHERE value IS NOT NULL AND fwd IS NOT NULL),
rk AS (SELECT name, code, date, t, fwd, {_AVG_RANK.format(c='value')} AS r, count(*) OVER (PARTITION BY name, date) AS n FROM v), q AS (SELECT * FROM rk WHERE n >= 10),
lsd AS (SELECT name, date, avg(fwd) FILTER (r > n * 4 / 5.0) - avg(fwd) FILTER (r <= n / 5.0) AS r FROM q GROUP BY name, date),
ls AS (SELECT d.name, d.date, d.t, l.r FROM (SELECT DISTINCT name, date, t FROM s) d LEFT JOIN lsd l ON l.name = d.name AND l.date = d.date)"""


def returns(spark: SparkSession, d: str) -> DataFrame:
    return bt.long_short(signals(spark, d))


add("long_short", lambda spark, d: rounded(returns(spark, d)), _q("name, date, t", "SELECT * FROM ls", _RANKED, 6, ("r",)))
add(
    "group_returns",
    lambda spark, d: rounded(bt.group_returns(signals(spark, d))),
    _q("name, date, grp", "SELECT name, date, CAST(CASE WHEN r <= n / 5.0 THEN 1 WHEN r <= 2 * (n / 5.0) THEN 2 WHEN r <= 3 * (n / 5.0) THEN 3 WHEN r <= 4 * (n / 5.0) THEN 4 ELSE 5 END AS INTEGER) AS grp, avg(fwd) AS r FROM q GROUP BY ALL", _RANKED, 6, ("r",)),
)
_POS = f"""{_RANKED}, w0 AS (SELECT name, code, date, CASE WHEN r <= n / 5.0 THEN -1.0 / sum(CASE WHEN r <= n / 5.0 THEN 1 ELSE 0 END) OVER (PARTITION BY name, date) WHEN r > n * 4 / 5.0 THEN 1.0 / sum(CASE WHEN r > n * 4 / 5.0 THEN 1 ELSE 0 END) OVER (PARTITION BY name, date) ELSE 0.0 END AS w FROM q),
w AS (SELECT s.name, s.code, s.date, coalesce(w0.w, 0.0) AS w FROM s LEFT JOIN w0 ON w0.name = s.name AND w0.code = s.code AND w0.date = s.date)"""
add("positions", lambda spark, d: rounded(bt.positions(signals(spark, d))), _q("name, code, date", "SELECT * FROM w", _POS, 6, ("w",)))
_TURN = f"{_POS}, turns AS (SELECT name, avg(c) AS turnover FROM (SELECT name, date, sum(c) AS c FROM (SELECT name, date, abs(w - lag(w) OVER (PARTITION BY name, code ORDER BY date)) AS c FROM w) GROUP BY name, date) GROUP BY name)"
add("turnover", lambda spark, d: rounded(performance.turnover(bt.positions(signals(spark, d)))), _q("name", "SELECT * FROM turns", _TURN, 6, ("turnover",)))
_DAYS = "(PARTITION BY name ORDER BY date)"
_SHARPE = "CASE WHEN count({r}) >= 10 AND stddev_pop({r}) >= 1e-10 THEN avg({r}) / stddev_pop({r}) * sqrt(252.0) ELSE 0 END"
_ANNUAL = "CASE WHEN count({r}) >= 2 AND product(1 + {r}) > 0 THEN power(product(1 + {r}), 252.0 / count({r})) - 1 ELSE 0 END"
_EQ = f"""{_RANKED}, e0 AS (SELECT name, date, r, product(1 + r) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM ls WHERE r IS NOT NULL),
e1 AS (SELECT *, max(equity) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM e0), e AS (SELECT *, (equity - peak) / (peak + 1e-10) AS drawdown FROM e1)"""
_SMALL = 0.02  # weekly returns of order prices are huge: equity is compounded from two hundredths of them


def small(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).withColumn("r", F.col("r") * _SMALL)


_SMALL_EQ = _EQ.replace("ls AS (SELECT d.name, d.date, d.t, l.r FROM", f"ls AS (SELECT d.name, d.date, d.t, l.r * {_SMALL} AS r FROM")
add("equity_curve", lambda spark, d: rounded(performance.equity(small(spark, d)).select("name", "date", "equity", "peak", "drawdown")), _q("name, date", "SELECT * FROM e", _SMALL_EQ, 6, ("equity", "peak", "drawdown")))
add(
    "performance",
    lambda spark, d: rounded(performance.performance(small(spark, d))),
    _q("name, n_days", f"SELECT l.name, {_SHARPE.format(r='l.r')} AS sharpe, {_ANNUAL.format(r='l.r')} AS annual_return, avg(CASE WHEN l.r > 0 THEN 1.0 WHEN l.r <= 0 THEN 0.0 END) AS win_ratio, product(1 + l.r) - 1 AS total_return, count(l.r) AS n_days, (SELECT min(drawdown) FROM e WHERE e.name = l.name) AS max_drawdown FROM ls l GROUP BY l.name", _SMALL_EQ, 5, ("sharpe", "annual_return", "win_ratio", "total_return", "max_drawdown")),
)
QUERIES["performance"] = Query(lambda spark, d: rounded(performance.performance(small(spark, d)), 5), QUERIES["performance"].sql)
_PAST = "(PARTITION BY name ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
add(
    "vol_target",
    lambda spark, d: rounded(performance.vol_target(small(spark, d), 0.05).select("name", "date", "r")),
    _q("name, date", f"SELECT name, date, r * CASE WHEN k >= 5 AND v >= 1e-10 THEN least(1.0, 0.05 / v) ELSE 1.0 END AS r FROM (SELECT *, count(r) OVER {_PAST} AS k, stddev_pop(r) OVER {_PAST} * sqrt(252.0) AS v FROM ls)", _SMALL_EQ, 6, ("r",)),
)
add(
    "drawdown_cap",
    lambda spark, d: rounded(performance.drawdown_cap(small(spark, d).select("name", "date", "r"), 0.05)),
    "WITH RECURSIVE " + _SMALL_EQ + """, x AS MATERIALIZED (SELECT name, date, r, row_number() OVER (PARTITION BY name ORDER BY date) AS k FROM ls),
fold(name, k, date, r, equity, peak) AS (SELECT name, 0::BIGINT, NULL::DATE, NULL::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT name FROM x) UNION ALL
  SELECT name, k, date, CASE WHEN over_ THEN 0.0 ELSE r END, now_, greatest(peak, now_) FROM (SELECT *, CASE WHEN r IS NULL OR over_ THEN equity ELSE after END AS now_ FROM
    (SELECT x.name, x.k, x.date, x.r, f.equity, f.peak, f.equity * (1 + x.r) AS after, coalesce((f.peak - f.equity * (1 + x.r)) / (f.peak + 1e-10) > 0.05, false) AS over_ FROM fold f JOIN x ON x.name = f.name AND x.k = f.k + 1)))
SELECT name, date, round(r, 6) + 0.0 AS r FROM fold WHERE k > 0""",
)


def small_signals(spark: SparkSession, d: str) -> DataFrame:
    """The signals with forward returns of a fiftieth, so that compounding them stays within bounds."""
    return signals(spark, d).withColumn("fwd", F.col("fwd") * _SMALL)


_SMALL_S = _S.replace("momentum AS value, fwd FROM s1", f"momentum AS value, fwd * {_SMALL} AS fwd FROM s1").replace("calm, fwd FROM s1)", f"calm, fwd * {_SMALL} FROM s1)")
_AFTER_S, _AFTER_RANKED, _AFTER_POS, _AFTER_LS = _RANKED[len(_S) :], _POS[len(_RANKED) :], _TURN[len(_POS) :], _EQ[len(_RANKED) :]
_PERFORMANCE = f"SELECT l.name, {_SHARPE.format(r='l.r')} AS sharpe, {_ANNUAL.format(r='l.r')} AS annual_return, coalesce(avg(CASE WHEN l.r > 0 THEN 1.0 WHEN l.r <= 0 THEN 0.0 END), 0) AS win_ratio, product(1 + l.r) - 1 AS total_return, count(l.r) AS n_days, coalesce((SELECT min(drawdown) FROM e WHERE e.name = l.name), 0) AS max_drawdown FROM ls l GROUP BY l.name"
_RESULTS = ("sharpe", "annual_return", "win_ratio", "total_return", "max_drawdown", "turnover")


def _capped(ranked: str, before: str) -> str:
    """CTEs of back-tests whose series goes through the drawdown cap: ``fold`` and ``ls``; ``before`` makes ``x`` (name, date, r, k) of ``raw``."""
    return f"""{ranked.replace("ls AS (SELECT d.name", "raw AS (SELECT d.name")}, {before},
fold(name, k, date, r, equity, peak) AS (SELECT name, 0::BIGINT, NULL::DATE, NULL::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT name FROM x) UNION ALL
  SELECT name, k, date, CASE WHEN over_ THEN 0.0 ELSE r END, now_, greatest(peak, now_) FROM (SELECT *, CASE WHEN r IS NULL OR over_ THEN equity ELSE after END AS now_ FROM
    (SELECT x.name, x.k, x.date, x.r, f.equity, f.peak, f.equity * (1 + x.r) AS after, coalesce((f.peak - f.equity * (1 + x.r)) / (f.peak + 1e-10) > 0.05, false) AS over_ FROM fold f JOIN x ON x.name = f.name AND x.k = f.k + 1))),
ls AS (SELECT name, date, r FROM fold WHERE k > 0)"""


_TARGETED = f"x AS MATERIALIZED (SELECT name, date, r * CASE WHEN m >= 5 AND v >= 1e-10 THEN least(1.0, 0.05 / v) ELSE 1.0 END AS r, row_number() OVER (PARTITION BY name ORDER BY date) AS k FROM (SELECT *, count(r) OVER {_PAST} AS m, stddev_pop(r) OVER {_PAST} * sqrt(252.0) AS v FROM raw))"
add(
    "backtest_controlled",
    lambda spark, d: rounded(bt.backtest(small_signals(spark, d), target_vol=0.05, max_drawdown=0.05), 5),
    _q("name, n_days", f"SELECT p.*, turns.turnover FROM ({_PERFORMANCE}) p JOIN turns ON turns.name = p.name", f"RECURSIVE {_capped(_SMALL_S + _AFTER_S, _TARGETED)}{_AFTER_RANKED}{_AFTER_POS}{_AFTER_LS}", 5, _RESULTS),
)
add(
    "tearsheet",
    lambda spark, d: rounded(bt.tearsheet(small_signals(spark, d)), 5),
    _q("name, ic_days, n_days", f"SELECT f.* EXCLUDE (n_days), f.n_days AS ic_days, p.* EXCLUDE (name), turns.turnover FROM f LEFT JOIN ({_PERFORMANCE}) p ON p.name = f.name LEFT JOIN turns ON turns.name = f.name", f"{_summary_ctes(_SMALL_S)}{_AFTER_S}{_AFTER_RANKED}{_AFTER_POS}{_AFTER_LS}", 5, (*_FIGURES, *_RESULTS)),
)
_GROUPS = "SELECT name, date, CAST(CASE WHEN r <= n / 5.0 THEN 1 WHEN r <= 2 * (n / 5.0) THEN 2 WHEN r <= 3 * (n / 5.0) THEN 3 WHEN r <= 4 * (n / 5.0) THEN 4 ELSE 5 END AS INTEGER) AS grp, avg(fwd) AS r FROM q GROUP BY ALL"
add("group_totals", lambda spark, d: rounded(bt.group_totals(small_signals(spark, d)).select("name", "grp", F.log1p("total").alias("log_total")), 5), _q("name, grp", f"SELECT name, grp, ln(product(1 + r)) AS log_total FROM ({_GROUPS}) GROUP BY name, grp", _SMALL_S + _AFTER_S, 5, ("log_total",)))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    p = fixtures.panel(spark, d, "f3")
    return evaluate(p.df, {"momentum": SIGNAL, "calm": OTHER}, p.n_dates, keep=["fwd"])


_WEIGHTS = {"equal": "0.5 * coalesce(momentum, 0) + 0.5 * coalesce(calm, 0)"}
for _m, _size in (("ic_weighted", "ic_mean"), ("icir_weighted", "icir")):
    _one = "(SELECT CASE WHEN ic_mean >= 0 THEN 1 ELSE -1 END * abs({s}) FROM f WHERE name = '{n}')"
    _all = f"(SELECT sum(abs({_size})) FROM f)"
    _WEIGHTS[_m] = " + ".join(f"{_one.format(s=_size, n=n)} / {_all} * coalesce({n}, 0)" for n in ("momentum", "calm"))
for _m, _sql in _WEIGHTS.items():
    add(
        f"combine_{_m}",
        lambda spark, d, m=_m: rounded(bt.combine(_wide(spark, d), ["momentum", "calm"], m)),
        _q("name, code, date, t", f"SELECT '{_m}' AS name, code, date, t, {_sql} AS value, fwd FROM s1", _SUM, 6, ("value", "fwd")),
    )
_ADAPTIVE = f"""{_S}, z AS (SELECT t, coalesce(momentum, 0) AS a, coalesce(calm, 0) AS b, fwd AS y FROM s1 WHERE fwd IS NOT NULL),
g AS (SELECT t, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM z GROUP BY t), fits AS (SELECT unnest(range(60, (SELECT max(t) + 1 FROM s1), 5)) AS t),
m AS (SELECT fits.t, sum(aa) + 1e-4 AS aa, sum(ab) AS ab, sum(bb) + 1e-4 AS bb, sum(ay) AS ay, sum(yb) AS yb FROM fits JOIN g ON g.t >= fits.t - 120 AND g.t < fits.t GROUP BY fits.t),
c AS (SELECT t, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)"""
add(
    "combine_adaptive",
    lambda spark, d: rounded(bt.combine(_wide(spark, d), ["momentum", "calm"], "adaptive"), 5),
    _q("name, code, date, t", "SELECT 'adaptive' AS name, code, date, s1.t, wa * coalesce(momentum, 0) + wb * coalesce(calm, 0) AS value, fwd FROM s1 LEFT JOIN c ON c.t = s1.t // 5 * 5", _ADAPTIVE, 5, ("value", "fwd")),
)


def walked(spark: SparkSession, d: str, backend: str = "ridge") -> DataFrame:
    """The combiner with the test step and number of trees of the program that this follows; the training window is that of a short calendar."""
    r = cb.walk_forward(_wide(spark, d), ["momentum", "calm"], backend=backend, train=120, step=60, trees=300)
    return rounded(spark.createDataFrame([(backend, r.ic_mean, r.icir, r.positive, r.folds)], "backend string, ic_mean double, icir double, positive double, folds int"))


_RIDGE = f"""{_S}, z AS (SELECT *, count(*) OVER (PARTITION BY t) AS m FROM (SELECT code, date, t, momentum AS a, calm AS b, fwd AS y FROM s1 WHERE momentum IS NOT NULL AND calm IS NOT NULL AND fwd IS NOT NULL)), rows_ok AS (SELECT * FROM z WHERE m >= 20),
plan AS (SELECT unnest(range(125, (SELECT max(t) + 1 FROM s1), 60)) AS s),
g AS (SELECT s, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM plan JOIN rows_ok ON t >= s - 120 AND t < s - 5 GROUP BY s HAVING count(*) >= 100),
h AS (SELECT *, n + 1.0 AS k, n * ab / sqrt(va * vb) AS x, n * ay / sqrt(va) AS u, n * yb / sqrt(vb) AS v FROM g), c AS (SELECT *, (u * k - v * x) / (k * k - x * x) / sqrt(va) AS wa, (v * k - u * x) / (k * k - x * x) / sqrt(vb) AS wb FROM h),
told AS (SELECT 'ridge' AS name, code, date, wa * (a - ma) + wb * (b - mb) + my AS value, y FROM c JOIN rows_ok ON t >= s AND t < s + 60),
rk AS (SELECT date, {_AVG_RANK.format(c='value')} AS a, {_AVG_RANK.format(c='y')} AS b FROM told), daily AS (SELECT date, {_PEARSON.format(least=20)} AS ic FROM rk GROUP BY date)"""
add(
    "walk_forward_ridge",
    walked,
    _q("backend, folds", "SELECT 'ridge' AS backend, avg(ic) AS ic_mean, avg(ic) / stddev_pop(ic) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive, (SELECT CAST(count(*) AS INTEGER) FROM c) AS folds FROM daily WHERE ic IS NOT NULL", _RIDGE, 6, ("ic_mean", "icir", "positive")),
)
add("walk_forward_gbt", lambda spark, d: walked(spark, d, "gbt"))

# ---- reports ----------------------------------------------------------------------------------------------------


def _period(name: str, pattern: str, sql: str) -> None:
    add(name, lambda spark, d: rounded(analytics.compounded(small(spark, d), pattern)), _q("name, period", f"SELECT name, strftime(date, '{sql}') AS period, product(1 + r) - 1 AS r FROM ls WHERE r IS NOT NULL GROUP BY ALL", _SMALL_EQ, 6, ("r",)))


_period("yearly_returns", "yyyy", "%Y")
_period("monthly_returns", "yyyyMM", "%Y%m")
add("monthly_sums", lambda spark, d: rounded(analytics.monthly_sums(small(spark, d))), _q("name, period", "SELECT name, strftime(date, '%Y-%m') AS period, sum(r) AS total FROM ls WHERE r IS NOT NULL GROUP BY ALL", _SMALL_EQ, 6, ("total",)))
add(
    "market_model",
    lambda spark, d: rounded(analytics.market_model(small(spark, d), analytics.market(fixtures.panel(spark, d, "f3").df))),
    _q("name", "SELECT name, beta, correlation, (mr - beta * mm) * 252 AS alpha FROM (SELECT name, covar_samp(r, m) / (var_samp(m) + 1e-10) AS beta, covar_samp(r, m) / (stddev_samp(r) * stddev_samp(m)) AS correlation, avg(r) AS mr, avg(m) AS mm FROM ls JOIN (SELECT date, avg(fwd) AS m FROM p GROUP BY date) k ON k.date = ls.date WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY name)", _SMALL_EQ, 6, ("beta", "correlation", "alpha")),
)
_GRID = f"{_SMALL_EQ}, " + _TURN[len(_RANKED) + 2 :]
add(
    "cost_grid",
    lambda spark, d: rounded(analytics.cost_grid(small(spark, d), performance.turnover(bt.positions(signals(spark, d)))), 5),
    _q("name, multiplier", f"SELECT name, multiplier, {_SHARPE.format(r='r')} AS sharpe, {_ANNUAL.format(r='r')} AS annual_return FROM (SELECT ls.name, multiplier, r - turnover * 0.0031 * multiplier AS r FROM ls JOIN turns ON turns.name = ls.name CROSS JOIN (SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0, 3.0])::DOUBLE AS multiplier)) GROUP BY name, multiplier", _GRID, 5, ("sharpe", "annual_return")),
)
add(
    "regimes",
    lambda spark, d: rounded(analytics.regimes(small(spark, d))),
    _q("name, block, regime", "SELECT *, CASE WHEN total > 0.05 THEN 'Bull' WHEN total < -0.05 THEN 'Bear' WHEN vol > 0.25 THEN 'HighVol' ELSE 'LowVol' END AS regime FROM (SELECT name, CAST((k - 60) // 60 AS INTEGER) AS block, product(1 + r) - 1 AS total, stddev_pop(r) * sqrt(252.0) AS vol FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY date) - 1 AS k FROM ls) WHERE k >= 60 AND r IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)", _SMALL_EQ, 6, ("total", "vol")),
)
add(
    "tail_risk",
    lambda spark, d: rounded(analytics.tail_risk(small(spark, d)), 5),
    _q("name", f"SELECT x.name, avg(r) FILTER (k <= greatest(1, floor(n * 0.05))) AS cvar, sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0) AS profit_factor, {_ANNUAL.format(r='r')} / nullif(abs((SELECT min(drawdown) FROM e WHERE e.name = x.name)), 0) AS calmar FROM (SELECT name, r, row_number() OVER (PARTITION BY name ORDER BY r, date) AS k, count(*) OVER (PARTITION BY name) AS n FROM ls WHERE r IS NOT NULL) x GROUP BY x.name", _SMALL_EQ, 5, ("cvar", "profit_factor", "calmar")),
)
add(
    "sharpe_halves",
    lambda spark, d: rounded(analytics.halves(small(spark, d))),
    _q("name", f"SELECT name, {_SHARPE.format(r='CASE WHEN k <= n // 2 THEN r END')} AS first, {_SHARPE.format(r='CASE WHEN k > n // 2 THEN r END')} AS second FROM (SELECT name, r, row_number() OVER (PARTITION BY name ORDER BY date) AS k, count(*) OVER (PARTITION BY name) AS n FROM ls WHERE r IS NOT NULL) GROUP BY name", _SMALL_EQ, 6, ("first", "second")),
)
add(
    "deflated_sharpe",
    lambda spark, d: rounded(analytics.deflated_sharpe(small(spark, d)), 5),
    _q("name", f"SELECT name, sharpe, skew, kurt, (sharpe - sqrt(2 * ln(22110))) / greatest(0.01, sqrt(greatest(0, 1 + skew * sharpe / 3 + (kurt - 1) / 4 * sharpe * sharpe))) AS deflated FROM (SELECT name, {_SHARPE.format(r='r')} AS sharpe, skewness(r) AS skew, kurtosis(r) AS kurt FROM ls GROUP BY name)", _SMALL_EQ, 5, ("sharpe", "skew", "kurt", "deflated")),
)
add("rolling_sharpe", lambda spark, d: rounded(performance.rolling_sharpe(small(spark, d)).select("name", "date", "rolling_sharpe"), 5), _q("name, date", "SELECT name, date, CASE WHEN k > 63 AND c >= 20 AND v >= 1e-10 THEN m / nullif(v, 0) * sqrt(252.0) END AS rolling_sharpe FROM (SELECT *, row_number() OVER o AS k, count(r) OVER w AS c, avg(r) OVER w AS m, stddev_pop(r) OVER w AS v FROM ls WINDOW o AS (PARTITION BY name ORDER BY date), w AS (PARTITION BY name ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))", _SMALL_EQ, 5, ("rolling_sharpe",)))
add("rolling_vol", lambda spark, d: rounded(performance.rolling_vol(small(spark, d)).select("name", "date", "rolling_vol")), _q("name, date", "SELECT name, date, CASE WHEN k > 21 AND c >= 10 AND v >= 1e-10 THEN v * sqrt(252.0) END AS rolling_vol FROM (SELECT *, row_number() OVER o AS k, count(r) OVER w AS c, stddev_pop(r) OVER w AS v FROM ls WINDOW o AS (PARTITION BY name ORDER BY date), w AS (PARTITION BY name ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))", _SMALL_EQ, 6, ("rolling_vol",)))
add("profit_and_loss", lambda spark, d: rounded(performance.profit_and_loss(small(spark, d), 100.0).select("name", "date", "pnl", "balance"), 4), _q("name, date", "SELECT name, date, 100.0 * r AS pnl, 100.0 * coalesce(product(1 + coalesce(r, 0)) OVER (PARTITION BY name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS balance FROM ls", _SMALL_EQ, 4, ("pnl", "balance")))
add("milestones", lambda spark, d: analytics.milestones(performance.profit_and_loss(small(spark, d), 100.0), (90.0, 95.0, 100.0)), "WITH " + _SMALL_EQ + ", b AS (SELECT name, date, 100.0 * coalesce(product(1 + coalesce(r, 0)) OVER (PARTITION BY name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS balance FROM ls), c AS (SELECT *, lag(balance) OVER (PARTITION BY name ORDER BY date) AS before_ FROM b) SELECT name, threshold, date FROM c CROSS JOIN (SELECT unnest([90.0, 95.0, 100.0])::DOUBLE AS threshold) WHERE before_ < threshold AND balance >= threshold")
_EVENTS = f"""RECURSIVE {_SMALL_EQ}, ed AS MATERIALIZED (SELECT name, date, (equity - greatest(peak, 1.0)) / (greatest(peak, 1.0) + 1e-10) AS dd, row_number() OVER {_DAYS} AS day FROM e1),
st(name, day, inside) AS (SELECT DISTINCT name, 0::BIGINT, 0 FROM ed UNION ALL SELECT d.name, d.day, CASE WHEN d.dd < -0.01 THEN 1 WHEN d.dd >= -0.005 THEN 0 ELSE st.inside END FROM st JOIN ed d ON d.name = st.name AND d.day = st.day + 1),
sp AS (SELECT ed.*, st.inside, coalesce(lag(st.inside) OVER (PARTITION BY ed.name ORDER BY ed.day), 0) AS before_ FROM ed JOIN st ON st.name = ed.name AND st.day = ed.day),
sq AS (SELECT *, sum(CASE WHEN inside = 1 AND before_ = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY day) AS spell FROM sp)"""
add(
    "drawdown_events",
    lambda spark, d: rounded(analytics.drawdown_events(small(spark, d))),
    _q('name, started, trough, ended, days, recovery, "over"', """SELECT name, min(date) AS started, arg_min(date, row(dd, day)) FILTER (inside = 1) AS trough, max(date) AS ended, min(dd) FILTER (inside = 1) AS depth, CAST(max(day) - min(day) AS INTEGER) AS days,
  CAST(max(day) - arg_min(day, row(dd, day)) FILTER (inside = 1) AS INTEGER) AS recovery, min(inside) = 0 AS "over" FROM sq WHERE inside = 1 OR before_ = 1 GROUP BY name, spell""", _EVENTS, 6, ("depth",)),
)
_PLAIN = "x AS MATERIALIZED (SELECT name, date, r, row_number() OVER (PARTITION BY name ORDER BY date) AS k FROM raw)"
add(
    "capped_days",
    lambda spark, d: analytics.capped_days(performance.drawdown_cap(small(spark, d).select("name", "date", "r"), 0.05)),
    f"WITH RECURSIVE {_capped(_SMALL_S + _AFTER_S, _PLAIN)} SELECT name, count(*) FILTER (r = 0) AS capped_days FROM ls GROUP BY name",
)
_CARD = f"{_SMALL_S}{_AFTER_S}{_AFTER_RANKED}{_AFTER_POS}{_AFTER_LS}"
_CARD += f""", nets AS (SELECT l.name, {_SHARPE.format(r='l.r - turnover * 0.0031')} AS net_sharpe, {_ANNUAL.format(r='(l.r - turnover * 0.0031)')} AS net, {_ANNUAL.format(r='l.r')} AS gross FROM ls l JOIN turns ON turns.name = l.name GROUP BY l.name),
deep AS (SELECT name, min(drawdown) AS max_drawdown FROM e GROUP BY name), numbered AS (SELECT name, r, row_number() OVER {_DAYS} AS k, count(*) OVER (PARTITION BY name) AS n FROM ls WHERE r IS NOT NULL),
parts AS (SELECT name, {_SHARPE.format(r='CASE WHEN k > n // 2 THEN r END')} / ({_SHARPE.format(r='CASE WHEN k <= n // 2 THEN r END')} + 1e-10) AS oos_ratio, sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0) AS profit_factor, {_SHARPE.format(r='r')} AS sr, skewness(r) AS skew, kurtosis(r) AS kurt FROM numbered GROUP BY name),
betas AS (SELECT name, covar_samp(r, m) / (var_samp(m) + 1e-10) AS beta FROM ls JOIN (SELECT date, avg(fwd) AS m FROM p GROUP BY date) k ON k.date = ls.date WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY name),
figures AS (SELECT nets.name, net_sharpe, max_drawdown, oos_ratio, gross / nullif(abs(max_drawdown), 0) AS calmar, profit_factor, coalesce(net / nullif(gross, 0), 0) * 100 AS alpha_retention, beta,
  (sr - sqrt(2 * ln(22110))) / greatest(0.01, sqrt(greatest(0, 1 + skew * sr / 3 + (kurt - 1) / 4 * sr * sr))) AS deflated_sharpe FROM nets JOIN deep ON deep.name = nets.name JOIN parts ON parts.name = nets.name JOIN betas ON betas.name = nets.name)"""
add(
    "report_card",
    lambda spark, d: rounded(analytics.report_card(small(spark, d), performance.turnover(bt.positions(signals(spark, d))), analytics.market(fixtures.panel(spark, d, "f3").df)), 4),
    _q("name, passed, light", """SELECT *, CAST((net_sharpe > 1) AS INTEGER) + CAST((abs(max_drawdown) < 0.15) AS INTEGER) + CAST((oos_ratio > 0.6) AS INTEGER) + CAST((calmar > 1) AS INTEGER) + CAST((profit_factor > 1.5) AS INTEGER) + CAST((alpha_retention > 60) AS INTEGER)
  + CAST((abs(beta) < 0.1) AS INTEGER) + CAST((deflated_sharpe > 0) AS INTEGER) AS passed, CASE WHEN net_sharpe > 2 AND abs(max_drawdown) < 0.06 AND oos_ratio > 0.5 THEN 'GREEN' WHEN net_sharpe > 1 AND abs(max_drawdown) < 0.1 THEN 'YELLOW' ELSE 'RED' END AS light FROM figures""", _CARD, 4, tuple(analytics.CHECKS)),
)

# ---- stores ------------------------------------------------------------------------------------------------------

add(
    "panel_of_first_assets",
    lambda spark, d: fixtures.panel(spark, d, "f1").head(10).df.select("code", "date", "t", "high", "low"),
    f"WITH {fixtures.panel_ctes('f1')} SELECT code, date, t, high, low FROM p WHERE code IN (SELECT code FROM (SELECT DISTINCT code FROM bars) ORDER BY code LIMIT 10)",
)


def cached_panel(spark: SparkSession, d: str) -> DataFrame:
    """A panel that was saved and loaded again."""
    path = stores.scratch_dir(spark, "panel")
    stores.save_panel(fixtures.panel(spark, d, "f3"), path)
    return stores.load_panel(spark, path).df.select("code", "date", "t", "open", "close", "volume")


def bars_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as one folder per asset, read again as one table."""
    path = stores.scratch_dir(spark, "bars")
    stores.write_by_asset(fixtures.bars(spark, d, "f3"), path)
    return stores.read_by_asset(spark, path).select("code", "date", "open", "close", "volume")


def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """Vendor bars in two files of vendor names, text among the numbers, scanned as one table."""
    path = stores.scratch_dir(spark, "vendor")
    raw = fixtures.bars(spark, d, "f3").select(F.col("code").alias("ts_code"), F.col("date").alias("trade_date"), "open", F.when(F.col("volume") > 1, F.col("high").cast("string")).otherwise("n/a").alias("high"), "low", "close", F.col("volume").alias("vol"))
    for i in range(2):
        raw.where(F.pmod(F.crc32(F.col("ts_code").cast("binary")), F.lit(2)) == i).write.parquet(f"{path}/{i}")
    return rounded(read_bars(spark, [f"{path}/0", f"{path}/1"]).select("code", "date", "high", "close", "volume", "amount"), 2)


add("panel_cache", cached_panel, f"WITH {fixtures.panel_ctes('f3')} SELECT code, date, t, open, close, volume FROM p")
add("bars_by_asset", bars_of_files, f"WITH {fixtures.bars_ctes('f3')} SELECT code, date, open, close, volume FROM bars")
add("bars_of_vendor_files", scanned_files, _q("code, date", "SELECT code, date, CASE WHEN volume > 1 THEN high END AS high, close, volume, close * volume AS amount FROM bars", fixtures.bars_ctes("f3"), 2, ("high", "close", "volume", "amount")))
_RECORDS = [(f, ((i * 7) % 11 - 5) / 40) for i, f in enumerate(CORPUS)]
add(
    "strongest_records",
    lambda spark, d: stores.strongest(spark.createDataFrame(_RECORDS, "expression string, ic_mean double"), 5),
    f"SELECT expression, ic_mean FROM (VALUES {', '.join(f'({f!r}, {v}::DOUBLE)' for f, v in _RECORDS)}) x(expression, ic_mean) ORDER BY abs(ic_mean) DESC, expression LIMIT 5",
)
add("constituents", lambda spark, d: stores.constituents(fixtures.table(spark, d, "supplier"), "s_suppkey"), "SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code FROM supplier")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: panel, formula, rank IC by date, summary."""
    return rounded(ic.ic_summary(ic.ic_series(signals(spark, sf_dir, momentum=SIGNAL))))


__all__ = ["CORPUS", "QUERIES", "Query", "entry"]
