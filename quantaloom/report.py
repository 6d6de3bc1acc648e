"""Reports as Markdown: figures come from the cluster as small tables, the driver writes them down."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom import backtest as bt
from quantaloom.functions import analytics, ic, performance
from quantaloom.sources.panel import Panel

MOST_ROWS = 200


def table(df: DataFrame, digits: int = 4) -> str:
    """A small table; of a longer one the first rows, and a line that says so."""
    rows = df.limit(MOST_ROWS + 1).collect()
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([shown(v) for v in r] for r in rows[:MOST_ROWS])]
    text = "\n".join("| " + " | ".join(line) + " |" for line in lines)
    return text + (f"\n\nFirst {MOST_ROWS} rows." if len(rows) > MOST_ROWS else "")


def sections(panel: Panel, signals: DataFrame, factors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a report on signals (name, code, date, t, value, fwd) and on factors (expression, ic_mean), by title."""
    ics, series = ic.ic_series(signals).persist(), bt.long_short(signals).persist()
    turns = performance.turnover(bt.positions(signals))
    out = {
        "Information coefficients": ic.ic_summary(ics).join(ic.extremes(ics), "name").orderBy("name"),
        "Back-test": bt.backtest(signals).orderBy("name"),
        "Checks": analytics.report_card(series, turns, analytics.market(panel.df)).orderBy("name"),
        "Years": analytics.compounded(series, "yyyy").orderBy("name", "period"),
        "Costs": analytics.cost_grid(series, turns).orderBy("name", "multiplier"),
        "Regimes": analytics.regimes(series).groupBy("name", "regime").agg(F.count("*").alias("blocks"), F.avg("total").alias("mean_return")).orderBy("name", "regime"),
        "Drawdowns": analytics.drawdown_events(series).orderBy("name", "started"),
    }
    return out | ({"Categories": analytics.category_rollup(factors).orderBy("category")} if factors is not None else {})


def markdown(title: str, parts: Mapping[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{table(df)}" for name, df in parts.items())]) + "\n"
