"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, and jobs at the size of a published run; prints one line of JSON.

Names as arguments choose some of them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINE = (
    "panel_f1", "asof_fundamentals", "ts_mean", "ts_rank", "ts_corr", "ts_skew", "cs_rank", "formula_levels", "alpha_corpus",
    "ic_summary", "out_of_sample", "long_short", "performance", "drawdown_cap", "combine_ic_weighted", "combine_adaptive", "walk_forward_ridge", "cost_grid",
)


#: Size of the panel on which combination and screening are timed, and number of signals.
ASSETS, DATES, SIGNALS = 300, 1698, 50


def wide_panel(spark, columns: dict):
    """(code, date, t, fwd, columns ...) of ASSETS x DATES rows, made of hashes; ``columns``: name to a number that seeds it."""
    from pyspark.sql import functions as F

    unit = lambda i: F.xxhash64("id", F.lit(i)) / F.lit(float(1 << 63))
    rows = spark.range(ASSETS * DATES).withColumn("t", F.floor(F.col("id") / ASSETS).cast("int"))
    code, date = F.format_string("%04d", F.col("id") % ASSETS), F.date_add(F.lit("2018-01-02").cast("date"), F.col("t"))
    return rows.select(code.alias("code"), date.alias("date"), "t", (unit(-1) * 0.02 + unit(0) * 0.001).alias("fwd"), *[unit(i).alias(n) for n, i in columns.items()])


def at_size(spark) -> dict:
    """Jobs at the size of a published run: adaptive and walk-forward combination of SIGNALS signals, and a batch of the screen."""
    from pyspark.sql import functions as F

    from quantaloom import combine, library
    from quantaloom.functions import ic
    from quantaloom.generate import candidates
    from quantaloom.sources.panel import Panel

    names = [f"s{i}" for i in range(SIGNALS)]

    def ics():
        wide = wide_panel(spark, {n: i for i, n in enumerate(names)})
        ic.ic_summary(ic.ic_wide(wide, names)).write.format("noop").mode("overwrite").save()

    def adaptive():
        wide = wide_panel(spark, {n: i for i, n in enumerate(names)})
        combine.adaptive_combine(wide, names).write.format("noop").mode("overwrite").save()

    def ridge():
        combine.walk_forward(wide_panel(spark, {n: i for i, n in enumerate(names)}), names)

    def screen():
        fields = ("open", "high", "low", "close", "volume", "amount", "vwap", "returns")
        df = wide_panel(spark, {n: 1000 + i for i, n in enumerate(fields)})
        panel = Panel(df.withColumns({n: F.col(n) + 2 for n in fields}).persist(), DATES)
        library.screen(panel, candidates(1)[:64], ic_threshold=0.0)
        panel.df.unpersist()

    size = f"{ASSETS}x{DATES}"
    return {f"ic_of_{SIGNALS}_signals_{size}": ics, f"adaptive_{SIGNALS}_signals_{size}": adaptive, f"ridge_{SIGNALS}_signals_{size}": ridge, f"screen_64_formulas_{size}": screen}


def main() -> None:
    from pyspark.sql import SparkSession

    from quantaloom.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    jobs = {n: (lambda n=n: QUERIES[n].run(spark, sf_dir).write.format("noop").mode("overwrite").save()) for n in HEADLINE} | at_size(spark)
    # The last two take minutes; they run when they are named.
    chosen = sys.argv[1:] or list(jobs)[:-2]
    took = {}
    for name in chosen:
        began = time.time()
        jobs[name]()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
