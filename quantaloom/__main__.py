"""Command line: ``python -m quantaloom COMMAND --bars PATH [--library FILE] ...``"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from quantaloom import report, ship
from quantaloom.backtest import combine
from quantaloom.combine import walk_forward
from quantaloom.generate import candidates, combiner_features, engineered
from quantaloom.library import FactorLibrary, FactorRecord, screen
from quantaloom.memory import ExperienceMemory
from quantaloom.plans.compiler import evaluate
from quantaloom.service import Service
from quantaloom.sources import fundamentals
from quantaloom.sources.panel import build_panel, read_bars, with_forward
from quantaloom.sources.stores import save_json

COMMANDS = ("mine", "list", "backtest", "combine", "pipeline", "evaluate", "report", "all", "reinit")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantaloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--bars", help="parquet of daily bars")
    p.add_argument("--library", default="factor_library.json")
    p.add_argument("--memory", default="experience_memory.json")
    p.add_argument("--assets", type=int, default=300)
    p.add_argument("--min-days", type=int, default=500)
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--rounds", type=int, default=10)
    p.add_argument("--ic", type=float, default=0.015)
    p.add_argument("--corr", type=float, default=0.75)
    p.add_argument("--method", default="ic_weighted")
    p.add_argument("--backend", default="ridge")
    p.add_argument("--train", type=int, default=500)
    p.add_argument("--step", type=int, default=60)
    p.add_argument("--fundamentals", help="folder of parquet files of daily and quarterly fundamentals")
    p.add_argument("--no-hlz", action="store_true", help="screen without the threshold for many tests")
    p.add_argument("--no-oos", action="store_true", help="screen without the out-of-sample check")
    p.add_argument("--all-signs", action="store_true", help="keep candidates of negative mean IC")
    p.add_argument("--target-vol", type=float)
    p.add_argument("--max-drawdown", type=float)
    p.add_argument("--out", default="report.json")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "list":
        for f in sorted(FactorLibrary(a.library).factors, key=lambda f: -abs(f.ic_mean)):
            print(f"{f.factor_id} {f.ic_mean:+.4f} {f.icir:+.3f} {f.expression}")
        return
    if a.command == "reinit":
        save_json(a.library, [])
        save_json(a.memory, {})
        return
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    panel = with_forward(build_panel(read_bars(spark, a.bars), max_assets=a.assets, min_days=a.min_days))
    if a.fundamentals:
        panel = fundamentals.load(spark, panel, a.fundamentals)
    panel = type(panel)(panel.df.persist(), panel.n_dates)
    service = Service(panel, FactorLibrary(a.library), ExperienceMemory(a.memory))
    how = {"target_vol": a.target_vol, "max_drawdown": a.max_drawdown}
    if a.command in ("mine", "all"):
        service.listen(print)
        service.start(max_rounds=a.rounds, ic_threshold=a.ic, corr_threshold=a.corr).run()
    if a.command in ("pipeline", "all"):
        found = screen(panel, candidates(a.depth, bool(a.fundamentals)), ic_threshold=a.ic, use_hlz=not a.no_hlz, use_oos=not a.no_oos, max_corr=a.corr, positive_only=not a.all_signs, always_dedup=True)
        for s in found:
            service.library.admit(FactorRecord(s.expression, ic_mean=s.ic_mean, icir=s.icir))
        print(f"{len(found)} candidates kept")
    if a.command in ("backtest", "report", "all"):
        print(json.dumps(service.backtest(method=a.method, **how), default=str, indent=1))
    if a.command in ("combine", "evaluate", "pipeline", "all"):
        names = engineered(panel.n_dates, fundamentals.held(panel)) if a.command == "evaluate" else combiner_features(panel.n_dates)
        wide = evaluate(panel.df, names, panel.n_dates, keep=["fwd"]).persist()
        r = walk_forward(wide, list(names), backend=a.backend, train=a.train, step=a.step)
        print(f"{r.backend}: IC {r.ic_mean:.4f}, ICIR {r.icir:.3f}, positive {r.positive:.1%}, {r.folds} folds, {r.verdict}")
    if a.command == "report" and a.out.endswith(".md"):
        records = [(f.expression, f.ic_mean) for f in service.library.factors]
        named = {f"f{i}": e for i, (e, _) in enumerate(records)}
        wide = evaluate(panel.df, named, panel.n_dates, keep=["fwd"])
        parts = report.sections(panel, combine(wide, list(named), a.method), spark.createDataFrame(records, "expression string, ic_mean double"))
        Path(a.out).write_text(report.markdown(f"Library of {len(records)} formulas, {a.method}", parts), encoding="utf-8")
    elif a.command == "report":
        Path(a.out).write_text(json.dumps({"factors": service.factors(), "library": service.backtest(method=a.method, **how), "memory": service.memory_state()}, default=str, indent=1))


if __name__ == "__main__":
    main()
