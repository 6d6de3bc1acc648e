"""The service's operations as plain functions over a panel, a library and a memory; any web framework can expose them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark.sql import functions as F

from quantaloom.backtest import backtest, combine, group_totals, library_backtest, long_short
from quantaloom.functions.ic import ic_series, ic_summary, to_long
from quantaloom.functions.performance import equity
from quantaloom.library import FactorLibrary
from quantaloom.memory import ExperienceMemory
from quantaloom.mine import Miner
from quantaloom.plans.compiler import evaluate
from quantaloom.plans.expression import validate
from quantaloom.sources.panel import Panel

MAX_LISTENERS = 10


class Service:
    """One miner at a time; results are plain dictionaries."""

    def __init__(self, panel: Panel, library: FactorLibrary, memory: ExperienceMemory) -> None:
        self.panel, self.library, self.memory = panel, library, memory
        self.miner: Miner | None = None
        self.listeners: list[Callable[[str], Any]] = []

    def listen(self, callback: Callable[[str], Any]) -> bool:
        """Send log lines to ``callback``; False if there are too many listeners already."""
        if len(self.listeners) >= MAX_LISTENERS:
            return False
        self.listeners.append(callback)
        return True

    def broadcast(self, line: str) -> None:
        for callback in list(self.listeners):
            try:
                callback(line)
            except Exception:  # a listener that fails is dropped
                self.listeners.remove(callback)

    def start(self, **config: Any) -> Miner:
        """A miner, ready to run; an error if one is running."""
        if self.miner and self.miner.running:
            raise RuntimeError("Mining is already running")
        self.miner = Miner(self.panel, self.library, self.memory, log=self.broadcast, **config)
        return self.miner

    def stop(self) -> str:
        if self.miner and self.miner.running:
            self.miner.stop()
            return "stopping"
        return "not_running"

    def status(self) -> dict[str, Any]:
        if self.miner:
            return self.miner.state()
        return {"status": "idle", "current_round": 0, "max_rounds": 0, "library_size": len(self.library), "target_size": 0, "is_running": False, "admission_rate": 0.0}

    def factors(self) -> dict[str, Any]:
        return {"factors": [asdict(f) for f in self.library.factors], "total": len(self.library)}

    def memory_state(self) -> dict[str, Any]:
        return self.memory.snapshot()

    def analyse(self, formula: str, **how: Any) -> dict[str, Any]:
        """IC statistics, back-test, group totals and equity curve of one formula."""
        ok, why = validate(formula)
        if not ok:
            return {"error": why}
        signals = to_long(evaluate(self.panel.df, {"x": formula}, self.panel.n_dates, keep=["fwd"]), ["x"])
        ics = ic_series(signals)
        out = {**(ic_summary(ics).first() or {}).asDict(), **backtest(signals, **how).first().asDict()}
        out["ic_series"] = [r["ic"] for r in ics.where(F.col("ic").isNotNull()).orderBy("t").collect()]
        out["cumulative_returns"] = [r["equity"] for r in equity(long_short(signals)).orderBy("date").collect()]
        out["group_cumulative_returns"] = {f"Q{r['grp']}": r["total"] for r in group_totals(signals).collect()}
        return out | {"name": formula}

    def detail(self, factor_id: str) -> dict[str, Any]:
        record = self.library.record(factor_id)
        return {"factor": asdict(record), "analysis": self.analyse(record.expression)} if record else {"error": "Factor not found"}

    def backtest(self, factor_id: str | None = None, method: str = "ic_weighted", **how: Any) -> dict[str, Any]:
        """Back-test of one record, or of the whole library combined."""
        if not len(self.library):
            return {"error": "Factor library is empty"}
        if factor_id:
            record = self.library.record(factor_id)
            return self.analyse(record.expression, **how) if record else {"error": "Factor not found"}
        good = [f.expression for f in self.library.factors if validate(f.expression)[0]]
        if not good:
            return {"error": "No valid signals could be computed"}
        named = {f"f{i}": e for i, e in enumerate(good)}
        wide = evaluate(self.panel.df, named, self.panel.n_dates, keep=["fwd"]).persist()
        out = library_backtest(wide, list(named), method, **how).first().asDict()
        wide.unpersist()
        return out | {"name": f"Library ({len(good)} factors, {method})"}


__all__ = ["Service", "combine"]
