"""The mining loop: propose formulas, screen them on a small panel, check them on the whole one, remember."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import functions as F

from quantaloom.functions.ic import ic_summary
from quantaloom.generate import candidates
from quantaloom.library import FactorLibrary, FactorRecord, Verdict, measure, signal_turnover
from quantaloom.memory import ExperienceMemory
from quantaloom.plans.expression import validate
from quantaloom.sources.panel import Panel

FAST_ASSETS = 50


@dataclass(frozen=True)
class Proposal:
    expression: str
    logic: str = ""


class Proposer(Protocol):
    """Where formulas come from: an enumerator, or a client of a language model."""

    def propose(self, context: dict[str, str], n: int) -> Sequence[Proposal]: ...

    def insights(self, admitted: Sequence[dict], rejected: Sequence[dict]) -> Sequence[str]: ...


class Enumerator:
    """Proposes the enumerated candidates in a random order, each once."""

    def __init__(self, formulas: Iterable[str] | None = None, seed: int = 0) -> None:
        self.left = list(formulas) if formulas is not None else candidates(2)
        random.Random(seed).shuffle(self.left)

    def propose(self, context: dict[str, str], n: int) -> Sequence[Proposal]:
        out, self.left = self.left[:n], self.left[n:]
        return [Proposal(f) for f in out]

    def insights(self, admitted: Sequence[dict], rejected: Sequence[dict]) -> Sequence[str]:
        return []


def parse_proposals(text: str) -> list[Proposal]:
    """Valid formulas of the first JSON array in a model's answer: objects with expression and logic, or texts."""
    found = re.search(r"\[.*\]", text, re.DOTALL)
    try:
        items = json.loads(found.group()) if found else []
    except ValueError:
        return []
    pairs = [(x.get("expression"), x.get("logic", "")) if isinstance(x, dict) else (x, "") for x in items]
    return [Proposal(e, str(why)) for e, why in pairs if isinstance(e, str) and validate(e)[0]]


class Miner:
    """Rounds of proposals until the library is full, the rounds are used up, or it is stopped.

    A round's proposals are screened in one plan over the first assets, and those that pass are measured in one plan over all.
    """

    def __init__(
        self, panel: Panel, library: FactorLibrary, memory: ExperienceMemory, proposer: Proposer | None = None, *, batch_size: int = 10, max_rounds: int = 50, ic_threshold: float = 0.02,
        corr_threshold: float = 0.7, target_size: int = 100, fast_assets: int = FAST_ASSETS, log: Callable[[str], Any] | None = None,
    ) -> None:
        self.panel, self.library, self.memory, self.proposer = panel, library, memory, proposer or Enumerator()
        self.batch_size, self.max_rounds, self.ic_threshold, self.corr_threshold, self.target_size = batch_size, max_rounds, ic_threshold, corr_threshold, target_size
        self.fast, self.log = panel.head(fast_assets), log or (lambda _: None)
        self.round, self.running, self.status = 0, False, "idle"

    def _screened(self, proposals: Sequence[Proposal]) -> dict[int, Verdict]:
        """Why proposals (by number) fail the fast screen."""
        ics, absent = measure(self.fast, [p.expression for p in proposals])
        stats = {r["name"]: r for r in absent.join(ic_summary(ics), "name", "left").collect()}
        out = {}
        for i in range(len(proposals)):
            r = stats[f"f{i}"]
            if r["missing"] > 0.5:
                out[i] = Verdict(False, "missing", {"share": r["missing"]})
            elif (r["n_days"] or 0) < 10:
                out[i] = Verdict(False, "too_few_days", {"days": r["n_days"] or 0})
            elif abs(r["ic_mean"]) < self.ic_threshold:
                out[i] = Verdict(False, "weak", {"ic": abs(r["ic_mean"]), "least": self.ic_threshold})
        return out

    def evaluate(self, proposals: Sequence[Proposal]) -> list[dict[str, Any]]:
        """Results of a round, in order; admitted formulas are in the library afterwards."""
        known = {c for c in self.panel.df.columns if c not in ("code", "date", "t", "fwd")}
        results: list[dict[str, Any]] = [{"expression": p.expression, "logic": p.logic, "admitted": False, "code": "", "reason": "", "figures": {}, "ic_mean": 0.0} for p in proposals]

        def settle(i: int, v: Verdict) -> None:
            results[i] |= {"admitted": v.admitted, "code": v.code, "reason": v.reason, "figures": v.figures}

        valid = []
        for i, p in enumerate(proposals):
            ok, why = validate(p.expression, known)
            if ok:
                valid.append(i)
            else:
                results[i] |= {"code": "invalid", "reason": f"invalid: {why}"}
        if not valid:
            return results
        for k, why in self._screened([proposals[i] for i in valid]).items():
            settle(valid[k], why)
        left = [i for i in valid if not results[i]["code"]]
        if not left:
            return results
        ics = measure(self.panel, [proposals[i].expression for i in left])[0].persist()
        stats = {r["name"]: r for r in ic_summary(ics).collect()}
        for k, i in enumerate(left):
            formula, s = proposals[i].expression, stats.get(f"f{k}")
            verdict = self.library.check(self.panel, formula, ics.where(F.col("name") == f"f{k}"), ic_threshold=self.ic_threshold, corr_threshold=self.corr_threshold)
            settle(i, verdict)
            results[i]["ic_mean"] = s["ic_mean"] if s else 0.0
            if verdict.admitted:
                record = FactorRecord(formula, s["ic_mean"], s["ic_std"], s["icir"], verdict.max_correlation, signal_turnover(self.panel, formula), proposals[i].logic, mining_round=self.round)
                self.library.admit(record, verdict.replace)
                self.log(f"admitted {formula} IC {s['ic_mean']:.4f}")
        ics.unpersist()
        return results

    def run(self) -> None:
        if self.running:
            self.log("already running")
            return
        self.running, self.status = True, "mining"
        try:
            for n in range(1, self.max_rounds + 1):
                if not self.running or len(self.library) >= self.target_size:
                    break
                self.round = self.memory.tally.rounds = n
                proposals = self.proposer.propose(self.memory.retrieve(len(self.library)), self.batch_size)
                if not proposals:
                    self.log("no proposals")
                    continue
                results = self.evaluate(proposals)
                admitted, rejected = ([r for r in results if r["admitted"] is x] for x in (True, False))
                self.log(f"round {n}: {len(admitted)} of {len(results)} admitted, {len(self.library)} in the library")
                self.memory.formation(results)
                if n % 5 == 0:
                    self.memory.evolution(self.proposer.insights(admitted, rejected))
            self.status = "completed"
        except Exception:
            self.status = "error"
            raise
        finally:
            self.running = False

    def stop(self) -> None:
        self.running, self.status = False, "stopping"

    def state(self) -> dict[str, Any]:
        return {
            "status": self.status, "current_round": self.round, "max_rounds": self.max_rounds, "library_size": len(self.library), "target_size": self.target_size,
            "is_running": self.running, "admission_rate": self.memory.tally.share,
        }
