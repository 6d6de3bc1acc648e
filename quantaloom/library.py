"""Screening of candidates and the factor library: who is admitted, who is replaced."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.functions.ic import FLAT, MIN_ASSETS, hlz_threshold, ic_summary, out_of_sample, series_of, signal_correlation, to_long
from quantaloom.plans import blocks
from quantaloom.plans.compiler import evaluate
from quantaloom.plans.expression import validate
from quantaloom.scratch import free, materialize_blocks
from quantaloom.sources.panel import FEATURES, Panel
from quantaloom.sources.stores import load_json, save_json

BATCH = 64


def batches(formulas: Sequence[str], size: int = BATCH) -> Iterator[list[str]]:
    for at in range(0, len(formulas), size):
        yield list(formulas[at : at + size])


def signals(panel: Panel, formulas: Sequence[str]) -> DataFrame:
    """A batch of formulas as columns f0, f1, ... beside fwd, which ``panel`` has."""
    return evaluate(panel.df, {f"f{i}": f for i, f in enumerate(formulas)}, panel.n_dates, keep=["fwd"])


def measure(panel: Panel, formulas: Sequence[str], wide: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(IC series, share of missing cells) of a batch of formulas, in long form; ``wide``: their signals, if at hand."""
    wide = signals(panel, formulas) if wide is None else wide
    names = [f"f{i}" for i in range(len(formulas))]
    absent = to_long(wide.agg(*[F.avg(F.col(n).isNull().cast("double")).alias(n) for n in names]), names, "missing")
    return series_of(wide, names), absent


@dataclass
class Screened:
    expression: str
    ic_mean: float
    icir: float
    t_stat: float
    oos_ic: float
    ic: np.ndarray = field(repr=False)  # by date index, missing days 0


def screen(
    panel: Panel, formulas: Sequence[str], *, ic_threshold: float = 0.005, use_hlz: bool = False, use_oos: bool = False, max_corr: float = 0.85, max_keep: int = 10_000,
    positive_only: bool = False, always_dedup: bool = False, most_missing: float = 0.5, least_days: int = 50, batch: int = BATCH,
) -> list[Screened]:
    """Candidates that pass: enough values and IC days, |mean IC|, its sign and t, out-of-sample decay; the highest mean IC first.

    If more than ``max_keep`` pass (or ``always_dedup``), those whose IC series resemble a better one's are left out.  Formulas that
    are invalid for the panel are skipped.  The panel is packed once, into a table of the shared folder; a batch is dealt out in rounds whose shuffle files
    go when its figures are there, one row a day and candidate.  Candidates that roll over ranks are one plan a batch over the panel itself.
    """
    known = {c for c in panel.df.columns if c not in ("code", "date", "t", "fwd")}
    good = [f for f in formulas if validate(f, known)[0]]
    need = hlz_threshold(len(formulas)) if use_hlz else 0.0
    passed: list[Screened] = []
    trees = blocks.trees_of({f: f for f in good}, known, panel.n_dates)
    ready = {f: blocks.fits(trees[f]) for f in good}
    columns = {*blocks.needed({f: trees[f] for f in good if ready[f]}), "fwd"}
    packed = materialize_blocks(blocks.pack(panel.df, columns), "blocks") if any(ready.values()) else None
    cells = blocks.cells_of(packed, len(columns)) if packed is not None else 0
    for part in [p for fit in (True, False) for p in batches([f for f in good if ready[f] is fit], batch)]:
        if ready[part[0]]:
            wide = None
            found = blocks.ics_by_rounds(packed, {f"f{i}": trees[f] for i, f in enumerate(part)}, MIN_ASSETS, FLAT, cells)
            ics, absent = found.where("n > 0"), found.groupBy("name").agg((F.sum("missing") / F.sum("cells")).alias("missing"))
        else:
            wide = signals(panel, part).persist()
            ics, absent = measure(panel, part, wide)
            ics = found = ics.persist()
        stats = ic_summary(ics).join(absent, "name").where((F.col("missing") <= most_missing) & (F.col("n_days") >= least_days) & (F.abs("ic_mean") >= ic_threshold))
        if positive_only:
            stats = stats.where("ic_mean >= 0")
        if use_hlz:
            stats = stats.where(F.abs("ic_t") >= need)
        stats = stats.withColumn("oos_ic", F.col("ic_mean"))
        if use_oos:
            oos = out_of_sample(ics, panel.n_dates).select("name", F.col("oos_ic").alias("o"), "degradation", "valid")
            stats = stats.join(oos, "name").where("not (valid and degradation > 0.7)").withColumn("oos_ic", F.col("o"))
        kept = {r["name"]: r for r in stats.collect()}
        series = {n: np.zeros(panel.n_dates) for n in kept}
        for r in ics.where(F.col("name").isin(list(kept)) & F.col("ic").isNotNull()).select("name", "t", "ic").collect() if kept else []:
            series[r["name"]][r["t"]] = r["ic"]
        if wide is not None:
            found.unpersist()
            wide.unpersist()
        passed += [Screened(part[int(n[1:])], r["ic_mean"], r["icir"], r["ic_t"], r["oos_ic"], series[n]) for n, r in kept.items()]
    if packed is not None:
        free(packed)
    passed.sort(key=lambda s: (-s.ic_mean, s.expression))
    return dedup(passed, max_corr, max_keep) if always_dedup or len(passed) > max_keep else passed


def dedup(ranked: Sequence[Screened], max_corr: float = 0.85, max_keep: int = 10_000, look_back: int = 100) -> list[Screened]:
    """Greedy choice in order: one is left out if its IC series correlates above ``max_corr`` with one of the last ``look_back`` chosen."""
    kept: list[Screened] = []
    units: list[np.ndarray] = []
    for s in ranked:
        if len(kept) >= max_keep:
            break
        x = s.ic - s.ic.mean()
        size = np.linalg.norm(x)
        x = x / size if size > 0 else x
        if not units or np.abs(np.stack(units[-look_back:]) @ x).max() <= max_corr:
            kept.append(s)
            units.append(x)
    return kept


#: The fields of a record are those of the library's file format.
@dataclass
class FactorRecord:
    expression: str
    ic_mean: float = 0.0
    ic_std: float = 0.0
    icir: float = 0.0
    max_correlation: float = 0.0
    turnover: float = 0.0
    logic_description: str = ""
    admitted_at: float = field(default_factory=time.time)
    mining_round: int = 0
    factor_id: str = ""


@dataclass(frozen=True)
class Verdict:
    """``code``: first, distinct or stronger (admitted); too_few_days, weak, insignificant, decayed or alike.  ``figures`` are what it was decided by."""

    admitted: bool
    code: str
    figures: dict[str, float] = field(default_factory=dict)
    replace: int | None = None
    max_correlation: float = 0.0

    @property
    def reason(self) -> str:
        return " ".join([self.code, *(f"{k}={v:.4g}" for k, v in self.figures.items())])


class FactorLibrary:
    """Records in a JSON file, and the rules of admission to them."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)
        names = {f.name for f in fields(FactorRecord)}
        found = load_json(self.path, [])
        self.factors = [FactorRecord(**{k: v for k, v in r.items() if k in names}) for r in found if isinstance(r, dict) and "expression" in r]

    def __len__(self) -> int:
        return len(self.factors)

    def save(self) -> None:
        save_json(self.path, [asdict(f) for f in self.factors])

    def record(self, factor_id: str) -> FactorRecord | None:
        return next((f for f in self.factors if f.factor_id == factor_id), None)

    def admit(self, record: FactorRecord, replace: int | None = None) -> None:
        """Append a record, or put it in another's place; records without an id get the next one."""
        if not record.factor_id:
            used = [int(f.factor_id[1:]) for f in self.factors if f.factor_id[1:].isdigit()]
            record.factor_id = f"F{max(used, default=0) + 1:06d}"
        if replace is not None and 0 <= replace < len(self.factors):
            self.factors[replace] = record
        else:
            self.factors.append(record)
        self.save()

    def correlations(self, panel: Panel, formula: str) -> list[float]:
        """Mean daily Spearman correlation of a formula's signal with that of every record, 0 for what can't be evaluated."""
        known = {c for c in panel.df.columns if c not in ("code", "date", "t", "fwd")}
        usable = [i for i, f in enumerate(self.factors) if validate(f.expression, known)[0]]
        out = [0.0] * len(self.factors)
        if usable:
            wide = evaluate(panel.df, {"x": formula, **{f"f{i}": self.factors[i].expression for i in usable}}, panel.n_dates)
            long = to_long(wide, [f"f{i}" for i in usable]).select("name", "code", "date", "t", F.col("value"), F.col("x").alias("fwd"))
            from quantaloom.functions.ic import spearman_series

            for r in spearman_series(long).groupBy("name").agg(F.avg("ic").alias("c")).collect():
                out[int(r["name"][1:])] = r["c"] or 0.0
        return out

    def check(
        self, panel: Panel, formula: str, ics: DataFrame, *, ic_threshold: float = 0.005, corr_threshold: float = 0.85, use_hlz: bool = True, use_oos: bool = False, n_tested: int = 0,
    ) -> Verdict:
        """Whether a formula, with its IC series, is admitted: IC, significance, decay out of sample (if asked for), resemblance, replacement."""
        s = ic_summary(ics).first()
        if s is None or s["n_days"] < 10:
            return Verdict(False, "too_few_days", {"days": s["n_days"] if s else 0})
        size = abs(s["ic_mean"])
        if size < ic_threshold:
            return Verdict(False, "weak", {"ic": size, "least": ic_threshold})
        if use_hlz:
            need = hlz_threshold(n := max(n_tested, len(self) + 1, 10))
            if abs(s["ic_t"]) < need:
                return Verdict(False, "insignificant", {"t": abs(s["ic_t"]), "least": need, "tests": n})
        if use_oos:
            o = out_of_sample(ics, panel.n_dates).first()
            if o["valid"] and o["degradation"] > 0.7:
                return Verdict(False, "decayed", {"degradation": o["degradation"]})
        if not self.factors:
            return Verdict(True, "first", {"ic": size})
        alike = np.abs(self.correlations(panel, formula))
        worst = int(alike.argmax())
        most = float(alike[worst])
        figures = {"ic": size, "correlation": most}
        if most < corr_threshold:
            return Verdict(True, "distinct", figures, None, most)
        if size > 1.1 * abs(self.factors[worst].ic_mean):
            return Verdict(True, "stronger", figures, worst, most)
        return Verdict(False, "alike", figures, None, most)


def signal_turnover(panel: Panel, formula: str) -> float:
    """Mean over dates of the mean absolute day-to-day change of a signal."""
    moved = evaluate(panel.df, {"x": formula}, panel.n_dates).select("date", "code", "x")
    from pyspark.sql import Window

    change = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("code").orderBy("date")))
    return moved.withColumn("c", change).groupBy("date").agg(F.avg("c").alias("c")).agg(F.avg("c")).first()[0] or 0.0


__all__ = ["FEATURES", "FactorLibrary", "FactorRecord", "Screened", "Verdict", "batches", "dedup", "measure", "screen", "signal_correlation", "signal_turnover"]
